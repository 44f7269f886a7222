r"""Line-first quality rules. DataFrame functions only.

Each line with a word is judged by punctuation, navigation and boilerplate rules; lines that fail are removed, and a document
that loses more than LOSS of its characters is rejected. Documents failing the base rules are rejected at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES
from .pii import let

WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
LOSS = 0.5
SYMBOLS = r"[#*$%&|<>]"
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Marks that end a sentence, a quotation or a clause.
ENDING = r"[.!?:;,…\"'”’»)\]।。！？]$"
#: Lines of this many words or fewer may stand without an end mark, as headings do.
HEADING_WORDS = 12
# Phrases of page furniture in the corpus languages.
BOILERPLATE = (
    r"(?i)\b(?:cookie|privacy policy|terms of (use|service)|all rights reserved|copyright|javascript|click here|sign (in|up)|log ?in|"
    r"subscribe|newsletter|lorem ipsum|datenschutz|impressum|alle rechte vorbehalten|tous droits réservés|mentions légales|"
    r"politique de confidentialité|todos los derechos reservados|política de privacidad|aviso legal)"
)
NAVIGATION = r"[|»›→•·/]\s"


def words_of(text: Column) -> Column:
    """Words cut at ASCII white space; null and empty texts have none."""
    return F.array_remove(F.split(text, WHITE), "")


def _paired(step: int):
    return lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda x, y: F.xxhash64(x, y))


def repeated_words(words: Column) -> Column:
    """How many words stand in WINDOW-word windows that occur twice or more, the first included."""

    def sorted_windows(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        def own(x: Column, k: Column) -> Column:
            return F.when(F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])

        return F.sort_array(F.filter(F.transform(s, own), lambda i: i.isNotNull()))

    def covered(h: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        add = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"))
        found = F.aggregate(let(sorted_windows(h), positions), start, add, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    def windows(w: Column) -> Column:
        # hashes of 2, 4 and 8 words, each from two of the size below
        for step in (1, 2, 4):
            w = let(w, _paired(step))
        return w

    def counted(w: Column) -> Column:
        return let(F.slice(windows(w), F.lit(1), F.size(w) - (WINDOW - 1)), covered)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(counted(w)))


def line_passes(line: Column) -> Column:
    """Whether a line with a word passes the rules."""
    t = F.btrim(line, F.lit(SPACES))

    def judge(line: Column) -> Column:
        x, n = line["x"], line["n"]
        ends = x.rlike(ENDING) | (n <= HEADING_WORDS)
        # words that end in two or more marks, and letters in capitals, mark shouting and noise
        noisy = x.rlike(r"[!?*#$%&.,;:]{2}(\s|$)") & (F.regexp_count(x, F.lit(r"[!?*#$%&.,;:]{2,}(?=\s|$)")) * 3 > n) & (n > 2)
        letters = F.length(F.regexp_replace(x, r"[^\p{L}]+", ""))
        capitals = F.length(F.regexp_replace(x, r"[^\p{Lu}]+", ""))
        shouted = x.rlike(r"\p{Lu}{3}") & (letters >= 20) & (capitals * 2 > letters)
        symbols = x.rlike(SYMBOLS) & (F.regexp_count(x, F.lit(SYMBOLS)) * 10 > n)
        navigation = x.rlike(NAVIGATION) & (F.regexp_count(x, F.lit(NAVIGATION)) * 4 >= n)
        boilerplate = (n <= 30) & x.rlike(BOILERPLATE)
        return ends & ~symbols & ~noisy & ~shouted & ~(navigation & (n > 3)) & ~boilerplate

    return let(let(t, lambda x: F.struct(x.alias("x"), F.size(F.split(x, " ")).alias("n"))), judge)


def clean_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with failing lines cut from the texts, and removed_lines (numbers from 0), line_chars and removed_chars.

    Lines are cut at line feeds; lines without a word pass and don't count as characters. A null text stays null with no
    removed lines; a text may become empty. Columns of df by the new names are replaced; others pass through.
    """
    judge = lambda x: F.struct(x.alias("x"), F.length(x).alias("n"), x.rlike(WORD).alias("w"), F.when(x.rlike(WORD), line_passes(x)).otherwise(True).alias("ok"))

    def judged(ls: Column) -> Column:
        bad = F.filter(F.transform(ls, lambda x, i: F.when(~x["ok"], i)), lambda i: i.isNotNull())
        chars = F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.when(x["w"], x["n"]).otherwise(0))
        lost = F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.when(x["ok"], 0).otherwise(x["n"]))
        text = F.array_join(F.transform(F.filter(ls, lambda x: x["ok"]), lambda x: x["x"]), "\n")
        return F.struct(text.alias("text"), bad.alias("bad"), chars.alias("chars"), lost.alias("lost"))

    text = F.col(text_col).cast("string")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), judge)
    d = df.withColumn("__cataloom_judged", let(lines, judged))
    j = F.col("__cataloom_judged")
    made = {text_col: F.when(text.isNotNull(), j["text"]), "removed_lines": j["bad"], "line_chars": j["chars"], "removed_chars": j["lost"]}
    return d.withColumns(made).drop("__cataloom_judged")


def judge_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept comes from what clean_documents removes. A null text counts as empty: 0 everywhere, base_failed and not kept. Rows
    come out as often as they come in; null ids pass; texts are read whole. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = words_of(F.col("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    cleaned = clean_documents(df.select(F.col(id_col).alias("id"), text.alias("text"), text.alias("cleaned")), "cleaned")
    measured = cleaned.select(
        "id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        (F.col("removed_chars") <= LOSS * F.col("line_chars")).alias("clean"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return measured.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("clean")).alias("kept"),
    )
