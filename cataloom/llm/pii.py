r"""Personal data: pattern spans, and terms that disclose a protected entity by co-occurrence. DataFrame functions only.

Protected entities are the values that the patterns find (email, ip, card, phone), where SUPPORT different texts hold them,
and the four kinds themselves, which also cover values that occur once. Terms are words of four or more letters outside of
emails. Over the corpus, a term's disclosure of an entity is its pointwise mutual information with it divided by the
entity's information content, log(N n / (df_e df_t)) / log(N / df_e), where N, df and n count rows whose whole text holds
the entity, the term, or both. A term that reaches DISCLOSURE and stands with the entity in SUPPORT different texts discloses
it. A term that discloses a value is removed wherever it stands; one that discloses a kind, in texts that hold the kind
(spans of kind `term`).
Pattern scans start only where a match can start and don't back-track, so their time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent, staged, tidy

# The kinds and their patterns, in the order of results.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}{4,}+"
DISCLOSURE = 0.9
SUPPORT = 3
#: Matches of a text that are taken without blocks.
FEW = 64
KINDS = (*PATTERNS, "term")
SPANS = "array<struct<s:int,e:int>>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, d: Column) -> Column:
        n = d.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((1 - acc["odd"]).alias("odd"), (acc["sum"] + F.when(acc["odd"] == 1, twice).otherwise(n)).alias("sum"))

    start = F.struct(F.lit(0).alias("odd"), F.lit(0).alias("sum"))
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(each, start, add, lambda acc: acc["sum"] % 10 == 0)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{IP_PART}(\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(m) < 16, F.lit(False)).otherwise(let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, valid=None, value=None) -> Column:
    """Spans (s, e: code points, e exclusive) of the leftmost non-overlapping matches; value(m) adds a field v.

    An array that grows costs the square of its length, so many matches are taken in blocks of about the root of their
    number: first the lengths of the blocks are added up, then each block begins where the ones before it end.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    fields = "s:int,e:int" + (",v:string" if value else "")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(begin.alias("s"), end.alias("e"), *([value(x["m"]).alias("v")] if value else []))
        good = x["m"].isNotNull() & (valid(x["m"]) if valid else F.lit(True))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def from_place(own: Column, at: Column) -> Column:
        start = F.struct(at.cast("int").alias("at"), F.array().cast(f"array<struct<{fields}>>").alias("out"))
        return F.aggregate(own, start, step, lambda acc: acc["out"])

    def in_blocks(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), size), lambda i: F.slice(x, i, size))
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, y: n + F.length(y["gap"]) + F.coalesce(F.length(y["m"]), F.lit(0)))
        ends = lambda ls: F.aggregate(ls, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        placed = lambda b: F.zip_with(b, let(F.transform(b, length), ends), lambda own, at: F.when(own.isNotNull(), from_place(own, at)))
        return F.flatten(F.filter(let(blocks, placed), lambda b: b.isNotNull()))

    return let(pairs, lambda x: F.when(F.size(x) > FEW, in_blocks(x)).otherwise(from_place(x, F.lit(0))))


def base_spans(text: Column, kind: str, value=None) -> Column:
    """The valid spans of one kind; null texts have none; value as in matches."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}[kind]
    found = matches(text, PATTERNS[kind], lambda m: _valid(kind, m), value)
    return F.when(may, found).otherwise(F.array().cast(SPANS.replace("e:int", "e:int,v:string") if value else SPANS))


def _terms(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(base: DataFrame, src: DataFrame) -> DataFrame:
    """(term, kinds): terms that disclose these kinds; the kind `value` stands for single values.

    base: a row for each row of src with the spans of each kind, ents (hashes of the values) and terms, null without ents.
    """
    total = base.count()
    has = [(F.size(k) > 0).cast("long").alias(f"has_{k}") for k in PATTERNS]
    df_k = base.filter(F.size("ents") > 0).select(*has).agg(*[F.coalesce(F.sum(f"has_{k}"), F.lit(0)) for k in PATTERNS]).first()
    held = staged(base.filter(F.size("ents") > 0).groupBy("h").agg(F.count("*").alias("c"), F.first(F.struct(*has, "ents", "terms")).alias("x")).select("h", "c", "x.*"), "held")
    counts = [y for k in PATTERNS for y in (F.sum(F.col("c") * F.col(f"has_{k}")).alias(f"n_{k}"), F.sum(f"has_{k}").alias(f"texts_{k}"))]
    met = held.select("c", *[f"has_{k}" for k in PATTERNS], F.explode("terms").alias("term")).groupBy("term").agg(*counts)
    each = [F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"), F.col(f"texts_{k}").alias("texts"), F.lit(int(d)).cast("long").alias("df_e")) for k, d in zip(PATTERNS, df_k)]
    by_kind = met.select("term", F.inline(F.array(*each))).filter(F.col("texts") >= SUPPORT)
    ents = held.select("c", "terms", F.explode("ents").alias("ent"))
    often = staged(ents.groupBy("ent").agg(F.sum("c").alias("df_e"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).drop("texts"), "values")
    pairs = ents.join(sent(often), "ent").select("ent", "df_e", "c", F.explode("terms").alias("term")).groupBy("ent", "df_e", "term").agg(F.sum("c").alias("n"), F.count("*").alias("texts"))
    by_value = pairs.filter(F.col("texts") >= SUPPORT).select("term", F.lit("value").alias("kind"), "n", "texts", "df_e")
    maybe = staged(by_kind.union(by_value).groupBy("term", "kind", "df_e").agg(F.max("n").alias("n")), "maybe")
    df_t = src.select(F.explode(_terms(F.col("text"))).alias("term")).join(sent(staged(maybe.select("term").distinct(), "maybe")), "term").groupBy("term").agg(F.count("*").alias("df_t"))
    pmi = F.log2(F.lit(float(total)) * F.col("n") / (F.col("df_e") * F.col("df_t")))
    content = F.log2(F.lit(float(total)) / F.col("df_e"))
    return maybe.join(df_t, "term").filter((content > 0) & (pmi >= DISCLOSURE * content - 1e-9)).groupBy("term").agg(F.collect_set("kind").alias("kinds"))


@tidy
def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, email, ip, card, phone, term): the spans of every row as arrays of (s, e); h tells rows of one id apart.

    Null and empty texts have none. Rows equal in id and text get equal spans; null ids are fine; without rows the corpus
    counts are empty and so are the results. Texts are read whole, three times. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    name = lambda kind: F.lower if kind in ("email", "ip") else _digits
    found = src.select("id", "h", "text", *[base_spans(F.col("text"), k, name(k)).alias(k) for k in PATTERNS])
    entities = lambda kind: F.transform(kind, lambda x: F.xxhash64(F.lit(kind), x["v"]))
    places = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in PATTERNS]
    any_found = F.lit(False)
    for k in PATTERNS:
        any_found |= F.size(k) > 0
    ents = F.array_distinct(F.concat(*[entities(k) for k in PATTERNS]))
    base = staged(found.select("id", "h", *places, ents.alias("ents"), F.when(any_found, _terms(F.col("text"))).alias("terms")), "spans", keep=True)
    shown = sent(staged(disclosing(base, src), "disclosing"))
    kinds = F.filter(F.array(*[F.when(F.size(k) > 0, F.lit(k)) for k in PATTERNS]), lambda k: k.isNotNull())
    here = base.filter(F.size("ents") > 0).select("id", "h", kinds.alias("own"), F.explode("terms").alias("term")).join(shown, "term").filter(F.arrays_overlap("own", "kinds")).select("id", "h", "term")
    anywhere = src.select("id", "h", F.explode(_terms(F.col("text"))).alias("term")).join(shown.filter(F.array_contains("kinds", "value")), "term").select("id", "h", "term")
    flagged = sent(staged(here.union(anywhere).groupBy(F.col("id").alias("xid"), F.col("h").alias("xh")).agg(F.collect_set("term").alias("flagged")), "flagged"))
    spans = matches(F.col("text"), TERM, lambda m: F.array_contains("flagged", F.lower(m)))
    extra = src.join(flagged, src.id.eqNullSafe(flagged.xid) & (src.h == flagged.xh)).select("xid", "xh", spans.alias("term")).dropDuplicates(["xid", "xh"])
    extra = sent(staged(extra, "terms", keep=True))
    out = base.drop("ents", "terms").join(extra, base.id.eqNullSafe(extra.xid) & (base.h == extra.xh), "left").drop("xid", "xh")
    outside = F.filter("term", lambda t: ~F.exists("email", lambda m: (m["s"] < t["e"]) & (t["s"] < m["e"])))
    return out.withColumn("term", F.coalesce(outside, F.array().cast(SPANS)))


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the span columns, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with entities generalised to their kind, as in [email], and disclosing terms removed from the texts."""

    def tagged(kind: str) -> Column:
        tag = F.lit("" if kind == "term" else f"[{kind}]")
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), tag.alias("v")))

    spans = find_spans(df, id_col, text_col).select(F.col("id").alias("__cataloom_id"), F.col("h").alias("__cataloom_h"), F.concat(*map(tagged, KINDS)).alias("__cataloom_spans"))
    spans = spans.dropDuplicates(["__cataloom_id", "__cataloom_h"])
    text = F.col(text_col)

    def put(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["v"])
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), more.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(F.array_sort("__cataloom_spans"), start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    d = df.withColumn("__cataloom_key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    j = d.join(spans, d[id_col].eqNullSafe(spans["__cataloom_id"]) & (d["__cataloom_key"] == spans["__cataloom_h"]), "left")
    return j.withColumn(text_col, F.when(F.size("__cataloom_spans") > 0, rest).otherwise(text)).drop("__cataloom_key", "__cataloom_id", "__cataloom_h", "__cataloom_spans")
