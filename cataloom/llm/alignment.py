"""Alignment of two tokenizers over a corpus by joins of token intervals.

Each task tokenizes its texts with a byte-level BPE (A) and a piece BPE (B) and gives DuckDB the two interval tables, some
megabytes of texts at a time. All texts of a chunk lie one after the other on one byte axis, so a token is an interval of it.
Two tokens overlap where the later of their starts lies within the other: an ASOF join finds the B token around each A start,
another one with a range condition the A token around each B start that is no A start. Starts of both kinds cut groups, which
a window sum numbers. Counts of pairs are summed in each task and merged in Spark; they have at most one row for each pair of
vocabulary entries, whatever the corpus. Links wait, counted by pair within each text, until the merged counts are joined to
them.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field_type, sent, staged, tidy

TOKENIZERS = "/opt/tokenizers"
#: Bytes of texts whose intervals are joined at a time; a text is never divided.
CHUNK_BYTES = 1 << 20
#: Pair counts of a row of partial counts.
ROW_PAIRS = 1 << 15
# Fixed value: how a byte-level BPE of this family cuts a text before merging.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes are alike in every Unicode version; texts of these alone take the faster of two equal encoders.
_STABLE = re.compile("[^\x00-ɏЀ-џ‐-‧€]")
#: Neither tokenizer joins bytes across the end of a word that a space and more text follow, so words are encoded one by one
#: and those of up to WORD characters are remembered, CACHE at most.
_WORDS = re.compile(r"(?<=\S)(?= .)", re.S)
WORD, CACHE = 40, 1 << 17


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id, for lengths and for spelling ids out."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.array([len(b) for b in spelled], np.int32)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class Tokenizers:
    """Both tokenizers; a folder holds byte_bpe_50k.json and piece_bpe_32k.model."""

    def __init__(self, folder: str):
        self.path = f"{folder}/byte_bpe_50k.json"
        with open(self.path, encoding="utf-8") as f:
            document = json.load(f)
        vocab, special = document["model"]["vocab"], {t["id"] for t in document["added_tokens"]}
        alphabet = _byte_alphabet()
        spelled = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            spelled[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.fast = tiktoken.Encoding("a", pat_str=_CUTS, mergeable_ranks={b: i for i, b in enumerate(spelled) if i not in special}, special_tokens={})
        self.a = Vocabulary(spelled)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece holds a space after other characters, so words can't be encoded one by one")
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    @functools.cached_property
    def plain(self) -> tokenizers.Tokenizer:
        plain = tokenizers.Tokenizer.from_file(self.path)
        plain.encode_special_tokens = True
        return plain

    def encode_a(self, text: str) -> list[int]:
        if _STABLE.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def words(self, texts: list[list[str]]) -> dict[str, tuple[bytes, bytes, bool]]:
        """For each word of the texts that isn't known, space included: its A ids and B ids (32 bits each) and whether both
        spell it exactly. The first CACHE words become known for later texts."""
        new = list({w for words in texts for w in words if w not in self.known})
        made = {}
        for w, b in zip(new, self.pieces.encode([w[1:] for w in new], num_threads=1)):
            a = self.encode_a(w)
            spelled = w.encode()
            made[w] = (array("i", a).tobytes(), array("i", b).tobytes(), self.a.spell(a) == spelled == self.b.spell(b))
        self.known.update(itertools.islice(((w, x) for w, x in made.items() if len(w) <= WORD), CACHE - len(self.known)))
        return made


@functools.cache
def load(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def _intervals(ids: list[bytes], v: Vocabulary) -> pa.Table:
    flat = np.frombuffer(b"".join(ids), np.int32)
    end = np.cumsum(v.size[flat], dtype=np.int32)
    return pa.table({"r": np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids]), "id": flat, "s": end - v.size[flat], "e": end})


def encoded(texts: list[str], t: Tokenizers) -> tuple[list[int], pa.Table | None, pa.Table | None]:
    """(places of the texts that both tokenizers spell exactly, their A intervals, their B intervals)."""
    words = [_WORDS.split(" " + x) for x in texts]
    before, new = t.known, t.words(words)
    good, a, b = [], [], []
    for i, own in enumerate(words):
        found = [before.get(w) or new[w] for w in own]
        if all([f[2] for f in found]):
            good.append(i)
            a.append(b"".join([f[0] for f in found]))
            b.append(b"".join([f[1] for f in found]))
    return (good, _intervals(a, t.a), _intervals(b, t.b)) if good else ([], None, None)


_JOINS = (
    "CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM arrow_a",
    "CREATE OR REPLACE TEMP TABLE b AS SELECT * FROM arrow_b",
    # the B token around each A start; a start of both begins a group
    """CREATE OR REPLACE TEMP TABLE of_a AS
       SELECT a.r, a.s, a.id AS a, b.id AS b, a.s = b.s AS begins, sum((a.s = b.s)::INT) OVER (ORDER BY a.s ROWS UNBOUNDED PRECEDING)::BIGINT AS g
       FROM a ASOF JOIN b ON a.s >= b.s""",
    # the A token around each B start that is no A start
    """CREATE OR REPLACE TEMP TABLE of_b AS
       SELECT b.r, b.s, a.id AS a, b.id AS b FROM b ASOF JOIN a ON b.s > a.s WHERE a.e > b.s""",
    """CREATE OR REPLACE TEMP TABLE pairs AS
       SELECT r, (a::BIGINT << 32) | b AS pair, count(*) AS n
       FROM (SELECT r, a, b FROM of_a UNION ALL SELECT r, a, b FROM of_b) GROUP BY ALL""",
    "INSERT INTO counts SELECT pair, sum(n)::BIGINT FROM pairs GROUP BY pair",
)
# tokens in order of group, tokenizer and place; mark: what separates a token from the one before it
_ORDERED = """
SELECT r, id, mark FROM (
  SELECT r, a AS id, CASE WHEN begins THEN 0 ELSE 2 END AS mark, (g * 2) << 31 | s::BIGINT AS k FROM of_a
  UNION ALL
  SELECT b.r, b.id, CASE WHEN b.s = f.s THEN 1 ELSE 2 END, (f.g * 2 + 1) << 31 | b.s::BIGINT
  FROM b ASOF JOIN (SELECT s, g FROM of_a WHERE begins) f ON b.s >= f.s
) ORDER BY k"""
_MARKS = (";", "|", ",")
_LINKS = "SELECT r, list({'pair': pair, 'n': n}) AS links, sum(n)::BIGINT AS n FROM pairs GROUP BY r ORDER BY r"
_LINK = pa.struct([("pair", pa.int64()), ("n", pa.int64())])


@functools.cache
def _marked(width: int) -> list[str]:
    return [m + str(i) for m in _MARKS for i in range(width)]


def joined(con: duckdb.DuckDBPyConnection, a: pa.Table, b: pa.Table) -> tuple[list[str], np.ndarray, pa.Table]:
    """(groups of each text as written, their numbers, links by pair and their number); pair counts go to the table counts."""
    con.register("arrow_a", a)
    con.register("arrow_b", b)
    for sql in _JOINS:
        con.execute(sql)
    ordered = con.sql(_ORDERED).to_arrow_table()
    r, ids, mark = (ordered.column(k).to_numpy() for k in ("r", "id", "mark"))
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    width = 1 << int(ids.max()).bit_length()
    names = _marked(width)
    words = list(map(names.__getitem__, (mark * width + ids).tolist()))
    groups = ["".join(words[i:j])[1:] for i, j in zip(start.tolist(), [*start[1:].tolist(), len(words)])]
    return groups, np.add.reduceat((mark == 0).astype(np.int64), start), con.sql(_LINKS).to_arrow_table()


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("CREATE TABLE counts (pair BIGINT, n BIGINT)")
    return con


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids as Arrow arrays, texts) of some megabytes at a time; nulls count as empty."""
    for batch in batches:
        texts = batch.column(1)
        at, size = 0, 0
        held: list[str] = []
        for i in range(batch.num_rows):
            held.append(texts[i].as_py() or "")
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield batch.column(0).slice(at, i + 1 - at), held
                at, size, held = i + 1, 0, []
        if held:
            yield batch.column(0).slice(at), held


def aligned_texts(df: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """Rows of two kinds: texts (uid, id, sizes, groups_sha256, links counted by pair) and, with null uid, partial pair counts."""
    schema = f"uid bigint, id {field_type(df, id_col)}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,n:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, con = load(folder), _connection()
        uid, kind = TaskContext.get().partitionId() << 40, None
        for ids, texts in _chunks(batches):
            m, kind = len(texts), ids.type
            sizes = np.zeros((4, m), np.int64)
            sha, links = [""] * m, [[] for _ in texts]
            some = [i for i, x in enumerate(texts) if x]
            good, a, b = encoded([texts[i] for i in some], t) if some else ([], None, None)
            if good:
                at = np.array(some)[good]
                groups, n_groups, linked = joined(con, a, b)
                sizes[0, at] = np.bincount(a.column("r").to_numpy(), minlength=len(at))
                sizes[1, at] = np.bincount(b.column("r").to_numpy(), minlength=len(at))
                sizes[2, at], sizes[3, at] = n_groups, linked.column("n").to_numpy()
                for i, s in zip(at, groups):
                    sha[i] = hashlib.sha256(s.encode()).hexdigest()
                lists = linked.column("links").combine_chunks()
                offset = np.zeros(m + 1, np.int32)
                offset[at + 1] = np.diff(lists.offsets.to_numpy())
                links = pa.ListArray.from_arrays(pa.array(np.cumsum(offset, dtype=np.int32)), lists.flatten().cast(_LINK))
            else:
                links = pa.array(links, pa.list_(_LINK))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + m)), ids, *(pa.array(x) for x in sizes), pa.array(sha), links], ["uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
            uid += m
            pa.default_memory_pool().release_unused()
        merged = con.sql("SELECT {'pair': pair, 'n': sum(n)::BIGINT} AS link FROM counts GROUP BY pair").to_arrow_table().column("link").combine_chunks()
        con.close()
        for i in range(0, len(merged), ROW_PAIRS):
            part = merged.slice(i, ROW_PAIRS).cast(_LINK)
            none = [pa.nulls(1, x) for x in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)], ["uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, total, best) from the partial counts; best: no other A id has more links with the pair's B id."""
    totals = texts.filter("uid IS NULL").select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("total"))
    # a B id has at most a row for each entry of A's vocabulary
    w = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(w))


@tidy
def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text counts with a space before it. Null and empty texts, and texts that a tokenizer doesn't spell exactly (B replaces
    U+2581, for one), have zeros and an empty groups_sha256. Repeated rows and null ids each get a row; an empty table gives
    none. Other columns are not read. Tied highest counts of a B id are all best.
    """
    texts = staged(aligned_texts(df, id_col, text_col, folder), "aligned", keep=True)
    counts = staged(pair_counts(texts), "pairs", keep=True)
    links = texts.filter("uid IS NOT NULL").select("uid", F.inline("links")).join(sent(counts), "pair")
    summed = links.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("total")).alias("count_sum"))
    rows = texts.filter("uid IS NOT NULL").drop("links").join(summed, "uid", "left")
    sums = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_best", "count_sum")]
    return rows.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")
