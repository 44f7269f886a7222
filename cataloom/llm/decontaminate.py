"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every run of SEED words of a test item is a possible seed. All of them are counted over the whole corpus; those of an item
that are no more frequent than its median are its rare seeds. A window of a text is aligned to an item if it holds a rare
seed of the item or two different seeds. Local alignment (match 2, other -1, gap -1) finds edited copies; a pair counts if
its score reaches SHARE of the item's own and LEAST points.
The items are taken in blocks of about BLOCK_BYTES, each sent to the executors in turn, so what is sent has a fixed bound;
the corpus is scanned twice for each block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, staged, tidy
from .words import chunks, hashed, mix

SEED = 3
SHARE = 0.4
LEAST = 16
BLOCK_BYTES = 4 << 20
#: Text hashed at once: the arrays of its words take some forty times as much.
CHUNK_BYTES = 1 << 18
#: Words around a seed's place in an item that insertions may take up.
SLACK = 0.25


def seed_hashes(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of k words with one owner."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    at = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])
    return s[at], at


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, end of the best alignment in the text)."""
    h = np.zeros(len(text) + 1, np.int32)
    j = np.arange(len(text) + 1, dtype=np.int32)
    best, end = 0, 0
    for w in item:
        t = np.maximum(h - 1, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(text == w, 2, -1))
        h = np.maximum.accumulate(t + j) - j
        i = int(h.argmax())
        if h[i] > best:
            best, end = int(h[i]), i
    return best, end


class Items:
    """A block of items: their words, and the seeds with the items and places they stand at."""

    def __init__(self, ids: pa.Array, texts: list[str | None], k: int = SEED):
        w = hashed([(t or "").encode("utf-8", "surrogatepass") for t in texts], range(len(texts))) if texts else None
        self.ids, self.k = ids, k
        edge = np.searchsorted(w.row, np.arange(len(ids) + 1)) if w else np.zeros(1, np.int64)
        self.words = [w.hash[a:z] for a, z in zip(edge[:-1], edge[1:])]
        # an item shorter than a seed can't be told from common use
        seed, at = seed_hashes(w.hash, w.row, k) if w else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        item = w.row[at] if w else at
        first = np.searchsorted(w.row, item) if w else at
        o = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[o], item[o].astype(np.int64), (at - first)[o]
        self.rare = np.ones(len(o), bool)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text words, index of the first equal seed) of each seed found."""
        s, at = seed_hashes(h, row, self.k)
        may = self.near[(s >> np.uint64(44)).astype(np.int64)]
        s, at = s[may], at[may]
        if not len(s):
            return at, at
        i = np.minimum(np.searchsorted(self.seed, s), len(self.seed) - 1)
        hit = self.seed[i] == s
        return at[hit], i[hit]

    def judge(self, counts: np.ndarray) -> None:
        """Rare seeds: no more frequent in the corpus than the item's median seed. counts: by index of the first equal seed."""
        c = counts[np.searchsorted(self.seed, self.seed)] if len(self.seed) else counts
        o = np.argsort(self.item, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(self.item[o]) > 0, True]) if len(o) else np.zeros(1, np.int64)
        for a, z in zip(edge[:-1], edge[1:]):
            self.rare[o[a:z]] = c[o[a:z]] <= np.median(c[o[a:z]])


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    own = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        t = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).toArrow()
        if t.num_rows:
            yield Items(t.column("id").combine_chunks(), t.column("text").to_pylist())


def tally(batches: Iterator[pa.RecordBatch], items: Items) -> np.ndarray:
    """How often each seed of a block occurs in the first column."""
    total = np.zeros(len(items.seed), np.int64)
    for b in batches:
        for w in chunks(b.column(0), CHUNK_BYTES):
            at, n = np.unique(items.hits(w.hash, w.row)[1], return_counts=True)
            total[at] += n
    return total


def _counts(texts: DataFrame, sent, size: int) -> np.ndarray:
    """How often each seed of a block occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = tally(batches, sent.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["seed", "n"])

    out = np.zeros(size, np.int64)
    for i, n in texts.mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n")).collect():  # the seeds of one block
        out[i] = n
    return out


def _aligned(w, items: Items) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, share, end) of the pairs in a chunk of texts."""
    at, first = items.hits(w.hash, w.row)
    if not len(at):
        return
    last = np.searchsorted(items.seed, items.seed[first], "right")
    many = last - first
    pos = np.repeat(at, many)
    seed = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, row = items.item[seed], w.row[pos]
    origin = pos - items.place[seed]  # where the item would start
    o = np.lexsort((origin, item, row))
    pos, seed, item, row, origin = pos[o], seed[o], item[o], row[o], origin[o]
    size = np.array([len(x) for x in items.words], np.int64)
    slack = np.maximum(8, (SLACK * size[item]).astype(np.int64))
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > slack[1:])]
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(pos)]
    best: dict[tuple[int, int], tuple[float, int]] = {}
    lo, hi = np.searchsorted(w.row, row[begin]), np.searchsorted(w.row, row[begin], "right")
    for a, z, x, y in zip(begin, stop, lo, hi):
        if not items.rare[seed[a:z]].any() and len(np.unique(items.seed[seed[a:z]])) < 2:
            continue
        i = int(item[a])
        own = items.words[i]
        start, end = max(x, origin[a] - slack[a]), min(y, origin[z - 1] + size[i] + slack[a])
        score, at_end = align(own, w.hash[start:end])
        if score >= SHARE * 2 * len(own) and score >= min(LEAST, 2 * len(own)):
            key = int(row[a]), i
            if score / (2 * len(own)) > best.get(key, (0.0, 0))[0]:
                best[key] = score / (2 * len(own)), int(start + at_end - x)
    for (r, i), (share, end) in best.items():
        yield r, i, share, end


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, h, item, score, end_word) for each row of df and item that its text holds a copy of.

    h: the text's hash; score: alignment score as a share of the item's own; end_word: where the best alignment ends.
    Texts are read whole; null and empty texts and items match nothing, nor do items of fewer than SEED words. Repeated rows
    and items come out each time; null ids pass through; ties go to the first window. Other columns are not read.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    out = None
    schema = f"id {field_type(src, 'id')}, h bigint, item {field_type(items, item_col)}, score double, end_word bigint"
    for block in _blocks(items, item_col, item_text):
        block.judge(_counts(src.select("text"), spark.sparkContext.broadcast(block), len(block.seed)))
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [x for w in chunks(b.column(2), CHUNK_BYTES) for x in _aligned(w, sent.value)]
                if found:
                    row, item, share, end = zip(*found)
                    at = pa.array(row, pa.int64())
                    made = [sent.value.ids.take(pa.array(item, pa.int64())), pa.array(share, pa.float64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *made], ["id", "h", "item", "score", "end_word"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


@tidy
def drop_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose texts hold a copy of an item; its columns are unchanged, whatever their names."""
    found = staged(leaks(df, items, id_col, text_col).select(F.col("id").alias("__cataloom_id"), F.col("h").alias("__cataloom_h")).distinct(), "leaks", keep=True)
    d = df.withColumn("__cataloom_key", F.xxhash64(text_col))
    stay = d.join(found, d[id_col].eqNullSafe(found["__cataloom_id"]) & (d["__cataloom_key"] == found["__cataloom_h"]), "left_anti")
    return stay.drop("__cataloom_key")
