"""Variable-capacity best-fit packing of token sequences.

Texts are measured in words and cut at the largest permitted length; no word is dropped. Pieces are dealt by hash into
shards of about SHARD_PIECES, each packed by one task, so a task's memory doesn't grow with the input. In a shard, pieces
go from longest to shortest into the open bin they fill best. Where none has room, the piece opens a bin of the size that
will cost least for each word it holds: for every permitted length, the pieces that are left are laid into one bin, longest
first, and the cost (length and OVERHEAD) is divided by the words laid. In the end every bin is downsized to the smallest
permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, staged

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD_PIECES = 8192


def _opening(n: int, left: list[int], lengths: tuple[int, ...]) -> int:
    """The length to open for a piece of n words, the pieces of the ascending sizes in left being still to come."""
    best, chosen = None, lengths[-1]
    for length in lengths:
        if length < n:
            continue
        room, end = length - n, len(left)
        while room and (end := bisect_right(left, room, 0, end)):  # the longest piece that fits, then the next
            end -= 1
            room -= left[end]
        cost = (length + OVERHEAD) / (length - room)
        if best is None or cost < best:
            best, chosen = cost, length
    return chosen


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int]]:
    """(bin of each piece, length of each bin) for sizes in descending order, none beyond the largest length."""
    where, filled, room, left = [], [], [], sizes[::-1]  # room: sorted (space left, bin)
    for n in sizes:
        left.pop()
        i = bisect_left(room, (n, -1))
        if i < len(room):
            space, b = room.pop(i)
        else:
            b, space = len(filled), _opening(n, left, lengths)
            filled.append(0)
        filled[b] += n
        where.append(b)
        if space > n:
            insort(room, (space - n, b))
    return where, [lengths[bisect_left(lengths, f)] for f in filled]


def pieces(df: DataFrame, id_col: str, text_col: str, largest: int) -> DataFrame:
    """(id, h, piece, start, n_tokens): every text in pieces of at most largest words; one of 0 words if it has none."""
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.as_py().split()) if t.is_valid else 0 for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "h", "n"])

    n = src.mapInArrow(run, f"id {field_type(src, 'id')}, h bigint, n bigint")
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0))
    cut = n.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select("id", "h", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("n_tokens"))


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(id, piece, start, n_tokens, bin_id, bin_length, bin_offset): where each piece of each text goes.

    start and n_tokens: words of the text; bin_offset: words before the piece in its bin. A null or empty text has one piece
    of 0 words with null bin columns. Repeated rows are packed each time; null ids are texts like others; pieces of one size
    go by text hash, piece and id, so the bins don't depend on the order of rows; an empty table gives none. Other columns are not read.
    """
    lengths = tuple(sorted(lengths))
    cut = staged(pieces(df, id_col, text_col, lengths[-1]), "pieces", keep=True)
    shards = max(1, -(-cut.count() // SHARD_PIECES))
    # equal pieces are counted, and dealt out by so many copies as a shard holds
    alike = cut.groupBy("id", "h", "piece", "start", "n_tokens").agg(F.count("*").alias("m"))
    some = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / SHARD_PIECES))))
    some = some.withColumn("copies", F.least(F.col("m") - F.col("part") * SHARD_PIECES, F.lit(SHARD_PIECES))).drop("m")
    dealt = some.withColumn("shard", F.pmod(F.xxhash64("id", "h", "piece", "part"), F.lit(shards)))
    names = [id_col, "piece", "start", "n_tokens", "bin_id", "bin_length", "bin_offset"]

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t.column("copies").to_numpy()))).combine_chunks()
        n, h, piece = (t.column(c).to_numpy() for c in ("n_tokens", "h", "piece"))
        full = np.flatnonzero(n > 0)
        rank = np.empty(len(n), np.int64)
        rank[pc.sort_indices(t.select(["id"]), [("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(n))
        order = full[np.lexsort((rank[full], piece[full], h[full], -n[full]))]
        where, caps = pack(n[order].tolist(), lengths) if len(order) else ([], [])
        used = [0] * len(caps)
        bins, cap, offset = [None] * len(n), [None] * len(n), [None] * len(n)
        first = t.column("shard")[0].as_py() << 32
        for i, b in zip(order.tolist(), where):
            bins[i], cap[i], offset[i] = first + b, caps[b], used[b]
            used[b] += int(n[i])
        made = [pa.array(x, pa.int64()) for x in (bins, cap, offset)]
        return pa.Table.from_arrays([*(t.column(c) for c in ("id", "piece", "start", "n_tokens")), *made], names)

    out = f"`{id_col}` {field_type(df, id_col)}, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_length bigint, bin_offset bigint"
    return dealt.groupBy("shard").applyInArrow(run, out)
