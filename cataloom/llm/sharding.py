"""Shards of near-equal bytes by a minimax contiguous partition of ordered atomic groups.

Law `bytes`. Atomic groups are the BUCKETS ranges of the text hash in order, so rows of equal texts are never parted. The
smallest capacity for which a greedy pass needs no more than the wanted shards is found by binary search, and the cuts
fall where the greedy pass at that capacity makes them. Only the totals of the BUCKETS groups reach the driver.
Slots number the rows of each shard without gaps: groups are numbered in order, large ones in cells that rows are dealt to by
their number, so rows of one id and one text are parted too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tidy

BUCKETS = 1 << 16
#: Rows of a group are numbered in cells of about 1 / CELLS of all rows.
CELLS = 1024


def cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """(capacity, first group of each shard after the first) of the minimax contiguous partition."""

    def greedy(capacity: int) -> list[int]:
        at, used = [], 0
        for i, s in enumerate(sizes):
            if used and used + s > capacity:
                at.append(i)
                used = 0
            used += s
        return at

    low, high = max([1, *sizes]), max(1, sum(sizes))
    while low < high:
        mid = (low + high) // 2
        if len(greedy(mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low, greedy(low)


@tidy
def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes plus 1 (a null text counts as empty); text_crc32: unsigned, of the UTF-8 bytes; grown_shard is null
    under this law. Rows of equal texts (null and empty alike) share a shard; repeated rows get slots of their own; an
    empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 48).cast("int"))
    rows = staged(rows, "rows", keep=True)  # numbers of rows stay as they are when they are read again
    totals = rows.groupBy("bucket").agg(F.sum("size"), F.count("*")).collect()  # BUCKETS rows at most
    size, count = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b, s, n in totals:
        size[b], count[b] = s, n
    _, at = cuts(size.tolist(), shards)
    shard = np.searchsorted(np.array(at, np.int64), np.arange(BUCKETS), "right")
    salts = np.maximum(1, -(-count * CELLS // max(1, int(count.sum()))))
    spark = df.sparkSession
    used = np.flatnonzero(count)
    groups = spark.createDataFrame([(int(b), int(shard[b]), int(salts[b])) for b in used], "bucket int, shard int, salts int")
    # at most BUCKETS rows of three ints
    celled = rows.join(F.broadcast(groups), "bucket").withColumn("salt", F.pmod(F.xxhash64("row"), "salts").cast("int"))
    split = celled.filter("salts > 1").groupBy("bucket", "salt").count().collect()  # BUCKETS + CELLS rows at most
    cells = {(int(b), 0): int(count[b]) for b in used if salts[b] == 1} | {(b, s): n for b, s, n in split}
    before, made, last = 0, [], -1
    for b, s in sorted(cells):
        if shard[b] != last:
            before, last = 0, shard[b]
        made.append((b, s, before))
        before += cells[b, s]
    offsets = F.broadcast(spark.createDataFrame(made, "bucket int, salt int, before long"))
    w = Window.partitionBy("bucket", "salt").orderBy("h", "id", "size", "text_crc32", "row")
    out = celled.withColumn("place", F.row_number().over(w)).join(offsets, ["bucket", "salt"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
