"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _min_neighbour(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _min_neighbour(down)
    moved = down.join(m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v); root is the smallest node reachable.

    Self links, repeated links and an empty table are fine; nodes without a link to another one don't appear.
    Each round is written to the shared folder; only one row of totals reaches the driver.
    """
    e = staged(links.filter("u <> v").select("u", "v").distinct(), "links")
    totals = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == totals:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        totals = now
        e = staged(_small_star(_large_star(e)), "links")
