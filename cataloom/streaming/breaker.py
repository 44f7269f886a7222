"""A circuit breaker over an ordered log of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tripped(log: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """(key, order, outcome, run, open): run counts rate limits since the last success; other errors change nothing."""
    w = Window.partitionBy(key).orderBy(order)
    part = F.count(F.when(F.col("outcome") == "ok", 1)).over(w)
    run = F.count(F.when(F.col("outcome") == "limited", 1)).over(Window.partitionBy(key, "part").orderBy(order))
    return log.withColumn("part", part).withColumn("run", run).withColumn("open", F.max(F.col("run") >= most).over(w)).drop("part")
