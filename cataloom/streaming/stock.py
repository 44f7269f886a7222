"""Streams of stock readings: daily units, deltas by SKU and idempotent keyed sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

READING = "id long, sku long, quantity int, checked_at timestamp"


def readings(spark: SparkSession, path: str, files_per_batch: int = 5) -> DataFrame:
    """New files of readings, a few for each micro-batch."""
    return spark.readStream.schema(READING).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(dd, readings, known) per day; readings later than the watermark are left out. An addition of this library."""
    w = stream.withWatermark("checked_at", late).groupBy(F.window("checked_at", "1 day"))
    return w.agg(F.count("*").alias("readings"), F.count("quantity").alias("known")).select(F.to_date("window.start").alias("dd"), "readings", "known")


def deltas(stream: DataFrame) -> DataFrame:
    """(sku, id, sold): units by which each reading is below the one before it, with the last quantity held as state.

    Readings of a SKU must arrive in order of time across batches; within a batch they are sorted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["checked_at", "id"])
        ids, sold = [], []
        for i, q in zip(rows["id"], rows["quantity"]):
            q = None if pd.isna(q) else int(q)
            if last is not None and q is not None and q < last:
                ids.append(i)
                sold.append(last - q)
            last = q
        state.update((last,))
        yield pd.DataFrame({"sku": [key[0]] * len(ids), "id": ids, "sold": sold}).astype("int64")

    return stream.groupBy("sku").applyInPandasWithState(step, "sku long, id long, sold long", "quantity int", "append", GroupStateTimeout.NoTimeout)


def merged_into(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, rejects: str | None = None, valid=None, buckets: int = 16) -> StreamingQuery:
    """A query that keeps the last row of each key at path; a batch reads and rewrites only the buckets of its keys, in one write.

    A replayed batch gives the same. Rows that fail valid go to rejects. merged reads the table. Versions of a bucket older
    than the one that a batch replaces are deleted.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = batch if valid is None else batch.filter(valid)
        if rejects is not None and valid is not None:
            batch.filter(~F.coalesce(valid, F.lit(False))).write.mode("overwrite").parquet(f"{rejects}/v={number}")
        good = good.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = {r.bucket for r in good.select("bucket").distinct().collect()}  # one number for each bucket
        there = _versions(spark, path)
        replaced = {b: max(v for v in there[b] if v < number) for b in touched if any(v < number for v in there.get(b, ()))}
        before = [f"{path}/v={v}/bucket={b}" for b, v in replaced.items()]
        rows = spark.read.schema(good.schema).option("basePath", path).parquet(*before).select(*good.columns).union(good) if before else good
        last = rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        for b, v in replaced.items():
            for older in there[b]:
                if older < v:
                    p, fs = _folder(spark, f"{path}/v={older}/bucket={b}")
                    fs.delete(p, True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The finished versions of each bucket."""
    out: dict[int, list[int]] = {}
    for name in _names(spark, path):
        inside = _names(spark, f"{path}/{name}") if name.startswith("v=") else []
        if "_SUCCESS" in inside:
            for b in inside:
                if b.startswith("bucket="):
                    out.setdefault(int(b[7:]), []).append(int(name[2:]))
    return out


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that merged_into keeps: the last version of each bucket."""
    last = [f"{path}/v={max(v)}/bucket={b}" for b, v in _versions(spark, path).items()]
    return spark.read.option("basePath", path).parquet(*last).drop("bucket", "v")
