"""Chains of streaming stages over outbox tables.

Each stage reads another stage's outbox as a stream and appends to its own through the file sink, whose log names the files
of each batch. So a batch is in an outbox once, however often it is replayed: after a crash between write and commit, or
after a stage's checkpoint is lost (its batches must then be cut as before, by files_per_batch).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Stage:
    """name: of the outbox; reads: a source or an earlier stage; step: what happens to each micro-batch's rows."""

    name: str
    reads: str
    step: Callable[[DataFrame], DataFrame]


def outbox_path(root: str, name: str) -> str:
    return f"{root}/{name}/outbox"


def _made(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def stream_of(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def started(spark: SparkSession, stage: Stage, source: DataFrame, root: str) -> tuple[StreamingQuery, DataFrame]:
    """(the running query, its rows) of a stage that takes what is there and stops."""
    rows = stage.step(source)
    writer = rows.writeStream.queryName(stage.name).format("parquet").outputMode("append").option("path", _made(spark, outbox_path(root, stage.name)))
    return writer.option("checkpointLocation", f"{root}/{stage.name}/checkpoint").trigger(availableNow=True).start(), rows


def run_chain(spark: SparkSession, root: str, sources: dict[str, tuple[str, object]], stages: list[Stage], files_per_batch: int = 5) -> dict[str, DataFrame]:
    """Outboxes by name after one pass over what is new; sources: path and schema of each. Stages of one source run at once."""
    at = dict(sources)
    waiting = list(stages)
    while waiting:
        ready = [s for s in waiting if s.reads in at]
        if not ready:
            raise ValueError(f"no source for {', '.join(s.reads for s in waiting)}")
        running = [(s, *started(spark, s, stream_of(spark, *at[s.reads], files_per_batch), root)) for s in ready]
        for s, query, rows in running:
            query.awaitTermination()
            at[s.name] = (outbox_path(root, s.name), rows.schema)
        waiting = [s for s in waiting if s not in ready]
    return {s.name: spark.read.schema(at[s.name][1]).parquet(at[s.name][0]) for s in stages}
