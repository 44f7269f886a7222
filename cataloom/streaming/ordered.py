"""Stateful streams that give the same rows in whatever order their input arrives.

Rows of a key wait in list state until the watermark has passed their time, then they are taken in order of time and id. Timers
wake a key: for its earliest waiting row, and where what it knows expires. State is kept in RocksDB, so it may exceed memory.
Rows later than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Subclasses define take(known, at, id, value) and, if what is known expires, expiry(known)."""

    #: Fields of the output rows after the key, and their types.
    fields: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, value string")
        self.known = handle.getValueState("known", "at long, value string")

    def take(self, known: tuple | None, at: int, row_id: int, value: str | None) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def expiry(self, known: tuple) -> int | None:
        """Microseconds at which what is known expires."""
        return None

    def expired(self, known: tuple) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), None if v is None or v != v else str(v)) for pdf in rows for t, i, v in zip(pdf["at"], pdf["id"], pdf["value"])]
        self.waiting.appendList(new)
        self._wake(min(t for t, _, _ in new))
        return iter(())

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        known = tuple(self.known.get()) if self.known.exists() else None
        out = []
        for at, row_id, value in [*due, (None, None, None)]:
            end = self.expiry(known) if known is not None else None
            if end is not None and end <= upto and (at is None or end < at):
                out += self.expired(known)
                known = None
            if at is not None:
                known, made = self.take(known, at, row_id, value)
                out += made
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self._wake(later[0][0])
        if known is not None:
            self.known.update(known)
            if self.expiry(known) is not None:
                self._wake(self.expiry(known))
        elif self.known.exists():
            self.known.clear()
        if out:
            yield pd.DataFrame([(*key, *row) for row in out], columns=["key", *self.fields])


class Deltas(InOrder):
    """(id, sold) of each reading below the one before it."""

    fields = ("id", "sold")

    def take(self, known, at, row_id, value):
        last = known[1] if known else None
        drop = int(last) - int(value) if last is not None and value is not None else 0
        return (at, value), [(row_id, drop)] if drop > 0 else []


class Versions(InOrder):
    """(at, diff) of each sighting: new, changed or unchanged, and gone where none follows in time."""

    fields = ("at", "diff")

    def __init__(self, gone_after: int):
        self.gone_after = gone_after

    def take(self, known, at, row_id, value):
        diff = "new" if known is None else "unchanged" if known[1] == value else "changed"
        return (at, value), [(at, diff)]

    def expiry(self, known):
        return known[0] + self.gone_after

    def expired(self, known):
        return [(known[0] + self.gone_after, "gone")]


def _in_order(stream: DataFrame, key: str, time: str, row_id: str, value: str, late: str, processor: InOrder, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.withWatermark(time, late).select(F.col(key).cast("long").alias("key"), time, F.unix_micros(time).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key long, {schema}", "Append", "EventTime")


def ordered_deltas(stream: DataFrame, key: str = "sku", time: str = "checked_at", row_id: str = "id", value: str = "quantity", late: str = "2 days") -> DataFrame:
    """(key, id, sold): units by which each reading is below the one before it in time; an unknown one breaks the chain."""
    return _in_order(stream, key, time, row_id, value, late, Deltas(), "id long, sold long")


def snapshot_diffs(stream: DataFrame, key: str, time: str, row_id: str, version: str, gone_after_days: float, late: str = "2 days") -> DataFrame:
    """(key, at, diff): what each sighting is against the one before it, and when a key not seen for so long is gone; at in microseconds."""
    return _in_order(stream, key, time, row_id, version, late, Versions(round(gone_after_days * 86_400_000_000)), "at long, diff string")


def insert_once(stream: DataFrame, path: str, keys: list[str], time: str, late: str, checkpoint: str):
    """A query that appends the first row of each key to path; a key already there is never put again, over restarts too.

    Repeats within the watermark are dropped by state, older ones by an anti join with the keys of earlier batches. A replayed
    batch overwrites its own rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch may hold repeats of one event time that came at once
        new = batch.dropDuplicates(keys)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        earlier = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) < number] if fs.exists(p) else []
        if earlier:
            there = spark.read.schema(batch.schema).parquet(*earlier).select(*keys)
            new = new.alias("n").join(there.alias("t"), [F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that insert_once keeps."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
