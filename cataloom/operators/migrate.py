"""Ordered, restartable steps over versioned tables.

A table's version n is written by step n and stands at <root>/<table>/v=n. A step reads the last versions before its own, so
doing it again gives the same; it is done once its name is in the ledger, which is written after its tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """run: from all tables to those that change."""

    name: str
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def tables(self) -> list[str]:
        return [n for n in self._names(self.root) if not n.startswith("_")]

    def read(self, table: str, below: int | None = None) -> DataFrame:
        """The last version of a table, or the last one below a number."""
        at = [int(n[2:]) for n in self._names(f"{self.root}/{table}") if n.startswith("v=")]
        return self.spark.read.parquet(f"{self.root}/{table}/v={max(v for v in at if below is None or v < below)}")

    def write(self, table: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/v={version}")

    def done(self) -> list[str]:
        return sorted(self._names(f"{self.root}/_done"))

    def mark(self, entry: str) -> None:
        self.spark.createDataFrame([(entry,)], "step string").coalesce(1).write.mode("overwrite").json(f"{self.root}/_done/{entry}")

    def migrate(self, steps: list[Step]) -> list[str]:
        """Names of the steps that were done now; earlier ones stand in the ledger and must be the first of steps."""
        before, ran = set(self.done()), []
        for n, step in enumerate(steps, 1):
            entry = f"{n:04d}-{step.name}"
            if entry in before:
                continue
            if any(e > entry for e in before):
                raise ValueError(f"{entry} comes before steps that are done")
            for table, df in step.run({t: self.read(t, n) for t in self.tables()}).items():
                self.write(table, df, n)
            self.mark(entry)
            ran.append(step.name)
        return ran


# ---- one name for each cover: the steps of a migration


def plain_name(name: Column) -> Column:
    """A name without marks of trade and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "[™®©]", ""), r"\s+", " "))


def _survivors(covers: DataFrame) -> DataFrame:
    """(id, survivor) of the covers that another one of their brand and plain name stands for."""
    w = Window.partitionBy("brand", plain_name(F.col("name"))).orderBy("id")
    return covers.select("id", F.first("id").over(w).alias("survivor")).filter("id <> survivor")


def _repointed(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    s = _survivors(t["covers"]).withColumnRenamed("id", "cover_id")
    return {"products": t["products"].join(s, "cover_id", "left").withColumn("cover_id", F.coalesce("survivor", "cover_id")).drop("survivor").select(*t["products"].columns)}


def _filled(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    known = t["products"].filter("cover_id IS NOT NULL AND (material IS NOT NULL OR kind IS NOT NULL)")
    last = known.groupBy(F.col("cover_id").alias("id")).agg(F.max_by(F.struct(F.col("material").alias("m"), F.col("kind").alias("k")), F.struct("updated_at", "product")).alias("x"))
    j = t["covers"].join(last, "id", "left")
    return {"covers": j.withColumn("material", F.coalesce("material", "x.m")).withColumn("kind", F.coalesce("kind", "x.k")).select(*t["covers"].columns)}


def _merged(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"covers": t["covers"].join(_survivors(t["covers"]), "id", "left_anti")}


def _renamed(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {"covers": t["covers"].withColumn("name", plain_name(F.col("name")))}


COVER_NAMES = [Step("repoint", _repointed), Step("fill", _filled), Step("merge", _merged), Step("rename", _renamed)]
