"""File sources and sinks: history by day, training rows as JSON lines, sitemaps of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import stripped


def append_history(rows: DataFrame, path: str, time: str, run: str, unit: str = "day") -> None:
    """Adds the rows of a run to a history by day or month. A run done again replaces its own rows of the periods it writes, and no others."""
    parts = rows.withColumn("period", F.to_date(F.date_trunc(unit, time))).withColumn("run", F.lit(run))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "run").parquet(path)


def history(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows of the periods that begin from first to last; other periods' files aren't read."""
    d = spark.read.option("basePath", path).parquet(path)
    if first is not None:
        d = d.filter(F.col("period") >= F.lit(first).cast("date"))
    if last is not None:
        d = d.filter(F.col("period") <= F.lit(last).cast("date"))
    return d


def write_json_lines(df: DataFrame, path: str) -> None:
    """A document a line; unknown values are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sitemap_files(spark: SparkSession, path: str, path_pattern: str) -> DataFrame:
    """As extract.sitemap, from files of any size: records end at the end tags of url elements, so Spark splits a file between them."""
    records = spark.read.text(path, lineSep="</url>").select(F.regexp_extract("value", r"(?s)<url\b[^>]*>(.*)$", 1).alias("inner")).filter("inner <> ''")
    x = F.from_xml(F.concat(F.lit("<url>"), "inner", F.lit("</url>")), F.lit("loc string, lastmod string"), {"ignoreNamespace": "true"})
    rows = records.select(x.alias("x")).select("x.*")
    url = stripped(F.col("loc"))
    return rows.select(url.alias("url"), F.regexp_extract(url, path_pattern, 1).alias("status"), stripped(F.col("lastmod")).alias("lastmod")).filter(F.col("url").rlike(path_pattern))
