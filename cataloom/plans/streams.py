"""Queries that run streams over the tables, each beside the DuckDB SQL of the same rows in one batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..session import work_folder
from ..sources import views as V
from ..streaming import chain as H
from ..streaming import ordered as O
from ..streaming import stock as K
from .queries import query

END = datetime(2100, 1, 1)
#: More than the time that all events of the tables take, so that none is late, in whatever order they come.
LATE = "3650 days"


def _arriving(spark, rows, folder: str, files: int = 6):
    """The rows as files in no order of time, then one row after all of them, which lets the watermark pass the others."""
    rows.repartition(files, F.xxhash64("id")).write.parquet(folder)
    last = rows.limit(0).sparkSession.createDataFrame([(-1, -1, None, END)], "id long, sku long, value string, checked_at timestamp")
    last.write.mode("append").parquet(folder)
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 3).parquet(folder)


def _events(spark, d, value):
    e = V.table(spark, d, "events")
    return e.select(F.col("event_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("sku"), value.cast("string").alias("value"), F.col("ts").cast("timestamp").alias("checked_at"))


def _collected(spark, stream, root: str):
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(f"{V.with_sql('stock')}, x AS (SELECT *, lag(quantity) OVER (PARTITION BY sku ORDER BY checked_at, id) - quantity AS sold FROM stock) SELECT sku, id, CAST(sold AS BIGINT) AS sold FROM x WHERE sold > 0")
def stream_ordered_deltas(spark, d):
    """Units sold by reading, though the readings come in no order."""
    root = work_folder(spark, "deltas")
    quantity = F.when(F.col("event_type") != "error", F.floor("value").cast("int"))
    stream = _arriving(spark, _events(spark, d, quantity), f"{root}/in")
    return _collected(spark, O.ordered_deltas(stream, value="value", late=LATE), root).select(F.col("key").alias("sku"), "id", "sold")


@query(
    "WITH e AS (SELECT event_id AS id, user_id AS sku, event_type AS version, epoch_us(ts) AS seen FROM events), s AS (SELECT *, lag(version) OVER w AS before, seen - lag(seen) OVER w AS gap, lead(seen) OVER w AS next FROM e WINDOW w AS (PARTITION BY sku ORDER BY seen, id)) "
    "SELECT sku, seen, CASE WHEN gap IS NULL OR gap > 43200000000 THEN 'new' WHEN version = before THEN 'unchanged' ELSE 'changed' END AS diff FROM s "
    "UNION ALL SELECT sku, seen + 43200000000, 'gone' FROM s WHERE next IS NULL OR next - seen > 43200000000"
)
def stream_snapshot_diffs(spark, d):
    """Sightings against the last one of their key, and keys not seen for half a day."""
    root = work_folder(spark, "versions")
    stream = _arriving(spark, _events(spark, d, F.col("event_type")), f"{root}/in")
    return _collected(spark, O.snapshot_diffs(stream, "sku", "checked_at", "id", "value", 0.5, LATE), root).select(F.col("key").alias("sku"), F.col("at").alias("seen"), "diff")


@query("SELECT DISTINCT o_custkey, CAST(o_orderkey % 7 AS BIGINT) AS site FROM orders")
def stream_insert_once(spark, d):
    """A key is put in once, over two runs of the query that both read all repeats."""
    root = work_folder(spark, "once")
    rows = V.table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 7).cast("long").alias("site"), F.col("o_orderdate").cast("timestamp").alias("at"))
    rows.repartition(4, F.xxhash64("o_custkey", "at")).write.parquet(f"{root}/in")
    for turn in range(2):
        if turn:
            rows.filter("o_custkey % 2 = 0").coalesce(2).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        O.insert_once(stream, f"{root}/out", ["o_custkey", "site"], "at", "1 day", f"{root}/checkpoint").awaitTermination()
    return O.inserted(spark, f"{root}/out", rows.schema).select("o_custkey", "site")


STAGES = [
    H.Stage("scraped", "found", lambda df: df.filter("p_partkey % 5 > 0").select("p_partkey", "p_name", "p_type", F.concat(F.lit("http://x.test/"), F.col("p_partkey").cast("string")).alias("url"))),
    H.Stage("sheets", "scraped", lambda df: df.filter("p_partkey % 2 = 0").select("p_partkey", F.concat("url", F.lit(".pdf")).alias("link"))),
    H.Stage("images", "scraped", lambda df: df.filter("p_partkey % 3 = 0").select("p_partkey", F.explode(F.array(F.concat("url", F.lit("/1.jpg")), F.concat("url", F.lit("/2.jpg")))).alias("link"))),
    H.Stage("texts", "sheets", lambda df: df.select("p_partkey", F.upper("link").alias("link"))),
]


@query(
    "WITH s AS (SELECT p_partkey, 'http://x.test/' || p_partkey AS url FROM part WHERE p_partkey % 5 > 0) SELECT 'sheets' AS box, p_partkey, url || '.pdf' AS link FROM s WHERE p_partkey % 2 = 0 "
    "UNION ALL SELECT 'images', p_partkey, url || '/' || n || '.jpg' FROM s, (SELECT unnest([1, 2]) AS n) WHERE p_partkey % 3 = 0 UNION ALL SELECT 'texts', p_partkey, upper(url || '.pdf') FROM s WHERE p_partkey % 2 = 0"
)
def stream_chain(spark, d):
    """Scraped pages feed two outboxes, one of which feeds a third; a second pass adds nothing."""
    root = work_folder(spark, "chain")
    part = V.table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    part.repartition(4, "p_partkey").write.parquet(f"{root}/found")
    for _ in range(2):
        boxes = H.run_chain(spark, root, {"found": (f"{root}/found", part.schema)}, STAGES, 2)
    rows = [boxes[k].select(F.lit(k).alias("box"), "p_partkey", "link") for k in ("sheets", "images", "texts")]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"{V.with_sql('stock')} SELECT CAST(checked_at AS DATE) AS dd, count(*) AS readings, count(quantity) AS known FROM stock GROUP BY 1")
def stream_daily_counts(spark, d):
    root = work_folder(spark, "daily")
    rows = V.stock_history(spark, d).select(F.col("id").cast("long").alias("id"), F.col("sku").cast("long").alias("sku"), "quantity", "checked_at")
    rows.repartition(4, "id").write.parquet(f"{root}/in")
    spark.createDataFrame([(-1, -1, None, END)], K.READING).write.mode("append").parquet(f"{root}/in")
    return _collected(spark, K.daily_counts(K.readings(spark, f"{root}/in", 2), LATE), root).filter(F.col("dd") < F.lit(END.date()))


@query(f"{V.with_sql('stock')} SELECT sku, arg_max(quantity, (checked_at, id)) AS quantity FROM stock WHERE id % 10 > 0 AND quantity IS NOT NULL GROUP BY sku")
def stream_last_readings(spark, d):
    """The keyed sink keeps each SKU's last reading; rows that fail the rule are rejected."""
    root = work_folder(spark, "last")
    rows = V.stock_history(spark, d).filter("quantity IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("sku").cast("long").alias("sku"), "quantity", "checked_at")
    rows.repartition(4, "id").write.parquet(f"{root}/in")
    stream = K.readings(spark, f"{root}/in", 2).withColumn("seen", F.struct("checked_at", "id"))
    K.merged_into(stream, f"{root}/out", ["sku"], "seen", f"{root}/checkpoint", f"{root}/rejects", F.col("id") % 10 > 0).awaitTermination()
    return K.merged(spark, f"{root}/out").select("sku", "quantity")
