"""Catalog-shaped views over the star-schema tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that queries over the test tables count back from; nothing reads the clock.
STOCK_AS_OF = datetime(2024, 1, 31)
SALES_AS_OF = datetime(2001, 12, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores: a small file makes few tasks, too few for rows that cost much time each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def stock_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings (id, sku, quantity, checked_at) of the stock of each SKU; failed checks have no quantity."""
    e = table(spark, sf_dir, "events")
    quantity = F.when(F.col("event_type") != "error", F.floor("value").cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("sku"), quantity.alias("quantity"), F.col("ts").cast("timestamp").alias("checked_at"))


def skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku, product, weight_lbs)."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("sku")).distinct()
    return u.select("sku", F.floor(F.col("sku") / 3).cast("long").alias("product"), (F.col("sku") % 3 + 13).cast("int").alias("weight_lbs"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, name, brand, cover, size, price, status, published)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("cover"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(k % 3 != 0, "current").otherwise("retired").alias("status"), (k % 5 != 0).alias("published"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, order_id, line_id, view_count, published_at, review)."""
    x = table(spark, sf_dir, "lineitem")
    review = F.when(F.col("l_returnflag") == "N", "approved").when(F.col("l_returnflag") == "A", "pending").otherwise("rejected")
    return x.select(
        F.col("l_partkey").alias("product"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"),
        F.floor("l_extendedprice").cast("long").alias("view_count"), F.col("l_shipdate").cast("timestamp").alias("published_at"), review.alias("review"),
    )


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product, site, price, checked_at, order_id, line_id)."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("site"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").cast("timestamp").alias("checked_at"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_id"),
    )


# The same views for DuckDB, to stand at the head of a query.
SQL = {
    "stock": "stock AS (SELECT event_id AS id, user_id AS sku, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS quantity, ts AS checked_at FROM events)",
    "skus": "skus AS (SELECT DISTINCT user_id AS sku, CAST(floor(user_id / 3) AS BIGINT) AS product, CAST(user_id % 3 + 13 AS INT) AS weight_lbs FROM events)",
    "products": "products AS (SELECT p_partkey AS product, p_name AS name, p_brand AS brand, p_type AS cover, p_size AS size, p_retailprice AS price, CASE WHEN p_partkey % 3 <> 0 THEN 'current' ELSE 'retired' END AS status, p_partkey % 5 <> 0 AS published FROM part)",
    "videos": "videos AS (SELECT l_partkey AS product, l_orderkey AS order_id, l_linenumber AS line_id, CAST(floor(l_extendedprice) AS BIGINT) AS view_count, l_shipdate AS published_at, CASE l_returnflag WHEN 'N' THEN 'approved' WHEN 'A' THEN 'pending' ELSE 'rejected' END AS review FROM lineitem)",
    "prices": "prices AS (SELECT l_partkey AS product, l_suppkey AS site, l_extendedprice / l_quantity AS price, l_shipdate AS checked_at, l_orderkey AS order_id, l_linenumber AS line_id FROM lineitem)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
