"""Catalog reads: browse, facets, existence tests, best and latest rows, indicators and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTS = {
    "popularity": lambda: [F.desc_nulls_last("popularity")],
    "newest": lambda: [F.desc_nulls_last("released")],
    "oldest": lambda: [F.asc_nulls_last("released")],
    "name_asc": lambda: [F.asc("name")],
    "name_desc": lambda: [F.desc("name")],
    "total_adu": lambda: [F.desc("total_adu")],
}


def browse(products: DataFrame, name_like: str | None = None, brands: list[str] | None = None, statuses: list[str] | None = None, size_range: tuple[int, int] | None = None) -> DataFrame:
    """Published products under the filters given; unknown values match nothing."""
    d = products.filter("published")
    if name_like is not None:
        d = d.filter(F.col("name").ilike(f"%{name_like}%"))
    if brands is not None:
        d = d.filter(F.col("brand").isin(*brands))
    if statuses is not None:
        d = d.filter(F.col("status").isin(*statuses))
    if size_range is not None:
        d = d.filter(F.col("size").between(*size_range))
    return d


def ordered(df: DataFrame, sort: str, id_col: str = "product") -> DataFrame:
    """df in one of the known orders, ties by id; an unknown one takes the latest update first, or the id where df has none."""
    latest = [F.desc_nulls_last("updated_at")] if "updated_at" in df.columns else []
    return df.orderBy(*(SORTS[sort]() if sort in SORTS else latest), id_col)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit)


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_semi")


def without_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_anti")


def all_children(parents: DataFrame, children: DataFrame, key: str, holds: Column) -> DataFrame:
    """Parents that have children, all of which satisfy a condition."""
    own = children.groupBy(key).agg(F.every(F.coalesce(holds, F.lit(False))).alias("all_hold")).filter("all_hold")
    return parents.join(own, key, "left_semi")


def count_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 included."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the last row of each key, in one aggregation."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("x")).select(*keys, "x.*")


def in_given_order(df: DataFrame, ids: list[int], key: str, most: int = 6) -> DataFrame:
    """Rows for the first ids asked for, in that order; unknown ones are left out and repeated ones repeat."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids[:most])), f"position int, {key} long")
    return df.join(F.broadcast(asked), key).orderBy("position")


def work_queue(df: DataFrame, checked: str, key: str, limit: int) -> DataFrame:
    """Never checked rows first, then the ones checked longest ago."""
    return df.orderBy(F.asc_nulls_first(checked), key).limit(limit)


def numbered_list(df: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """(key, listing): texts of each key in order, as numbered lines."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    lines = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x[text]))
    return df.groupBy(key).agg(F.array_join(lines, "\n").alias("listing"))


def best_image(products: DataFrame, images: DataFrame) -> DataFrame:
    """products with image: the URL of the first visible image, thumbnails first, then by display order and id; else primary_image_url."""
    order = F.struct((~F.coalesce("is_thumbnail", F.lit(False))).alias("a"), F.coalesce("display_order", F.lit(2**31 - 1)).alias("b"), F.col("id").alias("c"))
    first = images.filter("is_visible").groupBy("product").agg(F.min_by(F.struct("stored_url"), order).alias("__first"))
    return products.join(first, "product", "left").withColumn("image", F.coalesce("__first.stored_url", "primary_image_url")).drop("__first")


def kpis(products: DataFrame, skus: DataFrame, videos: DataFrame, sources: DataFrame, total_adu: DataFrame) -> DataFrame:
    """One row of nine indicators of a catalog; each table is read once.

    products(product, status, core_id, cover_id), skus(product), videos(product, status, summary), sources(product, status,
    is_active), total_adu(product, total_adu).
    """
    having = skus.select("product").distinct().withColumn("__skus", F.lit(True))
    own = products.join(having, "product", "left").join(total_adu.select("product", "total_adu"), "product", "left").agg(
        F.count("*").alias("total_products"), F.count_if(F.col("status") == "current").alias("current_products"), F.count_if(F.col("status") == "retired").alias("retired_products"),
        F.count_if(F.col("core_id").isNull()).alias("missing_core"), F.count_if(F.col("cover_id").isNull()).alias("missing_coverstock"), F.count_if(F.col("__skus").isNull()).alias("missing_skus"),
        F.coalesce(F.sum("total_adu"), F.lit(0.0)).alias("total_catalog_adu"),
    )
    seen = videos.agg(F.count_distinct(F.when((F.col("status") == "approved") & F.col("summary").isNotNull(), F.col("product"))).alias("products_with_video"))
    priced = sources.agg(F.count_distinct(F.when((F.col("status") == "approved") & F.col("is_active"), F.col("product"))).alias("products_with_price_tracking"))
    for row in (seen, priced):
        own = own.join(F.broadcast(row), how="cross")  # rows of one
    return own


def run_counts(outcomes: DataFrame, run: str, succeeded: Column) -> DataFrame:
    """(run, checked, succeeded, failed); an unknown outcome failed."""
    good = F.coalesce(succeeded, F.lit(False))
    return outcomes.groupBy(F.col(run).alias("run")).agg(F.count("*").alias("checked"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))
