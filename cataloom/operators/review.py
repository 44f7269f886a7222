"""Reconciliation against other sources, review rows, and updates that depend on rows elsewhere."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge

# Names of custom fields in the order in which they are tried.
FIELD_NAMES = {
    "rg": ("radius of gyration(15lb)", "radius of gyration", "rg", "core rg"),
    "differential": ("max differential(15lb)", "max differential", "diff", "differential", "core diff"),
    "mass_bias": ("int. differential(15lb)", "int. differential", "mb", "mass bias", "mb diff", "mass bias differential"),
}
REFERENCE_WEIGHT = 15
SHORTEST_VIDEO = 61


def custom_field(fields: Column, candidates: tuple[str, ...]) -> Column:
    """The value of the first field (array<struct<k, v>>) whose name begins with the first candidate that any name begins with."""
    hits = F.transform(F.array(*map(F.lit, candidates)), lambda c: F.filter(fields, lambda f: F.startswith(f["k"], c)))
    return F.get(F.flatten(hits), F.lit(0))["v"]


def variant_weight(options: Column) -> Column:
    """The number in the label of the option (struct<name, label>) named by weight, else of the only option; else null."""
    named = F.get(F.filter(options, lambda o: F.contains(F.lower(F.coalesce(o["name"], F.lit(""))), F.lit("weight"))), F.lit(0))
    chosen = F.coalesce(named, F.when(F.size(options) == 1, F.get(options, F.lit(0))))
    return F.nullif(F.regexp_extract(chosen["label"], r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def spec_mismatches(ours: DataFrame, theirs: DataFrame, keys: list[str], fields: tuple[str, ...], tolerance: float = 0.001) -> DataFrame:
    """(keys without weight_lbs, field_name such as rg_15lb, current_value, proposed_value) of SKUs that both sides have.

    A value that a side doesn't know can't disagree; nor can a weight that only one side has.
    """
    found = merge.tolerance_review(ours, theirs, [*keys, "weight_lbs"], list(fields), tolerance)
    return found.select(*keys, F.concat("field_name", F.lit("_"), F.col("weight_lbs").cast("string"), F.lit("lb")).alias("field_name"), "current_value", "proposed_value")


def weight_mismatches(ours: DataFrame, theirs: DataFrame, key: str = "product") -> DataFrame:
    """(key, weight_lbs, field_name) for the weights of products that both list but of which only one side has a SKU."""
    both = ours.select(key).distinct().join(theirs.select(key).distinct(), key)
    a = ours.select(key, "weight_lbs").withColumn("a", F.lit(True))
    b = theirs.select(key, "weight_lbs").withColumn("b", F.lit(True))
    j = a.join(b, [key, "weight_lbs"], "full").filter("a is null or b is null").join(both, key, "left_semi")
    name = F.when(F.col("b").isNull(), "sku_weight_missing_in_bigcommerce").otherwise("sku_weight_missing_in_our_catalog")
    return j.select(key, "weight_lbs", name.alias("field_name"))


def discovery_entries(found: DataFrame, slug_col: str, retired: Column, updated: str, order: list[str]) -> DataFrame:
    """(slug, status, lastmod): current if any listing that isn't retired has it; lastmod of the last listing."""
    place = F.struct(*order)
    return found.groupBy(F.col(slug_col).alias("slug")).agg(
        F.when(F.bool_or(~retired), "current").otherwise("retired").alias("status"), F.max_by(updated, place).alias("lastmod")
    )


def replace_children(old: DataFrame, new: DataFrame, parent: str, key: str, policy: dict[str, str], delete: bool = True) -> DataFrame:
    """old with new merged in by (parent, key); with delete, rows of a scraped parent that the scrape lacks are gone."""
    merged = merge.upsert(old, new, [parent, key], policy)
    if not delete:
        return merged
    scraped = new.select(parent).distinct().withColumn("scraped", F.lit(True))
    live = new.select(parent, key).withColumn("live", F.lit(True))
    j = merged.join(scraped, parent, "left").join(live, [parent, key], "left")
    return j.filter("scraped is null or live").drop("scraped", "live")


def refresh_stats(videos: DataFrame, stats: DataFrame, values: list[str], as_of: datetime) -> DataFrame:
    """videos(id, status, values.., fetched_at, resolved_at) with stats by id; those asked for without an answer get only the time.

    stats has a row for each id asked for; answered tells whether there was one. Short videos are rejected; the time of an
    earlier rejection stays.
    """
    now = F.lit(as_of).cast("timestamp")
    s = stats.select(F.col("id").alias("sid"), "answered", *[F.col(v).alias(f"new_{v}") for v in values])
    j = videos.join(s, videos["id"] == F.col("sid"), "left")
    got = F.coalesce(F.col("answered"), F.lit(False))
    short = got & (F.col("new_duration_seconds") < SHORTEST_VIDEO) & (F.col("status") != "rejected")
    made = {v: F.when(got, F.col(f"new_{v}")).otherwise(F.col(v)) for v in values}
    made |= {"fetched_at": F.when(F.col("sid").isNotNull(), now).otherwise(F.col("fetched_at")), "resolved_at": F.when(short, now).otherwise(F.col("resolved_at")), "status": F.when(short, "rejected").otherwise(F.col("status"))}
    return j.withColumns(made).select(*videos.columns)


def reassign(videos: DataFrame, moves: DataFrame, backfill: list[str]) -> DataFrame:
    """videos(product, video, status, ..) after moves(product, video, target); a row may be moved once.

    The row that moves stays as rejected, so that it isn't found again. The target gets a copy, or, where it has the video,
    the backfill columns that it lacks; its status stays as it is. A move to the same product changes nothing.
    """
    m = moves.filter("product <> target")
    origin = videos.join(m, ["product", "video"])
    copies = origin.select(F.col("target").alias("product"), *[c for c in videos.columns if c != "product"])
    left = videos.join(m.withColumn("moved", F.lit(True)).drop("target"), ["product", "video"], "left")
    left = left.withColumn("status", F.when(F.col("moved"), "rejected").otherwise(F.col("status"))).select(*videos.columns)
    keep = {c: merge.OLD_ELSE_NEW if c in backfill else merge.KEEP for c in videos.columns}
    return merge.upsert(left, copies, ["product", "video"], keep).select(*videos.columns)


def exclusive_flag(rows: DataFrame, chosen: DataFrame, parent: str, key: str, flag: str) -> DataFrame:
    """rows with the flag set on the chosen(parent, key) and cleared on the others of these parents."""
    c = chosen.select(F.col(parent).alias("__p"), F.col(key).alias("__k"))
    j = rows.join(c, rows[parent] == F.col("__p"), "left")
    return j.withColumn(flag, F.when(F.col("__p").isNull(), F.col(flag)).otherwise(F.col(key) == F.col("__k"))).drop("__p", "__k")


def reorder(rows: DataFrame, orders: DataFrame, parent: str, key: str) -> DataFrame:
    """rows with display_order from orders(parent, ids): the place in the list; rows not listed keep theirs."""
    at = orders.select(parent, F.posexplode("ids").alias("__at", key))
    return rows.join(at, [parent, key], "left").withColumn("display_order", F.coalesce("__at", "display_order")).drop("__at")


def repair_urls(sources: DataFrame, found: DataFrame) -> DataFrame:
    """sources(id, product, site, url, status, active, created_at) with the URL of found(product, site, url) on one row a pair.

    That row is an approved and active one, else the oldest. A pair without a row gets a pending one without id.
    """
    best = F.struct((~((F.col("status") == "approved") & F.col("active"))).alias("b"), "created_at", "id")
    first = sources.groupBy("product", "site").agg(F.min_by("id", best).alias("__first"))
    j = sources.join(first, ["product", "site"]).join(found.withColumnRenamed("url", "__url"), ["product", "site"], "left")
    fixed = j.withColumn("url", F.when((F.col("id") == F.col("__first")) & F.col("__url").isNotNull(), F.col("__url")).otherwise(F.col("url"))).select(*sources.columns)
    new = found.join(first, ["product", "site"], "left_anti")
    given = {"product": F.col("product"), "site": F.col("site"), "url": F.col("url"), "status": F.lit("pending"), "active": F.lit(True)}
    return fixed.unionByName(new.select(*[given.get(c, F.lit(None)).cast(sources.schema[c].dataType).alias(c) for c in sources.columns]))


def next_ordinals(old: DataFrame, new: DataFrame, parent: str, order: list[str], at: str = "display_order") -> DataFrame:
    """new with ordinals that go on after the largest of old, in order."""
    top = old.groupBy(parent).agg(F.max(at).alias("__top"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return new.join(top, parent, "left").withColumn(at, F.coalesce(F.col("__top"), F.lit(-1)) + place).drop("__top")


def review_field(name: Column) -> Column:
    """(scope, column, weight_lbs) that a review's field name stands for; null if it may not be written."""
    shape = r"^(rg|differential|mass_bias)_(\d{1,2})lb$"
    sku = F.struct(F.lit("sku").alias("scope"), F.regexp_extract(name, shape, 1).alias("column"), F.regexp_extract(name, shape, 2).try_cast("int").alias("weight_lbs"))
    product = F.struct(F.lit("product").alias("scope"), name.alias("column"), F.lit(None).cast("int").alias("weight_lbs"))
    return F.when(name.rlike(shape), sku).when(name.isin(*UPDATABLE), product)


def resolve(rows: DataFrame, actions: DataFrame, as_of: datetime, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows(key, status, reason, resolved_at, resolved_by) after actions(key, action, by, note), actions that couldn't be taken).

    approve and reject take pending rows, restore takes resolved ones and clears who resolved them and when. A rejection is
    added to the reasons. Rejected actions carry why: of an unknown row, not allowed in its status, or one of several for a row.
    """
    now = F.lit(as_of).cast("timestamp")
    a = actions.select(key, "action", "by", "note")
    several = a.groupBy(key).agg((F.count("*") > 1).alias("__several"))
    j = a.join(several, key).join(rows.select(key, F.col("status").alias("__status")).withColumn("__known", F.lit(True)), key, "left")
    legal = merge.review(F.col("__status"), F.col("action"))
    why = F.when(F.col("__known").isNull(), "unknown row").when(F.col("__several"), "several actions").when(legal.isNull(), F.concat(F.lit("not allowed when "), F.coalesce("__status", F.lit("unknown"))))
    judged = j.select(key, "action", "by", "note", legal.alias("__to"), why.alias("why"))
    good = judged.filter("why IS NULL").select(key, "action", "by", "note", "__to")
    d = rows.join(good, key, "left")
    said = F.concat(F.lit("Rejected"), F.coalesce(F.concat(F.lit(": "), F.nullif("note", F.lit(""))), F.lit("")))
    acted, back = F.col("__to").isNotNull(), F.coalesce(F.col("action") == "restore", F.lit(False))
    made = {
        "status": F.coalesce("__to", "status"),
        "reason": F.when(F.col("action") == "reject", F.concat(F.coalesce(F.concat("reason", F.lit(" | ")), F.lit("")), said)).otherwise(F.col("reason")),
        "resolved_at": F.when(acted & ~back, now).when(~acted, F.col("resolved_at")),
        "resolved_by": F.when(acted & ~back, F.col("by")).when(~acted, F.col("resolved_by")),
    }
    return d.select(*(made[c].alias(c) if c in made else F.col(c) for c in rows.columns)), judged.filter("why IS NOT NULL").select(key, "action", "why")


def release_mismatches(ours: DataFrame, theirs: DataFrame, key: str = "product") -> DataFrame:
    """(key, field_name, current_value, proposed_value) where both sides know a release date and they differ."""
    t = theirs.select(key, F.col("release_date").alias("__theirs"))
    j = ours.join(t, key).filter(F.col("release_date") != F.col("__theirs"))
    return j.select(key, F.lit("release_date").alias("field_name"), F.col("release_date").cast("string").alias("current_value"), F.col("__theirs").cast("string").alias("proposed_value"))


def match_states(products: DataFrame, matches: DataFrame, key: str = "product") -> DataFrame:
    """(key, state): matched if one listing was found, ambiguous if several, else not_yet_listed; matches(key, listing)."""
    n = matches.groupBy(key).agg(F.count_distinct("listing").alias("__n"))
    state = F.when(F.col("__n") == 1, "matched").when(F.col("__n") > 1, "ambiguous").otherwise("not_yet_listed")
    return products.select(key).join(n, key, "left").select(key, state.alias("state"))


def exact_accuracy(products: DataFrame, matches: DataFrame, ours: DataFrame, listed: DataFrame, fields: tuple[str, ...], tolerance: float = 0.001, key: str = "product") -> DataFrame:
    """Mismatches at the reference weight between our SKUs and the listings of products matched to exactly one.

    listed(listing, fields..): what a listing states for the reference weight. An unknown value on a side can't disagree.
    """
    sure = match_states(products, matches, key).filter("state = 'matched'").select(key)
    theirs = matches.join(sure, key, "left_semi").select(key, "listing").distinct().join(listed, "listing").withColumn("weight_lbs", F.lit(REFERENCE_WEIGHT))
    return spec_mismatches(ours.filter(F.col("weight_lbs") == REFERENCE_WEIGHT), theirs, [key], fields, tolerance)


def backfill_first(products: DataFrame, history: DataFrame, column: str, time: str, key: str = "product") -> DataFrame:
    """products with the earliest time of their history in a column that is unknown; known values and products without history stay."""
    first = history.groupBy(key).agg(F.min(time).alias("__first"))
    return products.join(first, key, "left").select(*(F.coalesce(c, "__first").alias(c) if c == column else F.col(c) for c in products.columns))


def correct_status(products: DataFrame, found: DataFrame, platform: str) -> DataFrame:
    """products(url, source_platform, status, ..) of one platform with the status that discovery found for their URL; found(url, status)."""
    f = found.select("url", F.col("status").alias("__found"))
    j = products.join(f, "url", "left")
    right = (F.col("source_platform") == platform) & F.col("__found").isNotNull()
    return j.select(*(F.when(right, F.col("__found")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in products.columns))


# Product fields that reviews may change.
UPDATABLE = ("name", "color", "coverstock_material", "coverstock_type", "coverstock_name", "factory_finish", "part_number", "published")
