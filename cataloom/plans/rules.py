"""Queries of sheets, classes, images, indicators, reviews and backfills, with unknown and malformed input, each beside its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import inventory as I
from ..operators import merge as G
from ..operators import ranking as R
from ..operators import review as W
from ..sources import extract as X
from ..sources import tables as B
from ..sources import views as V
from .queries import ESTIMATE, SALES, SPECS, STOCK_DAYS, STOCK_SKUS, TOTALS, _specs, query

NOW = datetime(2024, 5, 1)


def _part(spark, d):
    return V.table(spark, d, "part")


# ---- sheets


@query(
    "SELECT p_partkey, w::INT AS weight_lbs, CASE WHEN p_partkey % 4 = 0 AND w = 16 THEN NULL ELSE round(2 + p_size / 100.0, 2)::DOUBLE END AS rg, CASE WHEN p_partkey % 3 = 0 AND w = 16 THEN NULL WHEN p_partkey % 3 = 1 AND w = 15 THEN NULL ELSE round(0.01 + p_size / 1000.0, 3)::DOUBLE END AS differential "
    "FROM part, (SELECT unnest([16, 15]) AS w) WHERE p_partkey % 5 > 0 AND NOT (w = 16 AND p_partkey % 12 = 0)"
)
def sheet_numbers(spark, d):
    """Numbers need digits on both sides of the point; words between two weights make no header."""
    k = F.col("p_partkey")
    rg, diff = F.format_string("%.2f", F.lit(2) + F.col("p_size") / 100), F.format_string("%.3f", F.lit(0.01) + F.col("p_size") / 1000)
    words = F.lit("A 16 lb ball and a 15 lb ball")
    head = F.when(k % 5 == 0, F.lit("from 14 lb to 12 lb")).when(k % 2 == 0, F.lit("16 lbs, 15 lbs")).otherwise(F.lit("Weights 16 lb 15 lbs etc"))
    first = F.when(k % 4 == 0, F.lit("2")).otherwise(rg)
    a, b = F.when(k % 3 == 0, F.lit(".050")).otherwise(diff), F.when(k % 3 == 1, F.lit("n/a")).otherwise(diff)
    text = F.concat_ws("\n", words, head, F.concat(F.lit("RG "), first, F.lit(" "), rg), F.concat(F.lit("DIFF "), a, F.lit(" "), b))
    return _part(spark, d).select("p_partkey", F.inline(B.weight_table(text))).select("p_partkey", "weight_lbs", "rg", "differential")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_name END END AS core FROM part")
def first_attribute_table(spark, d):
    """The first table with four known labels, not the one with most."""
    labels = ("core", "cover", "color", "weight", "finish")
    row = lambda k, v: F.array(F.lit(k), v)
    pad = [row(x, F.lit("x")) for x in ("Cover", "COLOR", "weight")]
    four, five = F.array(row("core", F.col("p_brand")), *pad), F.array(row("core", F.col("p_name")), *pad, row("finish", F.lit("y")))
    few = F.array(row("core", F.lit("none")), *pad[:2], row("other", F.lit("z")))
    k = F.col("p_partkey") % 3
    tables = F.when(k == 1, F.array(few, four, five)).when(k == 2, F.array(few, five, four)).otherwise(F.array(few))
    return _part(spark, d).select("p_partkey", B.spec_fields(B.first_table(tables, labels), labels)["core"].alias("core"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END END AS rg, CASE WHEN p_size % 4 > 0 THEN 2 ELSE 0 END AS n FROM part")
def custom_field_maps(spark, d):
    """Names differ in case and white space; of equal ones the last counts, and a field without a name is none."""
    field = lambda k, v: F.struct(F.lit(k).cast("string").alias("name"), v.alias("value"))
    last = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    given = F.array(field(" RG", F.lit("1")), field("Diff", F.lit("2")), field(None, F.lit("3")), field("rg ", last))
    m = X.custom_fields(F.when(F.col("p_size") % 4 > 0, given).otherwise(F.filter(given, lambda f: F.lit(False))))
    return _part(spark, d).select("p_partkey", m["rg"].alias("rg"), F.size(m).alias("n"))


# ---- classes from two fields

NAMES = "CASE p_size % 4 WHEN 0 THEN 'HK Pearl' WHEN 1 THEN 'Urethane Solid' WHEN 2 THEN '' END"
KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'Solid Reactive' WHEN 1 THEN 'Plastic' WHEN 2 THEN 'Urethane' END"
MATERIAL = "CASE WHEN {x} LIKE '%urethane%' THEN 'urethane' WHEN {x} LIKE '%polyester%' OR {x} LIKE '%plastic%' THEN 'polyester_plastic' WHEN {x} LIKE '%reactive%' THEN 'reactive_resin' END"
COVER = "CASE WHEN {x} LIKE '%solid%' THEN 'solid' WHEN {x} LIKE '%pearl%' THEN 'pearl' WHEN {x} LIKE '%hybrid%' THEN 'hybrid' END"


@query(f"WITH x AS (SELECT p_partkey, lower({NAMES}) AS n, lower({KINDS}) AS k, lower(coalesce({NAMES}, '') || ' ' || coalesce({KINDS}, '')) AS b FROM part) SELECT p_partkey, {MATERIAL.format(x='k')} AS woo_material, {COVER.format(x='n')} AS woo_type, {MATERIAL.format(x='b')} AS shopify_material, {COVER.format(x='b')} AS shopify_type FROM x")
def cover_classes_of_two_fields(spark, d):
    """One platform takes the material from one field and the type from the other, one looks for both in both."""
    n, k = F.expr(NAMES), F.expr(KINDS)
    woo, shopify = T.cover_class("woo", n, k), T.cover_class("shopify", n, k)
    return _part(spark, d).select("p_partkey", woo["material"].alias("woo_material"), woo["type"].alias("woo_type"), shopify["material"].alias("shopify_material"), shopify["type"].alias("shopify_type"))


# ---- images, order, indicators


@query(
    "WITH i AS (SELECT o_orderkey AS id, o_custkey AS product, o_orderkey % 4 > 0 AS is_visible, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 = 1 END AS is_thumbnail, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS display_order, CASE WHEN o_orderkey % 3 > 0 THEN 'i' || o_orderkey END AS url FROM orders), "
    "b AS (SELECT DISTINCT ON (product) product, url FROM i WHERE is_visible ORDER BY product, coalesce(is_thumbnail, false) DESC, display_order NULLS LAST, id) SELECT c_custkey AS product, coalesce(b.url, CASE WHEN c_custkey % 2 = 0 THEN 'main' END) AS image FROM customer LEFT JOIN b ON product = c_custkey"
)
def best_images(spark, d):
    """Hidden images don't count; the first one decides even if it isn't stored."""
    k = F.col("o_orderkey")
    images = V.table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("product"), (k % 4 > 0).alias("is_visible"), F.when(k % 7 > 0, k % 7 == 1).alias("is_thumbnail"), F.when(k % 5 > 0, k % 5).alias("display_order"), F.when(k % 3 > 0, F.concat(F.lit("i"), k.cast("string"))).alias("stored_url"))
    products = V.table(spark, d, "customer").select(F.col("c_custkey").alias("product"), F.when(F.col("c_custkey") % 2 == 0, "main").alias("primary_image_url"))
    return C.best_image(products, images).select("product", "image")


@query(f"{STOCK_SKUS}, {TOTALS} SELECT product, round(total_adu, 6) AS total_adu FROM totals ORDER BY totals.total_adu DESC, product LIMIT 10")
def products_by_total_adu(spark, d):
    totals = I.product_adu(V.stock_history(spark, d), V.skus(spark, d), V.STOCK_AS_OF, STOCK_DAYS)
    return C.page(C.ordered(totals, "total_adu"), 10).select("product", F.round("total_adu", 6).alias("total_adu"))


@query(
    "WITH v AS (SELECT l_partkey AS product, CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate END AS published_at, l_receipt AS created_at, floor(l_extendedprice)::BIGINT AS view_count FROM (SELECT *, l_shipdate + INTERVAL 5 DAY AS l_receipt FROM lineitem) WHERE l_returnflag = 'N' AND l_linenumber % 5 > 0) "
    f"SELECT product, round(avg(view_count * pow(2.0, -((epoch_us({SALES}) - epoch_us(coalesce(published_at, created_at))) / 86400000000.0) / 180.0)) * ln(1 + count(*)), 4) AS popularity FROM v GROUP BY product"
)
def popularity_by_creation(spark, d):
    """Videos without a publication time age from their creation; those without a view count are left out."""
    x, n = V.table(spark, d, "lineitem").filter("l_returnflag = 'N'"), F.col("l_linenumber")
    ship = F.col("l_shipdate").cast("timestamp")
    videos = x.select(F.col("l_partkey").alias("product"), F.when(n % 3 > 0, ship).alias("published_at"), (ship + F.make_dt_interval(F.lit(5))).alias("created_at"), F.when(n % 5 > 0, F.floor("l_extendedprice").cast("long")).alias("view_count"), F.lit("approved").alias("review"))
    return R.popularity(videos, V.SALES_AS_OF).select("product", F.round("popularity", 4).alias("popularity"))


@query(
    f"{STOCK_SKUS}, {TOTALS}, p AS (SELECT p_partkey AS product, CASE p_partkey % 3 WHEN 0 THEN 'retired' WHEN 1 THEN 'current' END AS status, CASE WHEN p_size % 4 > 0 THEN p_size END AS core_id, CASE WHEN p_size % 5 > 0 THEN p_size END AS cover_id FROM part) "
    "SELECT count(*) AS total_products, count(*) FILTER (status = 'current') AS current_products, count(*) FILTER (status = 'retired') AS retired_products, count(*) FILTER (core_id IS NULL) AS missing_core, count(*) FILTER (cover_id IS NULL) AS missing_coverstock, "
    "count(*) FILTER (product NOT IN (SELECT product FROM skus)) AS missing_skus, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber % 3 > 0) AS products_with_video, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS products_with_price_tracking, "
    "round((SELECT coalesce(sum(total_adu), 0) FROM totals WHERE product IN (SELECT product FROM p)), 6) AS total_catalog_adu FROM p"
)
def kpi_row(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    products = _part(spark, d).select(k.alias("product"), F.when(k % 3 == 0, "retired").when(k % 3 == 1, "current").alias("status"), F.when(size % 4 > 0, size).alias("core_id"), F.when(size % 5 > 0, size).alias("cover_id"))
    x, o = V.table(spark, d, "lineitem"), V.table(spark, d, "orders")
    videos = x.select(F.col("l_partkey").alias("product"), F.when(F.col("l_returnflag") == "N", "approved").otherwise("pending").alias("status"), F.when(F.col("l_linenumber") % 3 > 0, "s").alias("summary"))
    sources = o.select(F.col("o_custkey").alias("product"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("is_active"))
    skus = V.skus(spark, d)
    return C.kpis(products, skus, videos, sources, I.product_adu(V.stock_history(spark, d), skus, V.STOCK_AS_OF, STOCK_DAYS)).withColumn("total_catalog_adu", F.round("total_catalog_adu", 6))


# ---- platform policies

SIDES = (
    "o AS (SELECT 'u' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'retired' END AS status, CASE WHEN p_size % 3 > 0 THEN p_name END AS description, 'w' || p_size AS weights_available, CASE WHEN p_partkey % 2 = 1 THEN TIMESTAMP '2020-01-01' END AS discontinued_detected_at FROM part WHERE p_size < 35), "
    "n AS (SELECT 'u' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'current' ELSE 'retired' END AS status, CASE WHEN p_size % 2 > 0 THEN p_type END AS description, CASE WHEN p_size % 5 > 0 THEN 'new' END AS weights_available FROM part WHERE p_size > 15)"
)


def _upserted(spark, d, platform):
    p, k, size = _part(spark, d), F.col("p_partkey"), F.col("p_size")
    url = F.concat(F.lit("u"), k.cast("string")).alias("url")
    old = p.filter("p_size < 35").select(url, F.when(k % 2 == 0, "current").otherwise("retired").alias("status"), F.when(size % 3 > 0, F.col("p_name")).alias("description"), F.concat(F.lit("w"), size.cast("string")).alias("weights_available"), F.when(k % 2 == 1, F.lit(datetime(2020, 1, 1))).alias("discontinued_detected_at"))
    new = p.filter("p_size > 15").select(url, F.when(k % 3 == 0, "current").otherwise("retired").alias("status"), F.when(size % 2 > 0, F.col("p_type")).alias("description"), F.when(size % 5 > 0, "new").alias("weights_available"))
    return G.upsert_products(old, new, platform, NOW)


BOTH = "coalesce(n.status, o.status) AS status, coalesce(n.description, o.description) AS description"


@query(f"WITH {SIDES} SELECT url, {BOTH}, CASE WHEN n.url IS NULL THEN o.weights_available ELSE n.weights_available END AS weights_available, CASE WHEN n.status = 'retired' AND coalesce(o.status, '') <> 'retired' THEN TIMESTAMP '2024-05-01' WHEN n.status = 'current' THEN NULL ELSE o.discontinued_detected_at END AS discontinued_detected_at FROM o FULL JOIN n USING (url)")
def upsert_marks_retired(spark, d):
    return _upserted(spark, d, "craft")


@query(f"WITH {SIDES} SELECT url, {BOTH}, o.weights_available, o.discontinued_detected_at FROM o FULL JOIN n USING (url)")
def upsert_leaves_columns(spark, d):
    """The platform that doesn't know two of the columns leaves them."""
    return _upserted(spark, d, "commercebuild")


@query(
    "WITH o AS (SELECT p_partkey AS product, p_size / 10 AS rg, CASE WHEN p_partkey % 2 = 0 THEN 0.01 END AS mass_bias FROM part WHERE p_size < 35), n AS (SELECT p_partkey AS product, CASE WHEN p_size % 4 > 0 THEN p_size / 20 END AS rg, CASE WHEN p_partkey % 3 = 0 THEN 0.02 END AS mass_bias FROM part WHERE p_size > 15) "
    "SELECT product, 15::INT AS weight_lbs, CASE WHEN n.product IS NULL THEN o.rg ELSE n.rg END AS rg, coalesce(n.mass_bias, o.mass_bias)::DOUBLE AS mass_bias, CASE WHEN n.product IS NULL THEN 'html' ELSE 'pdf' END AS source FROM o FULL JOIN n USING (product)"
)
def upsert_skus_with_source(spark, d):
    """On one platform the source changes with the numbers."""
    p, k, size = _part(spark, d), F.col("p_partkey"), F.col("p_size")
    old = p.filter("p_size < 35").select(k.alias("product"), F.lit(15).alias("weight_lbs"), (size / 10).alias("rg"), F.when(k % 2 == 0, 0.01).alias("mass_bias"), F.lit("html").alias("source"))
    new = p.filter("p_size > 15").select(k.alias("product"), F.lit(15).alias("weight_lbs"), F.when(size % 4 > 0, size / 20).alias("rg"), F.when(k % 3 == 0, 0.02).alias("mass_bias"), F.lit("pdf").alias("source"))
    return G.upsert_skus(old, new, "commercebuild")


# ---- reviews

REVIEWS = (
    "r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN p_size % 2 = 0 THEN 'seen' END AS reason, CASE WHEN p_partkey % 4 < 2 THEN TIMESTAMP '2020-01-01' END AS resolved_at, CASE WHEN p_partkey % 4 < 2 THEN 'x' END AS resolved_by FROM part), "
    "a AS (SELECT p_partkey + 3 AS id, CASE p_size % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'restore' ELSE 'burn' END AS action, 'al' AS by_, CASE WHEN p_size % 3 = 0 THEN 'bad' WHEN p_size % 3 = 1 THEN '' END AS note FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey + 3, 'approve', 'bo', NULL FROM part WHERE p_partkey % 25 = 1), "
    "j AS (SELECT a.*, r.status, count(*) OVER (PARTITION BY a.id) > 1 AS several, r.id IS NULL AS missing FROM a LEFT JOIN r USING (id)), "
    "w AS (SELECT *, CASE WHEN status = 'pending' AND action = 'approve' THEN 'approved' WHEN status = 'pending' AND action = 'reject' THEN 'rejected' WHEN status <> 'pending' AND action = 'restore' THEN 'pending' END AS to_ FROM j)"
)


def _resolved(spark, d):
    p, k, size = _part(spark, d), F.col("p_partkey"), F.col("p_size")
    old = F.when(k % 4 < 2, F.lit(datetime(2020, 1, 1)))
    rows = p.select(k.alias("id"), F.when(k % 4 == 0, "approved").when(k % 4 == 1, "rejected").otherwise("pending").alias("status"), F.when(size % 2 == 0, "seen").alias("reason"), old.alias("resolved_at"), F.when(k % 4 < 2, "x").alias("resolved_by"))
    action = F.when(size % 4 == 0, "approve").when(size % 4 == 1, "reject").when(size % 4 == 2, "restore").otherwise("burn")
    actions = p.filter("p_partkey % 5 > 0").select((k + 3).alias("id"), action.alias("action"), F.lit("al").alias("by"), F.when(size % 3 == 0, "bad").when(size % 3 == 1, "").alias("note"))
    again = p.filter("p_partkey % 25 = 1").select((k + 3).alias("id"), F.lit("approve").alias("action"), F.lit("bo").alias("by"), F.lit(None).cast("string").alias("note"))
    return W.resolve(rows, actions.union(again), NOW)


@query(
    f"WITH {REVIEWS}, g AS (SELECT * FROM w WHERE to_ IS NOT NULL AND NOT several) SELECT id, coalesce(g.to_, r.status) AS status, CASE WHEN action = 'reject' THEN coalesce(reason || ' | ', '') || 'Rejected' || coalesce(': ' || nullif(note, ''), '') ELSE reason END AS reason, "
    "CASE WHEN to_ IS NULL THEN resolved_at WHEN action <> 'restore' THEN TIMESTAMP '2024-05-01' END AS resolved_at, CASE WHEN to_ IS NULL THEN resolved_by WHEN action <> 'restore' THEN by_ END AS resolved_by FROM r LEFT JOIN g USING (id)"
)
def reviews_resolved(spark, d):
    return _resolved(spark, d)[0]


@query(f"WITH {REVIEWS} SELECT id, action, CASE WHEN missing THEN 'unknown row' WHEN several THEN 'several actions' ELSE 'not allowed when ' || status END AS why FROM w WHERE missing OR several OR to_ IS NULL")
def reviews_refused(spark, d):
    return _resolved(spark, d)[1]


# ---- reconciliation and backfills

LISTED = "m AS (SELECT DISTINCT o_custkey AS product, o_orderkey % 3 AS listing FROM orders WHERE o_orderkey % 4 = 0), n AS (SELECT product, count(*) AS n FROM m GROUP BY product)"


@query(f"WITH {LISTED} SELECT c_custkey AS product, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'not_yet_listed' END AS state FROM customer LEFT JOIN n ON product = c_custkey")
def listing_states(spark, d):
    return W.match_states(_customers(spark, d), _listings(spark, d))


def _customers(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("product"))


def _listings(spark, d):
    return V.table(spark, d, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("product"), (F.col("o_orderkey") % 3).alias("listing"))


@query(
    f"WITH {LISTED} SELECT c_custkey AS product, 'rg_15lb' AS field_name, 2.5::DOUBLE AS current_value, CASE listing WHEN 0 THEN 2.6 ELSE 2.5005 END::DOUBLE AS proposed_value FROM customer JOIN n ON n.product = c_custkey JOIN m ON m.product = c_custkey WHERE n = 1 AND listing = 0 AND c_custkey % 5 > 0"
)
def accuracy_of_exact_matches(spark, d):
    """Ambiguous matches, other weights, small and unknown differences don't count."""
    weights = F.explode(F.array(F.lit(14), F.lit(15)))
    ours = _customers(spark, d).select("product", weights.alias("weight_lbs"), F.when(F.col("product") % 5 > 0, 2.5).alias("rg"))
    listed = spark.range(3).select(F.col("id").alias("listing"), F.when(F.col("id") == 0, 2.6).when(F.col("id") == 1, 2.5005).alias("rg"))
    return W.exact_accuracy(_customers(spark, d), _listings(spark, d), ours, listed, ("rg",))


@query("SELECT o_orderkey AS product, 'release_date' AS field_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS current_value, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS proposed_value FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 > 0")
def release_dates_disagree(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = V.table(spark, d, "orders")
    ours = o.select(k.alias("product"), F.when(k % 5 > 0, day).alias("release_date"))
    theirs = o.select(k.alias("product"), F.when(k % 3 == 1, F.date_add(day, 1)).when(k % 3 == 2, day).alias("release_date"))
    return W.release_mismatches(ours, theirs)


@query(f"{V.with_sql('videos')}, f AS (SELECT product, min(published_at) AS first FROM videos WHERE review = 'pending' GROUP BY product) SELECT p_partkey AS product, CASE WHEN p_size % 3 = 0 THEN TIMESTAMP '2020-01-01' ELSE first END AS last_video_discovery_at FROM part LEFT JOIN f ON product = p_partkey")
def backfill_first_video(spark, d):
    products = _part(spark, d).select(F.col("p_partkey").alias("product"), F.when(F.col("p_size") % 3 == 0, F.lit(datetime(2020, 1, 1)).cast("timestamp")).alias("last_video_discovery_at"))
    return W.backfill_first(products, V.videos(spark, d).filter("review = 'pending'"), "last_video_discovery_at", "published_at")


@query("SELECT 'u' || p_partkey AS url, CASE p_size % 2 WHEN 0 THEN 'netsuite' ELSE 'craft' END AS source_platform, CASE WHEN p_size % 2 = 0 AND p_partkey % 4 = 1 THEN 'retired' ELSE 'current' END AS status FROM part")
def backfill_status(spark, d):
    """Only one platform is corrected, and only where discovery knows a status."""
    url = F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url")
    products = _part(spark, d).select(url, F.when(F.col("p_size") % 2 == 0, "netsuite").otherwise("craft").alias("source_platform"), F.lit("current").alias("status"))
    found = _part(spark, d).select(url, F.when(F.col("p_partkey") % 4 == 1, "retired").when(F.col("p_partkey") % 4 == 2, "current").alias("status"))
    return W.correct_status(products, found, "netsuite")


RATED = f"WITH {SPECS}, e AS (SELECT product, {ESTIMATE} FROM specs), p AS (SELECT p_partkey AS product, CASE WHEN p_size % 3 > 0 THEN 5::INT END AS oil_rating, CASE WHEN p_size % 3 > 0 THEN 6::INT END AS motion_rating, CASE p_size % 3 WHEN 1 THEN 'chart' WHEN 2 THEN 'estimated' END AS oil_motion_source FROM part)"


def _rated(spark, d):
    s = F.col("p_size") % 3
    return _part(spark, d).select(F.col("p_partkey").alias("product"), F.when(s > 0, 5).alias("oil_rating"), F.when(s > 0, 6).alias("motion_rating"), F.when(s == 1, "chart").when(s == 2, "estimated").alias("oil_motion_source"))


@query(f"{RATED} SELECT product, coalesce(oil_rating, oil) AS oil_rating, CASE WHEN oil_rating IS NULL THEN motion ELSE motion_rating END AS motion_rating, coalesce(oil_motion_source, 'estimated') AS oil_motion_source FROM p JOIN e USING (product)")
def backfill_estimates(spark, d):
    return R.fill_estimates(_rated(spark, d), _specs(spark, d))


@query(f"{RATED} SELECT product, CASE WHEN oil_motion_source = 'estimated' THEN oil ELSE oil_rating END AS oil_rating, CASE WHEN oil_motion_source = 'estimated' THEN motion ELSE motion_rating END AS motion_rating, oil_motion_source FROM p JOIN e USING (product)")
def estimates_made_anew(spark, d):
    return R.fill_estimates(_rated(spark, d), _specs(spark, d), again=True)


@query("SELECT o_orderpriority AS run, count(*) AS checked, count(*) FILTER (o_orderkey % 3 = 1) AS succeeded, count(*) FILTER (o_orderkey % 3 <> 1) AS failed FROM orders GROUP BY ALL")
def run_outcomes(spark, d):
    """An outcome that isn't known is a failure."""
    good = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3 == 1)
    return C.run_counts(V.table(spark, d, "orders"), "o_orderpriority", good)


@query("SELECT o_orderkey, o_custkey FROM orders")
def missing_from_nothing(spark, d):
    """Without rows to compare with, all are missing."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return G.missing_from(o, o.filter("false"), ["o_orderkey"])
