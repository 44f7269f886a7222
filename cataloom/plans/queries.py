"""Registered queries over the catalog views, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import inventory as I
from ..operators import match as M
from ..operators import merge as G
from ..operators import ranking as R
from ..sources import extract as X
from ..sources import views as V
from ..streaming.breaker import tripped

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
SQL: dict[str, str] = {}
STOCK_DAYS = 14
AS_OF = "TIMESTAMP '2024-01-31'"
SALES = "TIMESTAMP '2001-12-01'"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        REGISTERED[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def adu_sql(name: str, start: int, end: int) -> str:
    upper = f" AND checked_at < {AS_OF} - INTERVAL {end} DAY" if end else ""
    return (
        f"{name}_d AS (SELECT sku, checked_at, lag(quantity) OVER (PARTITION BY sku ORDER BY checked_at, id) - quantity AS drop_ FROM stock WHERE checked_at >= {AS_OF} - INTERVAL {start} DAY{upper}), "
        f"{name}_g AS (SELECT sku, coalesce(sum(CASE WHEN drop_ > 0 THEN drop_ END), 0) AS sold, (epoch_us(max(checked_at)) - epoch_us(min(checked_at))) / 86400000000.0 AS days FROM {name}_d GROUP BY sku HAVING count(*) >= 2), "
        f"{name} AS (SELECT sku, CASE WHEN days > 0 THEN sold / days END AS adu FROM {name}_g)"
    )


ADU = adu_sql("adu", STOCK_DAYS, 0)
STOCK = V.with_sql("stock") + ", " + ADU
STOCK_SKUS = V.with_sql("stock", "skus") + ", " + ADU
TOTALS = "totals AS (SELECT product, coalesce(sum(adu), 0) AS total_adu FROM skus LEFT JOIN adu USING (sku) GROUP BY product)"
LATEST = "latest AS (SELECT sku, arg_max(quantity, (checked_at, id)) AS quantity, max(checked_at) AS checked_at FROM stock WHERE quantity IS NOT NULL GROUP BY sku)"


def _stock(spark: SparkSession, d: str) -> DataFrame:
    return V.stock_history(spark, d)


# ---- stock time series


@query(f"{STOCK} SELECT sku, round(adu, 6) AS adu FROM adu")
def adu_by_sku(spark, d):
    return I.adu(_stock(spark, d), V.STOCK_AS_OF, STOCK_DAYS).select("sku", r("adu"))


@query(f"{V.with_sql('stock')}, {adu_sql('adu', 2 * STOCK_DAYS, STOCK_DAYS)} SELECT sku, round(adu, 6) AS adu FROM adu")
def adu_prev_window(spark, d):
    return I.adu(_stock(spark, d), V.STOCK_AS_OF, 2 * STOCK_DAYS, STOCK_DAYS).select("sku", r("adu"))


CHANGE = f"{V.with_sql('stock')}, {adu_sql('a', STOCK_DAYS, 0)}, {adu_sql('b', 2 * STOCK_DAYS, STOCK_DAYS)}, c AS (SELECT sku, a.adu AS current, b.adu AS previous, a.adu - b.adu AS change FROM a JOIN b USING (sku))"
CHANGE_COLUMNS = "sku, round(current, 6) AS current, round(previous, 6) AS previous, round(change, 6) AS change"


def _change(spark, d):
    return I.adu_change(_stock(spark, d), V.STOCK_AS_OF, STOCK_DAYS)


@query(f"{CHANGE} SELECT {CHANGE_COLUMNS} FROM c WHERE change > 0 ORDER BY c.change DESC, sku LIMIT 10")
def adu_growth(spark, d):
    return _change(spark, d).filter("change > 0").orderBy(F.desc("change"), "sku").limit(10).select("sku", r("current"), r("previous"), r("change"))


@query(f"{CHANGE} SELECT {CHANGE_COLUMNS} FROM c WHERE change < 0 ORDER BY c.change, sku LIMIT 10")
def adu_shrink(spark, d):
    return _change(spark, d).filter("change < 0").orderBy("change", "sku").limit(10).select("sku", r("current"), r("previous"), r("change"))


@query(f"{STOCK_SKUS}, {TOTALS} SELECT product, round(total_adu, 6) AS total_adu FROM totals")
def product_total_adu(spark, d):
    return I.product_adu(_stock(spark, d), V.skus(spark, d), V.STOCK_AS_OF, STOCK_DAYS).select("product", r("total_adu"))


@query(f"{V.with_sql('stock', 'skus', 'products')}, {ADU}, {TOTALS} SELECT brand, round(coalesce(sum(total_adu), 0), 6) AS total_adu FROM products LEFT JOIN totals USING (product) GROUP BY brand")
def brand_total_adu(spark, d):
    return I.brand_adu(_stock(spark, d), V.skus(spark, d), V.products(spark, d), V.STOCK_AS_OF, STOCK_DAYS).select("brand", r("total_adu"))


SUPPLY = f"{LATEST}, supply AS (SELECT sku, quantity, adu, quantity / adu AS days_of_supply FROM latest JOIN adu USING (sku) WHERE quantity > 0 AND adu > 0)"


@query(f"{STOCK}, {SUPPLY} SELECT sku, quantity, round(adu, 6) AS adu, round(days_of_supply, 6) AS days_of_supply FROM supply ORDER BY supply.days_of_supply, sku LIMIT 10")
def days_of_supply_top10(spark, d):
    s = I.days_of_supply(_stock(spark, d), V.STOCK_AS_OF, STOCK_DAYS)
    return s.orderBy("days_of_supply", "sku").limit(10).select("sku", "quantity", r("adu"), r("days_of_supply"))


@query(f"{STOCK_SKUS}, {SUPPLY} SELECT sku, weight_lbs, quantity, round(days_of_supply, 6) AS days_of_supply FROM supply JOIN skus USING (sku) WHERE weight_lbs IN (14, 15)")
def days_of_supply_filtered(spark, d):
    s = I.days_of_supply(_stock(spark, d), V.STOCK_AS_OF, STOCK_DAYS)
    return s.join(V.skus(spark, d).filter(F.col("weight_lbs").isin(14, 15)), "sku").select("sku", "weight_lbs", "quantity", r("days_of_supply"))


@query(
    f"{V.with_sql('stock')}, x AS (SELECT CAST(checked_at AS DATE) AS dd, lag(quantity) OVER (PARTITION BY sku ORDER BY checked_at, id) - quantity AS drop_ FROM stock), "
    "u AS (SELECT dd, CAST(sum(drop_) AS BIGINT) AS units FROM x WHERE drop_ > 0 GROUP BY dd), "
    "spine AS (SELECT CAST(unnest(generate_series(min(CAST(checked_at AS DATE)), max(CAST(checked_at AS DATE)), INTERVAL 1 DAY)) AS DATE) AS dd FROM stock), "
    "f AS (SELECT spine.dd, coalesce(units, 0) AS units FROM spine LEFT JOIN u USING (dd)) "
    "SELECT dd, CAST(units AS BIGINT) AS units, round(sum(units) OVER (ORDER BY dd ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / 30.0, 6) AS adu FROM f"
)
def catalog_adu_history(spark, d):
    return I.history(_stock(spark, d)).select("dd", "units", r("adu"))


@query(
    f"{STOCK}, {LATEST}, f AS (SELECT sku, quantity, adu, CASE WHEN quantity <= 0 THEN 0.0 WHEN adu > 0 THEN quantity / adu END AS dos FROM latest LEFT JOIN adu USING (sku)) "
    "SELECT sku, quantity, round(adu, 6) AS adu, round(dos, 6) AS days_of_supply, CASE WHEN dos <= 14 THEN 'danger' WHEN dos <= 30 THEN 'muted' ELSE 'ok' END AS urgency FROM f"
)
def stock_forecast(spark, d):
    return I.forecast(_stock(spark, d), V.STOCK_AS_OF, STOCK_DAYS).select("sku", "quantity", r("adu"), r("days_of_supply"), "urgency")


@query(f"{V.with_sql('stock')}, {LATEST} SELECT sku, quantity, checked_at FROM latest")
def latest_reading(spark, d):
    return I.latest_reading(_stock(spark, d)).withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))


@query(f"{V.with_sql('stock')} SELECT sku, bool_or(quantity > 0) AS in_stock FROM stock GROUP BY sku")
def tri_state_in_stock(spark, d):
    return I.in_stock(_stock(spark, d))


@query("WITH l AS (SELECT user_id AS k, event_id AS n, CASE WHEN event_type = 'error' THEN 'limited' ELSE CASE WHEN event_type = 'click' THEN 'other' ELSE 'ok' END END AS outcome FROM events), p AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER (PARTITION BY k ORDER BY n) AS part FROM l), q AS (SELECT *, count(*) FILTER (outcome = 'limited') OVER (PARTITION BY k, part ORDER BY n) AS run FROM p) SELECT k, n, outcome, run, max(run >= 2) OVER (PARTITION BY k ORDER BY n) AS open FROM q")
def circuit_breaker(spark, d):
    kind = F.when(F.col("event_type") == "error", "limited").when(F.col("event_type") == "click", "other").otherwise("ok")
    log = V.table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("n"), kind.alias("outcome"))
    return tripped(log, "k", "n", 2)


# ---- ranking

POPULAR = f"{V.with_sql('videos', 'products')}, pop AS (SELECT product, avg(view_count * pow(2.0, -((epoch_us({SALES}) - epoch_us(published_at)) / 86400000000.0) / 180.0)) * ln(1 + count(*)) AS popularity FROM videos WHERE review = 'approved' GROUP BY product)"


@query(f"{POPULAR} SELECT product, round(coalesce(popularity, 0), 4) AS popularity FROM products LEFT JOIN pop USING (product)")
def popularity(spark, d):
    return R.with_popularity(V.products(spark, d), V.videos(spark, d), V.SALES_AS_OF).select("product", r("popularity", 4))


@query(f"{POPULAR} SELECT product, name, round(popularity, 4) AS popularity FROM products JOIN pop USING (product) WHERE popularity > 0 ORDER BY pop.popularity DESC, product LIMIT 10")
def popularity_top10(spark, d):
    p = R.with_popularity(V.products(spark, d), V.videos(spark, d), V.SALES_AS_OF).filter("popularity > 0")
    return C.page(C.ordered(p, "popularity"), 10).select("product", "name", r("popularity", 4))


@query(f"{V.with_sql('skus')} SELECT product, arg_min(sku, (abs(weight_lbs - 15), -weight_lbs, sku)) AS sku, arg_min(weight_lbs, (abs(weight_lbs - 15), -weight_lbs, sku)) AS weight_lbs FROM skus GROUP BY product")
def reference_sku(spark, d):
    return R.reference_sku(V.skus(spark, d))


SPECS = (
    "specs AS (SELECT p_partkey AS product, CASE WHEN p_partkey % 11 <> 0 THEN 2.46 + (p_size % 30) / 100.0 END AS rg, CASE WHEN p_partkey % 13 <> 0 THEN (p_size % 12) * 0.005 END AS differential, "
    "CASE p_partkey % 3 WHEN 0 THEN 'symmetric' WHEN 1 THEN 'asymmetric' END AS core_type, CASE p_size % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'pearl' WHEN 2 THEN 'hybrid' END AS cover_type, "
    "CASE p_partkey % 7 WHEN 0 THEN 'urethane' WHEN 1 THEN 'polyester_plastic' WHEN 2 THEN NULL ELSE 'reactive_resin' END AS cover_material, p_partkey % 9 = 0 AS has_particle FROM part)"
)


def _specs(spark: SparkSession, d: str) -> DataFrame:
    p, k, s = V.table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.alias("product"), F.when(k % 11 != 0, F.lit(2.46) + (s % 30) / F.lit(100.0)).alias("rg"), F.when(k % 13 != 0, (s % 12) * F.lit(0.005)).alias("differential"),
        F.when(k % 3 == 0, "symmetric").when(k % 3 == 1, "asymmetric").alias("core_type"),
        F.when(s % 4 == 0, "solid").when(s % 4 == 1, "pearl").when(s % 4 == 2, "hybrid").alias("cover_type"),
        F.when(k % 7 == 0, "urethane").when(k % 7 == 1, "polyester_plastic").when(k % 7 != 2, "reactive_resin").alias("cover_material"), (k % 9 == 0).alias("has_particle"),
    )


DISTANCE = (
    "sqrt(coalesce(pow((s.rg - c.rg) / 0.35, 2), 0) + coalesce(pow((s.differential - c.differential) / 0.06, 2), 0)) + CASE WHEN s.core_type <> c.core_type THEN 0.5 ELSE 0 END "
    "+ CASE WHEN s.cover_type <> c.cover_type THEN 0.2 ELSE 0 END + CASE WHEN s.cover_material <> c.cover_material THEN 0.2 ELSE 0 END"
)


@query(f"WITH {SPECS}, x AS (SELECT c.product, round({DISTANCE}, 9) AS score FROM specs s, specs c WHERE s.product = 1 AND c.product <> 1) SELECT product, round(score, 6) AS score FROM x ORDER BY x.score, product LIMIT 20")
def similar_products(spark, d):
    return R.similar(_specs(spark, d), 1, 20).select("product", r("score"))


ESTIMATE = (
    "CAST(greatest(1, least(16, round_even(CASE cover_material WHEN 'polyester_plastic' THEN 2.0 WHEN 'urethane' THEN 6.0 WHEN 'reactive_resin' THEN 10.0 ELSE 8.5 END + CASE cover_type WHEN 'pearl' THEN -3 ELSE 0 END + CASE WHEN has_particle THEN 2 ELSE 0 END, 0))) AS INT) AS oil, "
    "CAST(greatest(1, least(18, round_even(round(CASE core_type WHEN 'symmetric' THEN 4.0 WHEN 'asymmetric' THEN 8.0 ELSE 6.0 END + coalesce((differential - 0.02) / 0.045 * 8, 0) + CASE cover_type WHEN 'pearl' THEN 2 WHEN 'solid' THEN 1 ELSE 0 END, 9), 0))) AS INT) AS motion"
)


@query(f"WITH {SPECS} SELECT product, {ESTIMATE} FROM specs")
def oil_motion_estimate(spark, d):
    return R.estimate(_specs(spark, d)).select("product", "oil", "motion")


@query(f"WITH {SPECS}, e AS (SELECT product, {ESTIMATE} FROM specs), c AS (SELECT product, oil, CAST(product % 16 + 1 AS INT) AS chart FROM e) SELECT round(avg(abs(oil - chart)), 9) AS mae, count(*) FILTER (oil = chart) AS exact, count(*) FILTER (abs(oil - chart) <= 2) AS within_two, count(*) AS n FROM c")
def estimate_mae(spark, d):
    e = R.estimate(_specs(spark, d)).withColumn("chart", (F.col("product") % 16 + 1).cast("int"))
    return R.accuracy(e, "oil", "chart").select(r("mae", 9), "exact", "within_two", "n")


# ---- catalog reads

PRODUCTS = V.with_sql("products")


@query(f"{PRODUCTS} SELECT product, name, brand FROM products WHERE published AND status = 'current' AND size BETWEEN 5 AND 40 ORDER BY name, product LIMIT 20 OFFSET 20")
def browse_page(spark, d):
    p = C.browse(V.products(spark, d), statuses=["current"], size_range=(5, 40))
    return C.page(C.ordered(p, "name_asc"), 20, 20).select("product", "name", "brand")


@query(f"{PRODUCTS} SELECT product, name FROM products WHERE published AND name ILIKE '%bl%'")
def search_ilike(spark, d):
    return C.browse(V.products(spark, d), name_like="bl").select("product", "name")


@query(f"{PRODUCTS} SELECT DISTINCT brand, cover FROM products WHERE published")
def distinct_facets(spark, d):
    return V.products(spark, d).filter("published").select("brand", "cover").distinct()


@query(f"{PRODUCTS} SELECT brand, count(*) FILTER (published) AS n_published, count(*) FILTER (status = 'retired') AS n_retired, count(DISTINCT cover) FILTER (published) AS covers, max(price) AS dearest FROM products GROUP BY brand")
def kpi_summary(spark, d):
    p = V.products(spark, d)
    return p.groupBy("brand").agg(F.count_if("published").alias("n_published"), F.count_if(F.col("status") == "retired").alias("n_retired"), F.count_distinct(F.when(F.col("published"), F.col("cover"))).alias("covers"), F.max("price").alias("dearest"))


PV = V.with_sql("products", "videos")


@query(f"{PV} SELECT product, name FROM products p WHERE EXISTS (SELECT 1 FROM videos v WHERE v.product = p.product AND review = 'pending')")
def has_children_semi(spark, d):
    return C.with_children(V.products(spark, d), V.videos(spark, d).filter("review = 'pending'"), "product").select("product", "name")


@query(f"{PV} SELECT product, name FROM products p WHERE NOT EXISTS (SELECT 1 FROM videos v WHERE v.product = p.product AND view_count > 90000)")
def missing_children_anti(spark, d):
    return C.without_children(V.products(spark, d), V.videos(spark, d).filter("view_count > 90000"), "product").select("product", "name")


@query(f"{PV}, g AS (SELECT product FROM videos GROUP BY product HAVING bool_and(view_count > 5000)) SELECT product FROM products JOIN g USING (product)")
def all_rows_satisfy(spark, d):
    return C.all_children(V.products(spark, d), V.videos(spark, d), "product", F.col("view_count") > 5000).select("product")


@query(f"{PV}, n AS (SELECT product, count(*) AS m FROM videos WHERE review = 'approved' GROUP BY product) SELECT product, coalesce(m, 0) AS videos FROM products LEFT JOIN n USING (product)")
def count_per_dimension(spark, d):
    return C.count_children(V.products(spark, d), V.videos(spark, d).filter("review = 'approved'"), "product", "videos").select("product", "videos")


@query(f"{PV}, n AS (SELECT product, count(*) AS m FROM videos WHERE review = 'approved' GROUP BY product) SELECT product FROM products LEFT JOIN n USING (product) WHERE coalesce(m, 0) <> size % 10")
def summary_stale(spark, d):
    n = C.count_children(V.products(spark, d), V.videos(spark, d).filter("review = 'approved'"), "product", "n")
    return n.filter(F.col("n") != F.col("size") % 10).select("product")


@query(f"{V.with_sql('prices')} SELECT product, arg_max(site, (checked_at, order_id, line_id)) AS site, round(arg_max(price, (checked_at, order_id, line_id)), 6) AS price FROM prices GROUP BY product")
def latest_price(spark, d):
    return C.latest(V.price_history(spark, d), ["product"], ["checked_at", "order_id", "line_id"], ["site", "price"]).select("product", "site", r("price"))


@query(f"{V.with_sql('prices')} SELECT product, site, count(*) AS readings, round(min(price), 6) AS low, round(max(price), 6) AS high FROM prices WHERE checked_at >= {SALES} - INTERVAL 365 DAY GROUP BY product, site")
def price_history_window(spark, d):
    p = V.price_history(spark, d).filter(F.col("checked_at") >= F.lit(V.SALES_AS_OF) - F.make_dt_interval(F.lit(365)))
    return p.groupBy("product", "site").agg(F.count("*").alias("readings"), F.round(F.min("price"), 6).alias("low"), F.round(F.max("price"), 6).alias("high"))


@query(f"{PV}, v AS (SELECT product, max(published_at) AS checked FROM videos WHERE review = 'rejected' AND product % 4 <> 0 GROUP BY product) SELECT product, checked FROM products LEFT JOIN v USING (product) ORDER BY checked ASC NULLS FIRST, product LIMIT 50")
def work_queue_nulls_first(spark, d):
    v = V.videos(spark, d).filter("review = 'rejected' and product % 4 <> 0").groupBy("product").agg(F.max("published_at").alias("checked"))
    q = V.products(spark, d).join(v, "product", "left").select("product", F.col("checked").cast("timestamp_ntz").alias("checked"))
    return C.work_queue(q, "checked", "product", 50)


@query(f"{PRODUCTS}, a(position, product) AS (VALUES (0, 7), (1, 3), (2, 999999999), (3, 7), (4, 12), (5, 1)) SELECT position, product, name FROM a JOIN products USING (product)")
def compare_ordered(spark, d):
    return C.in_given_order(V.products(spark, d), [7, 3, 999_999_999, 7, 12, 1, 2], "product").select("position", "product", "name")


@query("SELECT conv_id, string_agg(turn_no || '. ' || text, chr(10) ORDER BY turn_no) AS listing FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_no FROM conversations) GROUP BY conv_id")
def numbered_transcript(spark, d):
    return C.numbered_list(V.table(spark, d, "conversations"), "conv_id", ["turn", "role"], "text")


# ---- column functions

@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS x FROM documents")
def normalize_name(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("x"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' The Ball'), '[a-z0-9]+'), lambda w: w NOT IN ('bowling', 'ball', 'the', 'and', 'a', 'an', 'of')))), ' ') AS tokens FROM part")
def significant_tokens(spark, d):
    name = F.concat("p_name", F.lit(" The Ball"))
    return V.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(T.significant_tokens(name)), " ").alias("tokens"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END AS x FROM part")
def score_match(spark, d):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Review: "), F.upper("p_brand"), F.lit(" "), F.upper("p_name"))).otherwise(F.concat(F.lit("??? "), F.col("p_name")))
    return V.table(spark, d, "part").select("p_partkey", T.score_match(title, F.col("p_brand"), F.col("p_name")).alias("x"))


COVER_NAME = "CASE p_partkey % 9 WHEN 0 THEN 'X12 Solid' WHEN 1 THEN 'Hybrid Pearl Reactive' WHEN 2 THEN 'Plastic' WHEN 3 THEN 'Urethane Polyester' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'Pearl Solid' WHEN 7 THEN 'Reactive' ELSE 'Something' END"


def _keywords(table: tuple[tuple[str, str], ...], default: str = "NULL") -> str:
    cases = " ".join(f"WHEN contains(lower(x), '{k}') THEN '{v}'" for k, v in table)
    return f"CASE WHEN coalesce(x, '') = '' THEN NULL {cases} ELSE {default} END"


COVER_TABLES = {"craft": (T.CRAFT_MATERIALS, T.COVERS, "NULL"), "netsuite": (T.MATERIALS, T.COVERS, "NULL"), "commercebuild": (T.MATERIALS[:3], T.LATE_COVERS, "'reactive_resin'"), "woo": (T.MATERIALS, T.COVERS, "NULL"), "shopify": (T.MATERIALS, T.COVERS, "NULL")}


def _cover_query(platform: str) -> None:
    materials, covers, default = COVER_TABLES[platform]

    def run(spark: SparkSession, d: str) -> DataFrame:
        name = F.expr(COVER_NAME)
        return V.table(spark, d, "part").select("p_partkey", T.cover_class(platform, name, name if platform in ("woo", "shopify") else None).alias("c")).select("p_partkey", "c.material", "c.type")

    run.__name__ = f"coverstock_{platform}"
    query(f"SELECT p_partkey, {_keywords(materials, default)} AS material, {_keywords(covers)} AS type FROM (SELECT p_partkey, {COVER_NAME} AS x FROM part)")(run)


for _platform in COVER_TABLES:
    _cover_query(_platform)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'asymmetric' WHEN 1 THEN 'symmetric' WHEN 2 THEN 'asymmetric' ELSE 'symmetric' END AS x FROM part")
def core_type(spark, d):
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, "Asymmetrical").when(k % 4 == 1, "Symmetrical core")
    return V.table(spark, d, "part").select("p_partkey", T.core_type(said, F.lit(True), k % 4 == 2).alias("x"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS craft, CAST(date_trunc('month', o_orderdate) AS DATE) AS woo, CAST(o_orderdate AS DATE) AS netsuite, CAST(o_orderdate AS DATE) AS short FROM orders")
def parse_release_dates(spark, d):
    o, t = V.table(spark, d, "orders"), F.col("o_orderdate")
    made = lambda f, p, lead="": T.release_date(F.concat(F.lit(lead), F.date_format(t, f)), p)
    return o.select("o_orderkey", made("MMMM d, yyyy", "craft").alias("craft"), made("MMM yyyy", "woo").alias("woo"), made("M/d/yyyy", "netsuite", "Available ").alias("netsuite"), made("M/d/yy", "commercebuild").alias("short"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 60 + l_linenumber AS seconds FROM lineitem")
def iso_duration(spark, d):
    text = F.concat(F.lit("PT"), F.col("l_quantity").cast("long"), F.lit("M"), F.col("l_linenumber"), F.lit("S"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.duration_seconds(text).alias("seconds"))


@query("SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size AS DECIMAL(18,2)) AS whole FROM part")
def parse_price(spark, d):
    amount = F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2)
    return V.table(spark, d, "part").select("p_partkey", T.price(F.concat(F.lit("Now $"), amount, F.lit(" (was $9,999.99)"))).alias("price"), T.price(F.concat(F.lit("USD "), F.col("p_size"))).alias("whole"))


@query("SELECT p_partkey, CAST(least(p_size, 12) AS INT) AS lo, CAST(greatest(p_size, 12) AS INT) AS hi, CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 3 AS VARCHAR) || ' lb' AS label FROM part")
def weight_ranges(spark, d):
    size = F.col("p_size")
    w = T.weight_range(F.concat(size, F.lit(" to 12 lbs")))
    return V.table(spark, d, "part").select("p_partkey", w["lo"].alias("lo"), w["hi"].alias("hi"), T.range_text(size, size + 4).alias("label"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug, p_name AS name, p_brand AS color, p_name AS stripped, 'brand_' || split_part(p_brand, '#', 2) || '_url' AS key, replace(p_name, ' ', '+') AS quoted FROM part")
def name_functions(spark, d):
    n = T.name_and_color(F.concat("p_name", F.lit(" - "), "p_brand"))
    return V.table(spark, d, "part").select(
        "p_partkey", T.slug(F.col("p_name")).alias("slug"), n["name"].alias("name"), n["color"].alias("color"),
        T.strip_generic(F.concat("p_name", F.lit(" Bowling Ball Edition"))).alias("stripped"), T.resource_key(F.col("p_brand")).alias("key"), F.url_encode("p_name").alias("quoted"),
    )


# ---- merges

OLD = "o AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS brand, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 'retired' ELSE 'current' END AS status FROM part WHERE p_partkey % 7 <> 0)"
NEW = "n AS (SELECT p_partkey AS id, p_name || '!' AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_brand || '+' END AS brand, p_size + p_partkey % 2 AS size, CASE WHEN p_partkey % 2 = 0 THEN 'retired' ELSE 'current' END AS status FROM part WHERE p_partkey % 11 <> 0)"


def _old(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return V.table(spark, d, "part").filter(k % 7 != 0).select(k.alias("id"), F.col("p_name").alias("name"), F.when(k % 4 != 0, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"), F.when(k % 3 == 0, "retired").otherwise("current").alias("status"))


def _new(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return V.table(spark, d, "part").filter(k % 11 != 0).select(k.alias("id"), F.concat("p_name", F.lit("!")).alias("name"), F.when(k % 5 != 0, F.concat("p_brand", F.lit("+"))).alias("brand"), (F.col("p_size") + k % 2).cast("int").alias("size"), F.when(k % 2 == 0, "retired").otherwise("current").alias("status"))


@query(
    f"WITH {OLD}, {NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, coalesce(n.brand, o.brand) AS brand, CAST(CASE WHEN n.id IS NULL THEN o.size ELSE n.size END AS INT) AS size, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, "
    f"CASE WHEN n.status = 'retired' AND coalesce(o.status, '') <> 'retired' THEN {SALES} WHEN n.status = 'current' THEN NULL WHEN o.status = 'retired' THEN TIMESTAMP '2000-01-01' END AS retired_at FROM o FULL JOIN n ON o.id = n.id"
)
def upsert_products(spark, d):
    old = _old(spark, d).withColumn("retired_at", F.when(F.col("status") == "retired", F.timestamp_seconds(F.lit(946684800))))
    out = G.upsert(old, _new(spark, d), ["id"], {"brand": G.NEW_ELSE_OLD}, {"retired_at": G.retired_at(V.SALES_AS_OF)})
    return out.withColumn("retired_at", F.col("retired_at").cast("timestamp_ntz"))


@query(f"WITH {OLD}, {NEW} SELECT n.id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.size IS DISTINCT FROM o.size THEN 'changed' ELSE 'unchanged' END AS diff FROM n LEFT JOIN o ON n.id = o.id")
def url_diff(spark, d):
    return G.snapshot_diff(_old(spark, d), _new(spark, d), "id", "size")


@query(f"WITH {OLD}, {NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(o.brand, n.brand) AS brand, coalesce(o.size, n.size) AS size FROM o FULL JOIN n ON o.id = n.id")
def fill_gaps(spark, d):
    old, new = (x.select("id", "brand", "size") for x in (_old(spark, d), _new(spark, d)))
    return G.fill_gaps(old, new, ["id"], ["brand", "size"], 0.001)[0]


@query(f"WITH {OLD}, {NEW} SELECT o.id, 'size' AS field_name, CAST(o.size AS DOUBLE) AS current_value, CAST(n.size AS DOUBLE) AS proposed_value FROM o JOIN n ON o.id = n.id WHERE abs(o.size - n.size) > 0.001")
def tolerance_review(spark, d):
    return G.tolerance_review(_old(spark, d), _new(spark, d), ["id"], ["size"], 0.001)


@query("WITH s AS (SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY (p_size > 25) DESC, p_retailprice, p_partkey) AS survivor FROM part) SELECT survivor AS product, l_orderkey, l_linenumber FROM lineitem JOIN s ON l_partkey = p_partkey")
def dedupe_reparent(spark, d):
    s = G.survivors(V.table(spark, d, "part"), ["p_brand", "p_name"], [(F.col("p_size") > 25).desc(), F.asc("p_retailprice")], "p_partkey")
    h = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), "l_orderkey", "l_linenumber")
    return G.repoint(h, s, "product").select("product", "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size DESC NULLS LAST, p_partkey DESC) AS n FROM part) WHERE n = 1")
def distinct_on(spark, d):
    return G.first_per_key(V.table(spark, d, "part"), ["p_brand", "p_name"], [F.desc_nulls_last("p_size"), F.desc("p_partkey")]).select("p_partkey", "p_brand", "p_name")


REVIEW = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END"


@query(f"WITH r AS (SELECT doc_id, {REVIEW} AS status, CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'restore' END AS action FROM labels) SELECT doc_id, status, action, CASE WHEN status = 'pending' AND action = 'approve' THEN 'approved' WHEN status = 'pending' AND action = 'reject' THEN 'rejected' WHEN status <> 'pending' AND action = 'restore' THEN 'pending' END AS after FROM r")
def review_transitions(spark, d):
    k = F.col("doc_id") % 3
    q = V.table(spark, d, "labels").select("doc_id", F.expr(REVIEW).alias("status"), F.when(k == 0, "approve").when(k == 1, "reject").otherwise("restore").alias("action"))
    return q.withColumn("after", G.review(F.col("status"), F.col("action")))


@query(f"WITH q AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE {REVIEW} = 'pending') SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc_id = d.doc_id AND coalesce(q.lang, '') = coalesce(d.lang, ''))")
def insert_if_new(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    queue = docs.join(V.table(spark, d, "labels").withColumn("status", F.expr(REVIEW)), "doc_id").select("doc_id", F.col("lang"), "status")
    return G.insert_if_new(queue, docs.select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang")), ["doc_id", "lang"])


# ---- matching

THEIRS = "t AS (SELECT p_partkey + 1000000 AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || ' BOWLING BALL' WHEN 1 THEN p_name || '!' ELSE p_name || ' Edition X' END || ' ' || CAST(p_partkey AS VARCHAR) AS name, p_partkey AS position FROM part WHERE p_partkey % 2 = 0)"
OURS = "u AS (SELECT p_partkey AS id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name FROM part)"
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: w NOT IN ('bowling', 'ball', 'balls', 'edition')))), ' ')"


def _ours(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))


def _theirs(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 3 == 0, F.concat(F.upper(n), F.lit(" BOWLING BALL"))).when(k % 3 == 1, F.concat(n, F.lit("!"))).otherwise(F.concat(n, F.lit(" Edition X")))
    return V.table(spark, d, "part").filter(k % 2 == 0).select((k + 1_000_000).alias("id"), F.concat_ws(" ", name, k).alias("name"), k.alias("position"))


@query(
    f"WITH {OURS}, {THEIRS}, a AS (SELECT id, {NORM.format('name')} AS norm, {KEY.format('name')} AS key FROM u), b AS (SELECT id, position, {NORM.format('name')} AS norm, {KEY.format('name')} AS key FROM t), "
    "e AS (SELECT a.id, arg_min(b.id, b.position) AS their_id FROM a JOIN b ON a.norm = b.norm GROUP BY a.id), l AS (SELECT a.id, arg_min(b.id, b.position) AS their_id FROM a JOIN b ON a.key = b.key WHERE a.id NOT IN (SELECT id FROM e) GROUP BY a.id) "
    "SELECT a.id AS our_id, coalesce(e.their_id, l.their_id) AS their_id, CASE WHEN e.their_id IS NOT NULL THEN TRUE WHEN l.their_id IS NOT NULL THEN FALSE END AS exact FROM a LEFT JOIN e USING (id) LEFT JOIN l USING (id)"
)
def fuzzy_name_match(spark, d):
    return M.name_matches(_ours(spark, d), _theirs(spark, d)).select("our_id", "their_id", "exact")


@query()
def fuzzy_name_ratio(spark, d):
    return M.name_matches(_ours(spark, d), _theirs(spark, d))


@query(f"WITH {OURS}, {THEIRS}, a AS (SELECT id, {KEY.format('name')} AS key FROM u), b AS (SELECT {KEY.format('name')} AS key FROM t) SELECT id AS our_id, 'listing' AS field_name, 'missing' AS reason FROM a WHERE key NOT IN (SELECT key FROM b)")
def coverage_gap(spark, d):
    return M.coverage_gap(M.name_matches(_ours(spark, d), _theirs(spark, d), exact_ratio=False))


@query("WITH a AS (SELECT l_partkey AS product, l_linenumber + 0.001 AS w, l_orderkey AS id FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT l_partkey AS product, CAST(l_linenumber AS DECIMAL(10,4)) AS w, l_orderkey AS id FROM lineitem WHERE l_suppkey % 2 = 1), x AS (SELECT product, CAST(round(w, 2) AS DECIMAL(12,2)) AS weight, id, row_number() OVER (PARTITION BY product, round(w, 2) ORDER BY id) AS n FROM a), y AS (SELECT product, CAST(round(w, 2) AS DECIMAL(12,2)) AS weight, id, row_number() OVER (PARTITION BY product, round(w, 2) ORDER BY id) AS n FROM b) SELECT coalesce(x.product, y.product) AS product, CAST(coalesce(x.weight, y.weight) AS DOUBLE) AS weight, x.id AS ours, y.id AS theirs, CASE WHEN x.id IS NULL THEN 'theirs_only' WHEN y.id IS NULL THEN 'ours_only' ELSE 'matched' END AS side FROM x FULL JOIN y ON x.product = y.product AND x.weight = y.weight AND x.n = y.n")
def weight_match_full_outer(spark, d):
    x = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product"), (F.col("l_linenumber") + F.lit(0.001)).alias("weight"), F.col("l_orderkey").alias("id"), "l_suppkey")
    y = x.withColumn("weight", F.floor("weight"))
    out = M.weight_matches(x.filter("l_suppkey % 2 = 0"), y.filter("l_suppkey % 2 = 1"))
    return out.withColumn("weight", F.col("weight").cast("double"))


@query("WITH e AS (SELECT p_partkey AS entry, CASE WHEN p_partkey % 10 = 0 THEN 'None' ELSE p_brand END AS b, CASE WHEN p_partkey % 4 = 0 THEN 'zzz' ELSE p_name END AS k FROM part), g AS (SELECT p_brand AS b, p_name AS k, count(*) AS n, min(p_partkey) AS product FROM part GROUP BY ALL) SELECT entry, CASE WHEN n = 1 THEN product END AS product, CASE WHEN e.b = 'None' THEN 'no_brand' WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM e LEFT JOIN g ON e.b = g.b AND e.k = g.k")
def override_match_unique(spark, d):
    k, p = F.col("p_partkey"), V.table(spark, d, "part")
    e = p.select(k.alias("entry"), F.when(k % 10 == 0, "None").otherwise(F.upper("p_brand")).alias("brand"), F.when(k % 4 == 0, "zzz").otherwise(F.upper("p_name")).alias("name"))
    return M.unique_matches(e, p.select(k.alias("product"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")))


# ---- extraction


@query("SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))) AS link FROM pages)")
def page_links(spark, d):
    return X.links(V.table(spark, d, "pages"), "page_id", "html", '<a href="([^"]+)"')


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang FROM pages")
def page_hosts(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang"))


@query("SELECT 'http://x.test/' || CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'retired' END || '/' || CAST(p_partkey AS VARCHAR) AS url, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'retired' END AS status, CASE WHEN p_partkey % 5 <> 0 THEN '2024-01-01' END AS lastmod FROM part WHERE p_partkey % 3 <> 0")
def sitemap_scan(spark, d):
    k = F.col("p_partkey")
    place = F.when(k % 3 == 0, "about").when(k % 2 == 0, "current").otherwise("retired")
    entry = F.concat(F.lit("<url><loc>http://x.test/"), place, F.lit("/"), k, F.lit("</loc>"), F.when(k % 5 != 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.lit("</url>"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), entry, F.lit("</urlset>"))
    return X.sitemap(V.table(spark, d, "part").select(xml.alias("xml")), "xml", r"/(current|retired)/\d+$")


@query("SELECT p_partkey, unnest([14, 15, 16]) AS weight_lbs, unnest([2.5, 2.48, 2.47]) AS rg, unnest([0.04, 0.05, NULL]) AS differential FROM part")
def packed_table_rows(spark, d):
    rows = X.packed_rows(F.lit("14 lb\n15 lb\n16 lb"), F.lit("2.50\n2.48\n2.47"), F.lit(".040\n0.050"), F.lit(None).cast("string"))
    return V.table(spark, d, "part").select("p_partkey", F.inline(rows)).select("p_partkey", "weight_lbs", "rg", "differential")


@query("SELECT user_id, event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark, d):
    return V.table(spark, d, "events").select("user_id", "event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT doc_id, substring(text, 1, 12000) AS head, length(text) > 12000 AS cut FROM documents")
def text_truncation(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 12000).alias("head"), (F.length("text") > 12000).alias("cut"))


@query("WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size < 30), b AS (SELECT DISTINCT p_name FROM part WHERE p_size >= 25) SELECT p_name, 'retired only' AS side FROM a WHERE p_name NOT IN (SELECT p_name FROM b) UNION ALL SELECT p_name, 'current' FROM b")
def set_operations(spark, d):
    p = V.table(spark, d, "part")
    a, b = p.filter("p_size < 30").select("p_name").distinct(), p.filter("p_size >= 25").select("p_name").distinct()
    return a.subtract(b).withColumn("side", F.lit("retired only")).union(b.withColumn("side", F.lit("current")))
