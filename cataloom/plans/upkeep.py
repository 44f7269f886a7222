"""Queries of refits, nearest products, merges of duplicates, migrations and files, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..operators import migrate as Y
from ..operators import nearest as N
from ..operators import ranking as R
from ..session import work_folder
from ..sources import files as Z
from ..sources import views as V
from .queries import DISTANCE, SPECS, _specs, query

# ---- refits


@query("SELECT term, round(coefficient, 6) AS coefficient FROM (SELECT unnest(['intercept', 'l_quantity']) AS term, unnest([regr_intercept(l_extendedprice, l_quantity), regr_slope(l_extendedprice, l_quantity)]) AS coefficient FROM lineitem)")
def refit_one_number(spark, d):
    fit = R.refit(V.table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return fit.select("term", F.round("coefficient", 6).alias("coefficient"))


FIT = (
    "x AS (SELECT product, differential AS a, (core_type IS NOT DISTINCT FROM 'asymmetric')::INT AS b, product % 18 + 1 + 2 * (core_type IS NOT DISTINCT FROM 'asymmetric')::INT AS y FROM specs WHERE differential IS NOT NULL), "
    "m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bey, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x), "
    "c AS (SELECT *, (bb * ay - ab * bey) / (aa * bb - ab * ab) AS ca, (aa * bey - ab * ay) / (aa * bb - ab * ab) AS cb FROM m)"
)


@query(f"WITH {SPECS}, {FIT} SELECT unnest(['intercept', 'differential', 'core_type=asymmetric', 'core_type=never']) AS term, round(unnest([my - ca * ma - cb * mb, ca, cb, 0.0]), 6) AS coefficient FROM c")
def refit_motion(spark, d):
    """A number, an indicator, and an indicator that no row has."""
    return R.refit(_charted(spark, d), "y", ["differential"], {"core_type": ["asymmetric", "never"]}).select("term", F.round("coefficient", 6).alias("coefficient"))


def _charted(spark, d):
    return _specs(spark, d).withColumn("y", F.col("product") % 18 + 1 + 2 * F.coalesce((F.col("core_type") == "asymmetric").cast("int"), F.lit(0)))


@query(f"WITH {SPECS}, {FIT} SELECT round(avg(abs(my - ca * ma - cb * mb + ca * a + cb * b - y)), 6) AS mae, count(*) AS n FROM x, c")
def refit_accuracy(spark, d):
    rows = _charted(spark, d)
    fit = R.refit(rows, "y", ["differential"], {"core_type": ["asymmetric"]})
    scored = R.predicted(rows, fit, "fitted").filter("fitted IS NOT NULL")
    return scored.agg(F.round(F.avg(F.abs(F.col("fitted") - F.col("y"))), 6).alias("mae"), F.count("*").alias("n"))


# ---- nearest products


@query(
    f"WITH {SPECS}, s AS (SELECT * FROM specs WHERE product % 5 > 0), c AS (SELECT * FROM specs WHERE product % 3 > 0 AND product % 5 > 0), x AS (SELECT s.product, c.product AS candidate, {DISTANCE} AS score FROM s JOIN c ON s.product <> c.product), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY round(score, 9), candidate) AS rank FROM x) SELECT product, candidate, round(score, 6) AS score, rank::INT AS rank FROM k WHERE rank <= 6"
)
def nearest_products(spark, d):
    """For every published product the nearest published current ones."""
    specs = _specs(spark, d).filter("product % 5 > 0")
    return N.nearest(specs, specs.filter("product % 3 > 0"), 6).select("product", "candidate", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


# ---- duplicates of price sources

SOURCES = (
    "s AS (SELECT o_orderkey AS id, o_custkey AS product, o_orderkey % 2 AS site, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.test/' ELSE '/' END || o_orderkey AS url, "
    "CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status, o_orderkey % 5 > 0 AS active, o_orderdate AS created FROM orders), "
    "r AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS survivor FROM s WINDOW w AS (PARTITION BY product, site ORDER BY NOT (status = 'approved' AND active), created, id)), "
    "g AS (SELECT product, site, arg_min(url, n) FILTER (url LIKE 'https:%') AS whole FROM r GROUP BY product, site)"
)


def _sources(spark, d):
    x, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    url = F.concat(F.when(k % 3 == 0, "https://x.test/").otherwise("/"), k.cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending")
    return x.select(k.alias("id"), F.col("o_custkey").alias("product"), (k % 2).alias("site"), url.alias("url"), status.alias("status"), (k % 5 > 0).alias("active"), F.col("o_orderdate").alias("created"))


def _duplicates_merged(spark, d):
    rows = _sources(spark, d)
    prices = rows.select(F.col("id").alias("source"), (F.col("id") % 100).alias("price")).union(rows.filter("id % 2 = 0").select("id", F.lit(1).cast("long")))
    stock = rows.filter("id % 3 = 0").select(F.col("id").alias("source_id"), F.lit(7).alias("quantity"))
    preferred = (F.col("status") == "approved") & F.col("active")
    return G.merge_duplicates(rows, ["product", "site"], preferred, "created", "id", "url", {"prices": (prices, "source"), "stock": (stock, "source_id")})


@query(f"WITH {SOURCES} SELECT id, product, site, CASE WHEN url LIKE 'https:%' THEN url ELSE coalesce(whole, url) END AS url, status FROM r JOIN g USING (product, site) WHERE n = 1")
def duplicates_kept(spark, d):
    return _duplicates_merged(spark, d)[0].select("id", "product", "site", "url", "status")


@query(f"WITH {SOURCES} SELECT survivor AS source, count(*) AS n, sum(price)::BIGINT AS total FROM (SELECT id, id % 100 AS price FROM s UNION ALL SELECT id, 1 FROM s WHERE id % 2 = 0) JOIN r USING (id) GROUP BY survivor")
def duplicates_history(spark, d):
    return _duplicates_merged(spark, d)[1]["prices"].groupBy("source").agg(F.count("*").alias("n"), F.sum("price").cast("long").alias("total"))


@query(
    f"WITH {SOURCES} SELECT (SELECT count(*) FROM (SELECT product FROM s GROUP BY product, site HAVING count(*) > 1)) AS groups_merged, (SELECT count(*) FROM r WHERE n > 1)::BIGINT AS rows_deleted, p AS prices_before, p AS prices_after, k AS stock_before, k AS stock_after "
    "FROM (SELECT count(*) + count(*) FILTER (id % 2 = 0) AS p, count(*) FILTER (id % 3 = 0) AS k FROM s)"
)
def duplicates_conserved(spark, d):
    return _duplicates_merged(spark, d)[2]


# ---- migrations

COVERS = (
    "covers AS (SELECT p_partkey AS id, p_brand AS brand, ' ' || split_part(p_type, ' ', 1) || CASE p_partkey % 3 WHEN 0 THEN '®' WHEN 1 THEN ' ™' ELSE '' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'urethane' END AS material, CASE WHEN p_partkey % 6 = 0 THEN 'solid' END AS kind FROM part), "
    "products AS (SELECT p_partkey AS product, p_partkey AS cover_id, CASE WHEN p_size % 2 = 0 THEN 'resin' END AS material, CASE WHEN p_size % 3 = 0 THEN 'pearl' END AS kind, p_size AS updated_at FROM part), "
    "own AS (SELECT id, first_value(id) OVER (PARTITION BY brand, trim(replace(replace(name, '®', ''), '™', '')) ORDER BY id) AS survivor FROM covers), "
    "pointed AS (SELECT p.product, o.survivor AS cover_id, p.material, p.kind, p.updated_at FROM products p JOIN own o ON o.id = p.cover_id), "
    "last AS (SELECT DISTINCT ON (cover_id) cover_id, material AS m, kind AS k FROM pointed WHERE material IS NOT NULL OR kind IS NOT NULL ORDER BY cover_id, updated_at DESC, product DESC)"
)


def _migrated(spark, d):
    part = V.table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    mark = F.when(k % 3 == 0, "®").when(k % 3 == 1, " ™").otherwise("")
    covers = part.select(k.alias("id"), F.col("p_brand").alias("brand"), F.concat(F.lit(" "), F.split("p_type", " ")[0], mark).alias("name"), F.when(k % 4 == 0, "urethane").alias("material"), F.when(k % 6 == 0, "solid").alias("kind"))
    products = part.select(k.alias("product"), k.alias("cover_id"), F.when(size % 2 == 0, "resin").alias("material"), F.when(size % 3 == 0, "pearl").alias("kind"), size.alias("updated_at"))
    at = Y.Versions(spark, work_folder(spark, "migration"))
    at.write("covers", covers, 0)
    at.write("products", products, 0)
    at.migrate(Y.COVER_NAMES[:2])
    at.migrate(Y.COVER_NAMES)
    return at


@query(f"WITH {COVERS} SELECT id, brand, trim(replace(replace(name, '®', ''), '™', '')) AS name, coalesce(material, m) AS material, coalesce(kind, k) AS kind FROM covers JOIN own USING (id) LEFT JOIN last ON cover_id = id WHERE id = survivor")
def migrated_covers(spark, d):
    return _migrated(spark, d).read("covers")


@query(f"WITH {COVERS} SELECT product, cover_id FROM pointed")
def migrated_products(spark, d):
    return _migrated(spark, d).read("products").select("product", "cover_id")


# ---- files


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1")
def history_by_month(spark, d):
    """Two runs, one of them done twice; a year of what they wrote is read."""
    path = work_folder(spark, "history")
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    for left in (1, 0, 1):
        part = rows.filter(F.col("l_orderkey") % 2 == left).repartition(F.date_trunc("month", "l_shipdate"))
        Z.append_history(part, path, "l_shipdate", f"run-{left}", "month")
    return Z.history(spark, path, "1996-01-01", "1996-12-01").groupBy("period").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query(f"WITH {SPECS} SELECT product, core_type, cover_type, cover_material, differential FROM specs WHERE product % 4 = 0")
def training_lines(spark, d):
    """Training rows written as JSON lines and read again; unknown values stay unknown."""
    path = work_folder(spark, "training")
    rows = _specs(spark, d).filter("product % 4 = 0").select("product", "core_type", "cover_type", "cover_material", "differential")
    Z.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT 'https://x.test/balls/' || CASE WHEN p_size % 2 = 0 THEN 'current' ELSE 'retired' END || '/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN 'current' ELSE 'retired' END AS status, CASE WHEN p_partkey % 3 > 0 THEN '2024-01-0' || (p_partkey % 9 + 1) END AS lastmod FROM part WHERE p_partkey % 7 > 0")
def sitemap_from_files(spark, d):
    """Sitemaps that Spark may split between URLs."""
    k = F.col("p_partkey")
    status = F.when(F.col("p_size") % 2 == 0, "current").otherwise("retired")
    place = F.when(k % 7 == 0, "bags").otherwise("balls")
    loc = F.concat(F.lit("<url>\n<loc> https://x.test/"), place, F.lit("/"), status, F.lit("/"), k.cast("string"), F.lit(" </loc>"), F.when(k % 3 > 0, F.concat(F.lit("<lastmod>2024-01-0"), (k % 9 + 1).cast("string"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>"))
    path = work_folder(spark, "sitemap")
    V.table(spark, d, "part").select(loc.alias("value")).write.text(path)
    return Z.sitemap_files(spark, path, "/balls/(current|retired)/")
