"""Queries of page tables, reconciliation, updates and discovery, each beside its DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import inventory as I
from ..operators import match as M
from ..operators import merge as G
from ..operators import ranking as R
from ..operators import review as W
from ..sources import extract as X
from ..sources import tables as B
from ..sources import views as V
from .queries import STOCK, STOCK_DAYS, LATEST, query

NOW = datetime(2024, 5, 1)


def _part(spark, d):
    return V.table(spark, d, "part")


# ---- tables of pages: the cells hold numbers of the part, so the SQL computes them from the columns

RG, DIFF = "2.40 + p_size / 1000.0", "(p_partkey % 90) / 1000.0"
SKU_SQL = "CAST({w} AS INT) AS weight_lbs, {rg} AS rg, {diff} AS differential, {bias} AS mass_bias"


def _num(expr: str):
    return F.format_string("%.3f", F.expr(expr).cast("double"))


def _sku_rows(df, rows):
    return df.select("p_partkey", F.inline(rows)).select("p_partkey", "weight_lbs", F.round("rg", 3).alias("rg"), F.round("differential", 3).alias("differential"), F.round("mass_bias", 3).alias("mass_bias"))


def _rounded(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 3)"


@query(
    f"SELECT p_partkey, CAST(w AS INT) AS weight_lbs, {_rounded(RG + ' + w / 10000.0 * 10')} AS rg, CASE WHEN w = 16 OR p_partkey % 4 > 0 THEN {_rounded(DIFF)} END AS differential, "
    f"CASE WHEN p_partkey % 3 = 0 THEN {_rounded('w / 1000.0')} END AS mass_bias FROM part, (SELECT unnest([16, 15, 14]) AS w) WHERE p_partkey % 5 > 0"
)
def table_skus_by_column(spark, d):
    cell = lambda e: _num(e)
    weights = (16, 15, 14)
    rg = F.array(F.lit("RG"), *[cell(f"{RG} + {w} / 1000.0") for w in weights], F.lit(""))
    diff = F.array(F.lit("Diff."), *[F.when((F.lit(w) == 16) | (F.col("p_partkey") % 4 > 0), cell(DIFF)).otherwise("") for w in weights], F.lit(""))
    psa = F.array(F.when(F.col("p_partkey") % 3 == 0, "PSA").otherwise("Other"), *[cell(f"{w} / 1000.0") for w in weights], F.lit(None))
    head = F.array(F.lit(""), F.lit("16lb"), F.lit(" 15 LBS."), F.lit("14 lb"), F.lit(None).cast("string"))
    broken = F.array(F.array(F.lit("NOTES"), F.lit(""), F.lit("none")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    table = F.when(F.col("p_partkey") % 5 > 0, F.array(F.array(F.lit("NOTES"), F.lit(""), F.lit("")), head, rg, diff, psa)).otherwise(broken)
    return _sku_rows(_part(spark, d), B.grid_skus(table))


@query(
    f"SELECT p_partkey, CAST(w AS INT) AS weight_lbs, {_rounded(RG)} AS rg, {_rounded(DIFF)} AS differential, CASE WHEN p_partkey % 2 = 0 THEN {_rounded('w / 1000.0')} END AS mass_bias "
    "FROM part, (SELECT unnest([16, 15, 14]) AS w) WHERE w <> 15 OR p_partkey % 7 > 0"
)
def table_skus_by_row(spark, d):
    def row(w):
        beside = F.when((F.lit(w) == 15) & (F.col("p_partkey") % 7 == 0), "14lb").otherwise(_num(RG))
        return F.array(F.lit(""), F.lit(f"{w} lbs"), beside, _num(DIFF), F.when(F.col("p_partkey") % 2 == 0, _num(f"{w} / 1000.0")).otherwise(""))

    intro = F.array(F.lit("DESIGN INTENT:"), F.lit(""), F.lit("x"), F.lit(""), F.lit(""))
    return _sku_rows(V.spread(_part(spark, d)), B.grid_skus(F.array(intro, row(16), row(15), row(14))))


@query(
    f"SELECT p_partkey, CAST(w AS INT) AS weight_lbs, {_rounded(RG)} AS rg, {_rounded('-w / 1000.0')} AS differential, CASE WHEN p_partkey % 2 = 0 THEN {_rounded(DIFF)} END AS mass_bias "
    "FROM part, (SELECT unnest([16, 15]) AS w) WHERE p_partkey % 6 > 0 OR w = 15"
)
def table_skus_from_text(spark, d):
    line = lambda w: F.concat(F.lit(f"{w} "), _num(RG), F.lit(" "), _num(f"-{w} / 1000.0"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), _num(DIFF))).otherwise(""))
    first = F.when(F.col("p_partkey") % 6 > 0, line(16)).otherwise(F.concat(line(16), F.lit(" extra")))
    text = F.concat_ws("\n", F.lit("LBS RG DIFF"), first, F.lit("800-369-4402"), line(15), F.lit("a@b.c"))
    return _sku_rows(_part(spark, d), B.text_skus(text))


@query(
    f"SELECT p_partkey, CAST(w AS INT) AS weight_lbs, {_rounded('CASE WHEN p_partkey % 3 = 0 THEN ' + RG + ' + 0.5 ELSE ' + RG + ' END')} AS rg, CASE WHEN w = 16 OR p_partkey % 4 > 0 THEN {_rounded(DIFF)} END AS differential, "
    f"CASE WHEN p_partkey % 3 = 0 THEN {_rounded('w / 1000.0')} END AS mass_bias FROM part, (SELECT unnest([16, 15]) AS w) WHERE p_partkey % 5 > 0"
)
def table_skus_from_sheet(spark, d):
    old = F.col("p_partkey") % 3 == 0
    header = F.when(F.col("p_partkey") % 5 == 0, "Ball of 16 lbs").otherwise("16 lbs, 15 lbs")
    diff = F.concat_ws(" ", _num(DIFF), F.when(F.col("p_partkey") % 4 > 0, _num(DIFF)))
    legacy = F.concat(F.lit("RG Min "), _num(f"{RG} + 0.5"), F.lit(" "), _num(f"{RG} + 0.5"), F.lit("\nRG DIFF "), diff, F.lit("\nrg asy 0.016 0.015\nRG MAX 9 9"))
    modern = F.concat(F.lit("DIFF "), diff)
    text = F.concat_ws("\n", header, F.concat(F.lit("RG "), _num(RG), F.lit(" "), _num(RG)), F.when(old, legacy).otherwise(modern))
    return _sku_rows(_part(spark, d), B.weight_table(text))


LABELS = ("level", "color", "core", "coverstock", "rg", "differential", "asy")


def _page():
    cells = lambda *xs: F.concat(F.lit("<tr>"), *[x for c in xs for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    numbers = F.concat(
        F.lit("<table><tr><th></th><th>16 lb</th><th>15 LB</th></tr>"), cells(F.lit("RG"), _num(RG), F.when(F.col("p_partkey") % 4 > 0, _num(RG)).otherwise("")),
        cells(F.lit("Differential"), _num(DIFF), F.when(F.col("p_partkey") % 4 > 0, _num(DIFF)).otherwise("")), cells(F.lit(" <b>ASY</b> "), F.lit("0.016"), F.lit("")), F.lit("</table>"),
    )
    spec = F.concat(F.lit('<TABLE class="x">'), cells(F.lit("Level"), F.lit("1")), cells(F.lit("Color"), F.concat(F.lit("Red &amp;\n "), F.col("p_type"))), cells(F.lit("Core"), F.col("p_brand")), F.when(F.col("p_partkey") % 3 > 0, cells(F.lit("COVERSTOCK"), F.lit("x"))).otherwise(""), F.lit("</TABLE>"))
    return F.when(F.col("p_partkey") % 11 == 0, "<p>none</p>").otherwise(F.concat(numbers, F.lit("<p>a</p>"), spec))


@query(
    f"SELECT p_partkey, CAST(w AS INT) AS weight_lbs, {_rounded(RG)} AS rg, {_rounded(DIFF)} AS differential, CASE WHEN w = 16 THEN 0.016 END AS mass_bias FROM part, (SELECT unnest([16, 15]) AS w) "
    "WHERE p_partkey % 11 > 0 AND (w = 16 OR p_partkey % 4 > 0)"
)
def page_core_numbers(spark, d):
    return _sku_rows(V.spread(_part(spark, d)), B.core_numbers(B.html_tables(_page())))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 11 > 0 THEN 'Red & ' || p_type END AS color, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 11 > 0 THEN p_brand END AS core FROM part")
def page_spec_table(spark, d):
    """Both tables have three known labels unless the second one names a coverstock; then it has most."""
    fields = B.spec_fields(B.spec_table(B.html_tables(_page()), LABELS), LABELS)
    return _part(spark, d).select("p_partkey", fields["color"].alias("color"), fields["core"].alias("core"))


@query("SELECT p_partkey, CAST(1 + (p_size >= 25)::INT AS INT) AS n, 'http://x.test/' || p_partkey || '.jpg' AS first FROM part")
def page_images(spark, d):
    image = lambda src, srcset: F.struct(src.alias("src"), srcset.cast("string").alias("srcset"))
    main = F.concat(F.lit("http://x.test/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    second = F.concat(F.lit("b.jpg 100w, b2.jpg "), (F.col("p_size") * 12).cast("string"), F.lit("w"))
    found = B.image_urls(F.array(image(F.lit("data:abc"), F.lit(None)), image(main, F.lit(None)), image(main, F.lit("x 900w")), image(F.lit("b.jpg"), second)))
    return _part(spark, d).select("p_partkey", F.size(found).alias("n"), found[0].alias("first"))


# ---- scalar rules

STATUS_TEXT = "CASE p_partkey % 6 WHEN 0 THEN 'In Production' WHEN 1 THEN 'Discontinued (production ended)' WHEN 2 THEN 'RETIRED' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'soon' END"


@query(f"SELECT p_partkey, CASE WHEN {STATUS_TEXT} LIKE 'Disc%' OR {STATUS_TEXT} = 'RETIRED' THEN 'retired' WHEN {STATUS_TEXT} LIKE 'In%' THEN 'current' END AS status, CASE WHEN p_size % 2 = 0 THEN 'retired' END AS from_url, "
       "CASE p_size % 4 WHEN 1 THEN 'bag' WHEN 3 THEN 'shoe' ELSE 'ball' END AS kind FROM part")  # fmt: skip
def product_status_and_type(spark, d):
    size = F.col("p_size")
    place = F.when(size % 4 == 1, "bags/current").when(size % 4 == 3, "shoes/retired").otherwise("balls/retired")
    url = F.concat(F.lit("http://x.test/products/"), place, F.lit("/"), F.col("p_partkey").cast("string"))
    return _part(spark, d).select("p_partkey", T.status_text(F.expr(STATUS_TEXT)).alias("status"), T.url_status(url).alias("from_url"), T.product_type(url).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'performance_badge' WHEN p_partkey % 4 = 1 THEN 'core_callout' WHEN p_size = 1 THEN 'main' ELSE 'other' END AS kind, CASE WHEN p_size % 2 = 0 THEN 16 END AS high, CASE WHEN p_size % 2 = 0 THEN CAST(p_size % 10 AS INT) END AS low FROM part")
def image_types(spark, d):
    size = F.col("p_size")
    alt = F.when(F.col("p_partkey") % 4 == 0, "Core and PERFORMANCE").when(F.col("p_partkey") % 4 == 1, "the core of it").when(F.col("p_partkey") % 4 == 2, "a ball")
    url = F.concat(F.lit("/i/16-"), (size % 10).cast("string"), F.when(size % 2 == 0, "_lb_Core.png").otherwise("_lb_core.png"))
    w = T.callout_weights(url)
    return _part(spark, d).select("p_partkey", T.image_type(alt, size).alias("kind"), w["high"].alias("high"), w["low"].alias("low"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Blue' WHEN p_size % 3 = 1 AND p_partkey % 2 = 0 THEN upper(p_brand) WHEN p_partkey % 2 = 0 THEN p_brand END AS color, CASE WHEN p_size % 3 = 0 THEN '60-1 - A' WHEN p_size % 3 = 1 AND p_partkey % 2 = 0 THEN 'PN ' || p_partkey END AS part_number FROM part")
def bag_color_and_part(spark, d):
    size = F.col("p_size")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Bag - Two - "), F.col("p_brand"))).otherwise("Bag")
    own = F.concat(F.lit("PN "), F.col("p_partkey").cast("string"), F.lit(" - "), F.upper("p_brand"))
    lines = F.when(size % 3 == 0, F.array(F.lit("60-1 - A - Blue"), F.lit("none"))).when(size % 3 == 1, F.array(F.lit("60-2 - Pink"), own)).otherwise(F.array(F.lit("a - b"), F.lit("c - d")))
    x = T.color_and_part(name, lines)
    return _part(spark, d).select("p_partkey", x["color"].alias("color"), x["part_number"].alias("part_number"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'retired' END AS status, p_size % 3 > 0 AS tech_data, CASE p_partkey % 4 WHEN 0 THEN 0.012 WHEN 1 THEN CAST(-p_size AS DOUBLE) END AS mass_bias FROM part")
def page_rules(spark, d):
    size = F.col("p_size")
    trail = F.when(size % 4 == 0, F.array(F.lit("Home"), F.lit("Bowling Balls"), F.lit("x"))).when(size % 4 == 1, F.array(F.lit("Bowling Balls Archive"), F.lit("x"))).when(size % 4 == 2, F.array(F.lit("Bowling Balls"))).otherwise(F.array(F.lit("Bowling Balls"), F.lit("Bags"), F.lit("x")))
    href = F.when(size % 3 == 0, "/tech-data/Doc_HP3.pdf").when(size % 3 == 1, "/a/Alpha%20Tech_Data Final.pdf").otherwise("TECH-DATA.PDF")
    bias = F.when(F.col("p_partkey") % 4 == 0, " .012 ").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("-"), size.cast("string"))).when(F.col("p_partkey") % 4 == 2, "Tier 2")
    return _part(spark, d).select("p_partkey", T.breadcrumb_status(trail).alias("status"), T.is_tech_data(href).alias("tech_data"), T.mass_bias(bias).alias("mass_bias"))


URLS = "['http://y.test/a', '//y.test/a', '/b/' || {k}, 'c/' || {k}, '', '#top', 'mailto:x']"


@query("SELECT p_partkey, unnest(['http://y.test/a', 'https://y.test/a', 'https://x.test/b/' || p_partkey, 'https://x.test/p/c/' || p_partkey, 'https://x.test/p/q?z=1', 'https://x.test/p/q#top', 'mailto:x']) AS url FROM part")
def absolute_urls(spark, d):
    k = F.col("p_partkey").cast("string")
    refs = F.array(F.lit("http://y.test/a"), F.lit("//y.test/a"), F.concat(F.lit("/b/"), k), F.concat(F.lit("c/"), k), F.lit(""), F.lit("#top"), F.lit("mailto:x"))
    return _part(spark, d).select("p_partkey", F.explode(refs).alias("href")).select("p_partkey", T.absolute_url(F.lit("https://x.test/p/q?z=1"), F.col("href")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Summarize this review of ' ELSE 'Combine these 2 reviews of ' END || p_name || chr(10) || chr(10) || p_type || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || '---' || chr(10) || p_brand END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || chr(10) || 'Context: ' || p_mfgr ELSE '' END AS prompt FROM (SELECT *, p_brand AS p_mfgr FROM part)")
def summary_prompts(spark, d):
    many = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array("p_type", "p_brand"))
    context = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "")
    return _part(spark, d).select("p_partkey", T.summary_prompt(F.col("p_name"), many, context).alias("prompt"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS released FROM orders")
def iso_dates(spark, d):
    stamp = F.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return V.table(spark, d, "orders").select("o_orderkey", T.iso_date(stamp).alias("released"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 'roto' WHEN p_size % 5 = 2 THEN 'storm' END AS brand FROM part")
def sitemap_brands(spark, d):
    size = F.col("p_size") % 5
    slug = F.when(size == 0, "bags/storm-x").when(size == 1, "roto-grip-x").when(size == 2, "storm-x/").when(size == 3, "").otherwise("other")
    url = F.concat(F.lit("https://x.test/"), slug)
    return _part(spark, d).select("p_partkey", T.brand_of_flat_url(url, (("storm-", "storm"), ("roto-grip-", "roto"), ("storm", "other"))).alias("brand"))


# ---- reconciliation


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '2.6' WHEN 2 THEN '9' END AS rg FROM part")
def custom_field_lookup(spark, d):
    size = F.col("p_size") % 4
    field = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    fields = F.when(size == 0, F.array(field("rg", "1"), field("target rg", "3"), field("radius of gyration (15 lb)", "2.5"))).when(size == 1, F.array(field("rg (x)", "2.6"), field("rg", "2.7"))).when(size == 2, F.array(field("core rg", "9"))).otherwise(F.array(field("target rg", "3")))
    return _part(spark, d).select("p_partkey", W.custom_field(fields, W.FIELD_NAMES["rg"]).alias("rg"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_partkey % 17 AS DOUBLE) WHEN 1 THEN 14.5 END AS weight FROM part")
def variant_weights(spark, d):
    size = F.col("p_size") % 4
    option = lambda n, label: F.struct(F.lit(n).alias("name"), label.cast("string").alias("label"))
    own = F.concat((F.col("p_partkey") % 17).cast("string"), F.lit(" lb"))
    options = F.when(size == 0, F.array(option("Color", F.lit("16")), option("Ball WEIGHT", own))).when(size == 1, F.array(option(None, F.lit("about 14.5")))).when(size == 2, F.array(option("a", F.lit("1")), option("b", F.lit("2")))).otherwise(F.array(option("Weight", F.lit("heavy"))))
    return _part(spark, d).select("p_partkey", W.variant_weight(options).alias("weight"))


OURS_SQL = "ours AS (SELECT p_partkey AS product, w AS weight_lbs, CASE WHEN p_size % 7 > 0 THEN 2.5 + p_size / 1000.0 END AS rg, 0.05 AS differential FROM part, (SELECT unnest([14, 15, 16]) AS w) WHERE (p_partkey + w) % 5 > 0)"
THEIRS_SQL = "theirs AS (SELECT p_partkey AS product, w AS weight_lbs, 2.5 + p_size / 1000.0 + (p_partkey % 3) / 500.0 AS rg, CASE WHEN p_partkey % 4 = 0 THEN 0.06 END AS differential FROM part, (SELECT unnest([13, 15, 16]) AS w) WHERE (p_partkey * 3 + w) % 7 > 0 AND p_partkey % 9 > 0)"


def _sides(spark, d):
    p, size = _part(spark, d), F.col("p_size")
    ours = p.select(F.col("p_partkey").alias("product"), F.explode(F.array(*map(F.lit, (14, 15, 16)))).alias("weight_lbs"), F.when(size % 7 > 0, 2.5 + size / 1000).alias("rg"), F.lit(0.05).alias("differential")).filter("(product + weight_lbs) % 5 > 0")
    theirs = p.select(F.col("p_partkey").alias("product"), F.explode(F.array(*map(F.lit, (13, 15, 16)))).alias("weight_lbs"), (2.5 + size / 1000 + (F.col("p_partkey") % 3) / 500).alias("rg"), F.when(F.col("p_partkey") % 4 == 0, 0.06).alias("differential")).filter("(product * 3 + weight_lbs) % 7 > 0 and product % 9 > 0")
    return ours, theirs


MISMATCH_SQL = (
    f"WITH {OURS_SQL}, {THEIRS_SQL}, j AS (SELECT o.product, o.weight_lbs, o.rg AS a, t.rg AS b, o.differential AS x, t.differential AS y FROM ours o JOIN theirs t USING (product, weight_lbs)) "
    "SELECT product, 'rg_' || weight_lbs || 'lb' AS field_name, round(CAST(a AS DOUBLE), 6) AS current_value, round(CAST(b AS DOUBLE), 6) AS proposed_value FROM j WHERE abs(a - b) > 0.001 {0} "
    "UNION ALL SELECT product, 'differential_' || weight_lbs || 'lb', round(CAST(x AS DOUBLE), 6), round(CAST(y AS DOUBLE), 6) FROM j WHERE abs(x - y) > 0.001 {0}"
)


def _mismatches(ours, theirs):
    found = W.spec_mismatches(ours, theirs, ["product"], ("rg", "differential"))
    return found.select("product", "field_name", F.round("current_value", 6).alias("current_value"), F.round("proposed_value", 6).alias("proposed_value"))


@query(MISMATCH_SQL.format(""))
def qa_mismatches(spark, d):
    return _mismatches(*_sides(spark, d))


@query(MISMATCH_SQL.format("AND weight_lbs = 15"))
def reference_weight_accuracy(spark, d):
    ours, theirs = _sides(spark, d)
    return _mismatches(ours.filter(F.col("weight_lbs") == W.REFERENCE_WEIGHT), theirs)


@query(
    f"WITH {OURS_SQL}, {THEIRS_SQL}, both_ AS (SELECT product FROM ours INTERSECT SELECT product FROM theirs) "
    "SELECT product, weight_lbs, 'sku_weight_missing_in_bigcommerce' AS field_name FROM ours o WHERE product IN (SELECT product FROM both_) AND NOT EXISTS (SELECT 1 FROM theirs t WHERE t.product = o.product AND t.weight_lbs = o.weight_lbs) "
    "UNION ALL SELECT product, weight_lbs, 'sku_weight_missing_in_our_catalog' FROM theirs t WHERE product IN (SELECT product FROM both_) AND NOT EXISTS (SELECT 1 FROM ours o WHERE t.product = o.product AND t.weight_lbs = o.weight_lbs)"
)
def weight_mismatch_reviews(spark, d):
    return W.weight_mismatches(*_sides(spark, d))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'high' ELSE 'low' END AS triage FROM documents")
def candidate_triage(spark, d):
    confidence = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "medium")
    return V.table(spark, d, "documents").select("doc_id", T.triage(confidence).alias("triage"))


@query("SELECT p_partkey, count(*) AS n FROM part GROUP BY ALL")
def slug_join(spark, d):
    names = _part(spark, d).select("p_partkey", T.slug(F.concat(F.lit("  Fury "), F.upper("p_name"), F.lit("/X  "), F.col("p_partkey").cast("string")), True).alias("s"))
    slugs = _part(spark, d).select(T.slug(F.concat(F.lit("fury "), F.lower("p_name"), F.lit("x "), F.col("p_partkey").cast("string"))).alias("s"))
    return names.join(slugs, "s").groupBy("p_partkey").agg(F.count("*").alias("n"))


# ---- joins, predicates, aggregates


@query("SELECT c_custkey, n.n_name, r.r_name, n.n_nationkey IS NULL AS nationless FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON c_nationkey = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey")
def dimension_chain(spark, d):
    n = V.table(spark, d, "nation").filter("n_nationkey % 3 > 0")
    j = V.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", "n_name", "r_name", F.col("n_nationkey").isNull().alias("nationless"))


@query("SELECT c_custkey, n_name FROM customer JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON c_nationkey = n_nationkey")
def public_dimension_join(spark, d):
    n = V.table(spark, d, "nation").filter("n_nationkey % 3 > 0")
    return V.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(f"{V.with_sql('products')}, f AS (SELECT p_partkey AS product, CASE WHEN p_size % 2 = 0 THEN 'current' ELSE 'retired' END AS status FROM part WHERE p_size % 5 > 0) SELECT product, coalesce(f.status, p.status) AS status, coalesce(f.status <> p.status, false) AS changed FROM products p LEFT JOIN f USING (product)")
def update_from_join(spark, d):
    f = _part(spark, d).filter("p_size % 5 > 0").select(F.col("p_partkey").alias("product"), F.when(F.col("p_size") % 2 == 0, "current").otherwise("retired").alias("found"))
    return G.update_from(V.products(spark, d).select("product", "status"), f, "product", "status", "found")


@query("SELECT event_id, user_id FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL")
def not_in_set(spark, d):
    kept = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return V.table(spark, d, "events").join(kept, "event_type", "left_anti").select("event_id", "user_id")


@query(f"{V.with_sql('stock')} SELECT id, sku, quantity IS NULL AS missing, quantity IS NOT NULL AS has_quantity, coalesce(quantity, sku % 10) AS effective, quantity IS NULL AND sku % 2 = 0 AS needs_check FROM stock")
def predicate_projections(spark, d):
    s = V.stock_history(spark, d)
    q = F.col("quantity")
    return s.select("id", "sku", q.isNull().alias("missing"), q.isNotNull().alias("has_quantity"), F.coalesce(q, F.col("sku") % 10).alias("effective"), (q.isNull() & (F.col("sku") % 2 == 0)).alias("needs_check"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'sku' WHEN 1 THEN 'product' END AS scope, CASE p_size % 4 WHEN 0 THEN 'rg' WHEN 1 THEN 'color' END AS col, CASE WHEN p_size % 4 = 0 THEN CAST(p_partkey % 7 + 10 AS INT) END AS weight_lbs FROM part")
def review_fields(spark, d):
    size = F.col("p_size") % 4
    name = F.when(size == 0, F.concat(F.lit("rg_"), (F.col("p_partkey") % 7 + 10).cast("string"), F.lit("lb"))).when(size == 1, "color").when(size == 2, "rg_lb")
    x = W.review_field(name)
    return _part(spark, d).select("p_partkey", x["scope"].alias("scope"), x["column"].alias("col"), x["weight_lbs"].alias("weight_lbs"))


@query(f"{V.with_sql('videos')} SELECT product, min(published_at) AS first_video FROM videos GROUP BY product")
def earliest_video(spark, d):
    return V.videos(spark, d).groupBy("product").agg(F.min("published_at").alias("first_video"))


@query("SELECT p_partkey, nullif(CAST(CASE WHEN p_size % 3 = 1 THEN p_size ELSE p_partkey END AS DOUBLE), 0) AS cost FROM part")
def first_variant_cost(spark, d):
    first = F.when(F.col("p_size") % 3 == 0, 0.0).when(F.col("p_size") % 3 == 1, F.col("p_size").cast("double"))
    return _part(spark, d).select("p_partkey", T.first_cost(F.array(first, F.col("p_partkey").cast("double"))).alias("cost"))


@query(f"{V.with_sql('skus')} SELECT product, arg_max(weight_lbs, (weight_lbs = 15, weight_lbs)) AS weight_lbs, arg_max(sku, (weight_lbs = 15, weight_lbs)) AS sku FROM skus WHERE sku % 4 > 0 GROUP BY product")
def training_sku(spark, d):
    """The 15 lb SKU if it has a differential, else the heaviest that has one."""
    skus = V.skus(spark, d).withColumn("differential", F.when(F.col("sku") % 4 > 0, 0.05))
    return R.training_sku(skus).select("product", "weight_lbs", "sku")


@query("SELECT l_partkey AS slug, CASE WHEN bool_or(l_returnflag <> 'R') THEN 'current' ELSE 'retired' END AS status, arg_max(l_shipdate, (l_orderkey, l_linenumber, l_shipdate)) AS lastmod FROM lineitem WHERE l_suppkey % 4 = 0 GROUP BY l_partkey")
def discovery_status(spark, d):
    x = V.table(spark, d, "lineitem").filter("l_suppkey % 4 = 0")
    return W.discovery_entries(x, "l_partkey", F.col("l_returnflag") == "R", "l_shipdate", ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("SELECT o_orderpriority AS run, count(*) AS checked, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY ALL")
def run_counters(spark, d):
    return C.run_counts(V.table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query(f"{V.with_sql('videos')}, v AS (SELECT product, order_id, line_id, CAST(row_number() OVER (PARTITION BY product ORDER BY published_at, order_id, line_id) - 1 AS INT) AS display_order FROM videos WHERE review = 'approved'), n AS (SELECT * FROM videos WHERE review = 'pending') "
       "SELECT product, order_id, line_id, display_order FROM v UNION ALL SELECT n.product, n.order_id, n.line_id, CAST(coalesce(t, -1) + row_number() OVER (PARTITION BY n.product ORDER BY n.order_id, n.line_id) AS INT) FROM n LEFT JOIN (SELECT product, max(display_order) AS t FROM v GROUP BY product) USING (product)")  # fmt: skip
def display_orders(spark, d):
    """Old images are numbered from 0 by time; new ones go on after the last."""
    v = V.videos(spark, d)
    old = W.next_ordinals(v.filter("false").select("product", F.lit(0).alias("display_order")), v.filter("review = 'approved'"), "product", ["published_at", "order_id", "line_id"])
    old = old.select("product", "order_id", "line_id", "display_order")
    new = W.next_ordinals(old, v.filter("review = 'pending'").select("product", "order_id", "line_id"), "product", ["order_id", "line_id"])
    return old.union(new.select(*old.columns))


@query("SELECT p_partkey, min(side) AS side FROM (SELECT p_partkey, 'current' AS side FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, 'retired' FROM part WHERE p_size >= 20) GROUP BY p_partkey")
def keyed_union(spark, d):
    """Rows of the current list, and those of the retired list that it lacks."""
    p = _part(spark, d)
    current, retired = p.filter("p_size < 30").select("p_partkey"), p.filter("p_size >= 20").select("p_partkey")
    return G.keyed_union(current.withColumn("side", F.lit("current")), retired.withColumn("side", F.lit("retired")), ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'changed' END AS diff FROM part WHERE p_size > 5 AND (p_partkey % 3 = 0 OR p_partkey % 3 = 1)")
def new_and_changed(spark, d):
    p = _part(spark, d)
    old = p.filter(F.col("p_partkey") % 3 != 0).select("p_partkey", F.lit("v1").alias("version"))
    new = p.filter("p_size > 5").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, "v2").otherwise("v1").alias("version"))
    return G.snapshot_diff(old, new, "p_partkey", "version").filter("diff <> 'unchanged'")


# ---- updates


def _skus_old(spark, d):
    p = _part(spark, d)
    return p.filter("p_size < 35").select(F.col("p_partkey").alias("product"), F.lit(15).alias("weight_lbs"), (F.col("p_size") / 10).alias("rg"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("double")).alias("mass_bias"), F.lit("pdf").alias("source"))


@query("WITH o AS (SELECT p_partkey AS product, p_size / 10 AS rg, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS DOUBLE) END AS mass_bias FROM part WHERE p_size < 35), n AS (SELECT p_partkey AS product, p_size / 20 AS rg, CASE WHEN p_partkey % 3 = 0 THEN 7.5 END AS mass_bias FROM part WHERE p_size > 15) "
       "SELECT product, CAST(15 AS INT) AS weight_lbs, CASE WHEN n.product IS NULL THEN o.rg ELSE n.rg END AS rg, coalesce(n.mass_bias, o.mass_bias) AS mass_bias, CASE WHEN o.product IS NULL THEN 'page' ELSE 'pdf' END AS source FROM o FULL JOIN n USING (product)")  # fmt: skip
def upsert_skus(spark, d):
    """rg is overwritten, a known mass bias isn't lost, the source stays."""
    new = _part(spark, d).filter("p_size > 15").select(F.col("p_partkey").alias("product"), F.lit(15).alias("weight_lbs"), (F.col("p_size") / 20).alias("rg"), F.when(F.col("p_partkey") % 3 == 0, 7.5).alias("mass_bias"), F.lit("page").alias("source"))
    return G.upsert(_skus_old(spark, d), new, ["product", "weight_lbs"], {"mass_bias": G.NEW_ELSE_OLD, "source": G.KEEP})


@query("WITH o AS (SELECT p_brand AS name, min(p_type) AS kind FROM part WHERE p_size < 10 GROUP BY p_brand HAVING count(*) % 2 = 0), n AS (SELECT p_brand AS name, max(p_type) AS kind FROM part GROUP BY p_brand) SELECT name, coalesce(o.kind, n.kind) AS kind, o.name IS NULL AS created FROM o FULL JOIN n USING (name)")
def get_or_create_dimension(spark, d):
    p = _part(spark, d)
    old = p.filter("p_size < 10").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("kind"), F.count("*").alias("n")).filter("n % 2 = 0").drop("n").withColumn("created", F.lit(False))
    new = p.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_type").alias("kind")).withColumn("created", F.lit(True))
    return G.upsert(old, new, ["name"], {"kind": G.OLD_ELSE_NEW, "created": G.KEEP})


IMAGES = "old_ AS (SELECT p_partkey % 50 AS product, p_partkey AS url, 'old' AS kind FROM part WHERE p_size < 30), new_ AS (SELECT p_partkey % 50 AS product, p_partkey AS url, 'new' AS kind FROM part WHERE p_size > 20 AND p_partkey % 50 < 40)"


def _images(spark, d):
    p = _part(spark, d).select((F.col("p_partkey") % 50).alias("product"), F.col("p_partkey").alias("url"), "p_size")
    old = p.filter("p_size < 30").select("product", "url", F.lit("old").alias("kind"))
    return old, p.filter("p_size > 20 and product < 40").select("product", "url", F.lit("new").alias("kind"))


@query(f"WITH {IMAGES} SELECT product, url, coalesce(n.kind, o.kind) AS kind FROM old_ o FULL JOIN new_ n USING (product, url) WHERE n.url IS NOT NULL OR product NOT IN (SELECT product FROM new_)")
def replace_images(spark, d):
    return W.replace_children(*_images(spark, d), "product", "url", {})


@query(f"WITH {IMAGES} SELECT product, url, coalesce(n.kind, o.kind) AS kind FROM old_ o FULL JOIN new_ n USING (product, url)")
def merge_images(spark, d):
    return W.replace_children(*_images(spark, d), "product", "url", {}, delete=False)


@query(f"WITH {IMAGES} SELECT product, url FROM old_ ANTI JOIN new_ USING (product, url)")
def orphan_objects(spark, d):
    old, new = _images(spark, d)
    return G.missing_from(old, new, ["product", "url"]).select("product", "url")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, p_partkey % 16 + 1) AS oil_rating FROM part")
def estimate_if_null(spark, d):
    known = F.when(F.col("p_size") % 2 == 0, F.col("p_size"))
    return _part(spark, d).select("p_partkey", F.when(known.isNull(), F.col("p_partkey") % 16 + 1).otherwise(known).alias("oil_rating"))


@query(
    "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 80 < 61 THEN 'rejected' WHEN p_size % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey % 80 AS INT) ELSE 100 END AS duration_seconds, "
    "CASE WHEN p_size % 3 < 2 THEN TIMESTAMP '2024-05-01' END AS fetched_at, CASE WHEN p_size % 2 = 1 THEN TIMESTAMP '2020-01-01' WHEN p_size % 3 = 0 AND p_partkey % 80 < 61 THEN TIMESTAMP '2024-05-01' END AS resolved_at FROM part"
)
def refresh_stats(spark, d):
    p, size = _part(spark, d), F.col("p_size")
    old = p.select(F.col("p_partkey").alias("id"), F.when(size % 2 == 0, "approved").otherwise("rejected").alias("status"), F.lit(100).alias("duration_seconds"), F.lit(None).cast("timestamp").alias("fetched_at"), F.when(size % 2 == 1, F.lit(datetime(2020, 1, 1))).alias("resolved_at"))
    stats = p.filter("p_size % 3 < 2").select(F.col("p_partkey").alias("id"), (size % 3 == 0).alias("answered"), F.when(size % 3 == 0, (F.col("p_partkey") % 80).cast("int")).alias("duration_seconds"))
    return W.refresh_stats(old, stats, ["duration_seconds"], NOW)


MOVES = "v AS (SELECT l_partkey AS product, l_orderkey % 50 AS video, max(CASE WHEN l_linenumber % 2 = 0 THEN l_comment_ END) AS summary, 'approved' AS status FROM (SELECT *, CAST(l_suppkey AS VARCHAR) AS l_comment_ FROM lineitem) GROUP BY ALL), m AS (SELECT product, min(video) AS video, product + 1 AS target FROM v WHERE product % 3 = 0 GROUP BY product)"


@query(
    f"WITH {MOVES}, moved AS (SELECT m.target AS product, v.video, v.summary, v.status FROM v JOIN m USING (product, video)), stay AS (SELECT v.product, v.video, v.summary, CASE WHEN m.target IS NOT NULL THEN 'rejected' ELSE v.status END AS status FROM v LEFT JOIN m USING (product, video)) "
    "SELECT product, video, coalesce(s.summary, x.summary) AS summary, coalesce(s.status, x.status) AS status FROM stay s FULL JOIN moved x USING (product, video)"
)
def reassign_videos(spark, d):
    x = V.table(spark, d, "lineitem")
    v = x.groupBy(F.col("l_partkey").alias("product"), (F.col("l_orderkey") % 50).alias("video")).agg(F.max(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string"))).alias("summary"), F.lit("approved").alias("status"))
    moves = v.filter("product % 3 = 0").groupBy("product").agg(F.min("video").alias("video")).withColumn("target", F.col("product") + 1)
    return W.reassign(v, moves, ["summary"])


@query("SELECT p_partkey % 50 AS product, p_partkey AS url, CASE WHEN p_partkey % 50 < 25 THEN p_partkey = p_partkey % 50 + 50 ELSE p_size % 2 = 0 END AS thumbnail, CASE WHEN p_partkey % 50 = 7 AND p_partkey IN (57, 107) THEN CASE p_partkey WHEN 107 THEN 0 ELSE 1 END ELSE CAST(p_size AS INT) END AS display_order FROM part")
def thumbnails_and_order(spark, d):
    rows = _part(spark, d).select((F.col("p_partkey") % 50).alias("product"), F.col("p_partkey").alias("url"), (F.col("p_size") % 2 == 0).alias("thumbnail"), F.col("p_size").cast("int").alias("display_order"))
    chosen = spark.range(25).select(F.col("id").alias("product"), (F.col("id") + 50).alias("url"))
    orders = spark.createDataFrame([(7, [107, 57])], "product long, ids array<long>")
    return W.reorder(W.exclusive_flag(rows, chosen, "product", "url", "thumbnail"), orders, "product", "url").select("product", "url", "thumbnail", "display_order")


SOURCES = "s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 40 AS product, l_suppkey % 5 AS site, l_returnflag AS url, CASE WHEN l_linenumber % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, l_shipdate AS created_at FROM lineitem WHERE l_orderkey % 7 = 0), f AS (SELECT product, site, 'new' AS url FROM (SELECT unnest(range(45)) AS product), (SELECT unnest(range(3)) AS site))"


@query(
    f"WITH {SOURCES}, b AS (SELECT product, site, arg_min(id, (status <> 'approved', created_at, id)) AS first FROM s GROUP BY ALL) SELECT s.id, s.product, s.site, CASE WHEN s.id = b.first AND f.url IS NOT NULL THEN f.url ELSE s.url END AS url, s.status FROM s JOIN b USING (product, site) LEFT JOIN f USING (product, site) "
    "UNION ALL SELECT NULL, product, site, url, 'pending' FROM f ANTI JOIN b USING (product, site)"
)
def repair_source_urls(spark, d):
    x = V.table(spark, d, "lineitem").filter("l_orderkey % 7 = 0")
    s = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 40).alias("product"), (F.col("l_suppkey") % 5).alias("site"), F.col("l_returnflag").alias("url"), F.when(F.col("l_linenumber") % 2 == 0, "approved").otherwise("pending").alias("status"), F.lit(True).alias("active"), F.col("l_shipdate").alias("created_at"))
    f = spark.range(45).select(F.col("id").alias("product"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("site"), F.lit("new").alias("url"))
    return W.repair_urls(s, f).select("id", "product", "site", "url", "status")


# ---- paged sources: the pages stand in a table of responses


def _listing(key: str, row: str):
    return F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("id"), F.col(row).alias("handle")))), lambda x: x).alias("products")))


@query("SELECT l_suppkey AS collection, l_orderkey AS id FROM (SELECT l_suppkey, l_orderkey, CAST(floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1) / 20) AS INT) AS page FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) WHERE page < 20")
def json_collection_pages(spark, d):
    """Pages of 20 up to the first short one, 20 pages at most."""
    from pyspark.sql import Window

    x = V.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    paged = x.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey")) - 1) / 20).cast("int") + 1)
    pages = paged.groupBy(F.col("l_suppkey").alias("collection"), "page").agg(_listing("l_orderkey", "l_orderkey").alias("body"))
    late = pages.filter("page = 1").select("collection", F.lit(40).alias("page"), "body")  # never asked for
    rows = X.collection_rows(pages.union(late), "collection", "products array<struct<id:bigint,handle:string>>", "products", 20)
    return rows.select("collection", "id")


@query("SELECT l_orderkey % 3 AS site, l_orderkey AS id FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey % 10 < 4")
def counted_pages(spark, d):
    """Pages up to the number that the first one states."""
    x = V.table(spark, d, "lineitem").select("l_orderkey").distinct()
    pages = x.groupBy((F.col("l_orderkey") % 3).alias("site"), (F.col("l_orderkey") % 10 + 1).alias("page")).agg(F.collect_list("l_orderkey").alias("ids"))
    body = F.to_json(F.struct(F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("data"), F.struct(F.lit(4).alias("total_pages")).alias("pagination")))
    got = X.counted_rows(pages.select("site", "page", body.alias("body")), "site", "data array<struct<id:bigint>>,pagination struct<total_pages:int>")
    return got.select("site", "id")


@query("SELECT l_orderkey AS id, max(l_suppkey) AS supplier FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def batched_lookup(spark, d):
    wanted = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.table(spark, d, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_suppkey").alias("supplier"))


@query("SELECT DISTINCT 'https://x.test/n_' || (p_size * 7) AS url FROM part")
def netsuite_index(spark, d):
    html = F.concat(F.lit("<a href='/shop/n_"), (F.col("p_size") * 7).cast("string"), F.lit("?a=1'>x</a><a href='http://z/n_"), (F.col("p_size") * 7).cast("string"), F.lit("'>y</a><a href='m_1'>z</a>"))
    return X.index_urls(_part(spark, d).select(html.alias("html"), F.lit("https://x.test/shop/all.html").alias("page")), "html", "page")


@query("SELECT p_partkey, CAST(1 + p_size % 3 AS INT) AS n, p_size % 3 = 2 AS may_be_cut FROM part")
def listing_links(spark, d):
    size = F.col("p_size") % 3
    link = lambda i: F.lit(f"<a href='/p/{i}-bowling-ball'>x</a><a href='/p/{i}-bag'>y</a>")
    html = F.concat(link(1), link(1), F.when(size > 0, link(2)).otherwise(""), F.when(size > 1, link(3)).otherwise(""))
    found = X.listing_links(html, r"href='([^']*-bowling-ball)'", 3)
    return _part(spark, d).select("p_partkey", F.size(found["links"]).alias("n"), found["may_be_cut"].alias("may_be_cut"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name END AS title, CASE WHEN p_size % 4 > 0 THEN CAST(p_size AS INT) END AS grams FROM part")
def product_documents(spark, d):
    doc = F.to_json(F.struct(F.struct(F.col("p_name").alias("title"), F.array(F.struct(F.col("p_size").alias("grams"))).alias("variants")).alias("product")))
    body = F.when(F.col("p_size") % 4 > 0, doc).otherwise("{broken")
    x = X.product_document(body)
    return _part(spark, d).select("p_partkey", x["title"].alias("title"), x["variants"][0]["grams"].alias("grams"))


# ---- sinks and queues


@query("SELECT product, CAST(count(*) AS BIGINT) AS rows, CAST(ceil(count(*) / 10) AS BIGINT) AS batches, least(10, count(*)) AS largest FROM (SELECT l_partkey % 20 AS product FROM lineitem) GROUP BY product")
def message_batches(spark, d):
    """Messages in batches of ten for each queue."""
    rows = V.table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("product"), "l_orderkey", "l_linenumber", "l_suppkey")
    b = G.message_batches(rows, "product", ["l_orderkey", "l_linenumber", "l_suppkey"])
    sizes = b.groupBy("product", "batch").agg(F.size(F.first("messages")).cast("long").alias("n"))
    return sizes.groupBy("product").agg(F.sum("n").alias("rows"), F.count("*").alias("batches"), F.max("n").alias("largest"))


@query("SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN user_id % 4 >= 2 THEN 'dead' ELSE 'retry' END AS outcome, CAST(user_id % 4 + 1 AS INT) AS attempts FROM events")
def queue_attempts(spark, d):
    """A message that failed three times is dead."""
    e = V.table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 4).cast("int").alias("attempts"), F.coalesce(F.col("event_type") != "error", F.lit(False)).alias("succeeded"))
    return G.attempted(e).select("event_id", "user_id", "outcome", "attempts")


# ---- forecast


@query(
    f"{STOCK}, {LATEST}, f AS (SELECT sku, quantity, adu, CASE WHEN quantity <= 0 THEN 0 WHEN adu > 0 THEN quantity / adu END AS dos FROM latest LEFT JOIN adu USING (sku)) "
    "SELECT sku, unnest(range(0, 1 + CAST(floor(least(coalesce(dos, 90), 30)) AS BIGINT))) AS day, round(greatest(0, quantity - coalesce(adu, 0) * unnest(range(0, 1 + CAST(floor(least(coalesce(dos, 90), 30)) AS BIGINT)))), 6) AS left_ FROM f"
)
def projected_stock(spark, d):
    """A point for each day until the stock or a range of 30 days ends."""
    x = I.projection(V.stock_history(spark, d), V.STOCK_AS_OF, STOCK_DAYS, "30D")
    return x.select("sku", "day", F.round("quantity", 6).alias("left_"))


@query(f"{STOCK}, {LATEST} SELECT sku, CASE WHEN quantity <= 0 THEN TIMESTAMP '2024-01-31' WHEN adu > 0 THEN TIMESTAMP '2024-01-31' + INTERVAL 1 SECOND * CAST(floor(quantity / adu * 86400) AS BIGINT) END AS stockout FROM latest LEFT JOIN adu USING (sku)")
def stockout_times(spark, d):
    return I.forecast(V.stock_history(spark, d), V.STOCK_AS_OF, STOCK_DAYS).select("sku", F.col("stockout_at").alias("stockout"))


@query(f"{V.with_sql('stock')} SELECT 'D7' AS preset, count(*) AS n FROM stock WHERE checked_at >= TIMESTAMP '2024-01-24' UNION ALL SELECT '1Y', count(*) FROM stock WHERE checked_at >= TIMESTAMP '2023-01-31' UNION ALL SELECT 'All', count(*) FROM stock")
def chart_ranges(spark, d):
    s = V.stock_history(spark, d)
    n = lambda name, p: s.filter(I.in_range("checked_at", p, V.STOCK_AS_OF)).select(F.lit(name).alias("preset")).groupBy("preset").agg(F.count("*").alias("n"))
    return n("D7", "7D").union(n("1Y", "1Y")).union(n("All", "All"))


# ---- names


@query("SELECT p_partkey, 'Storm™ Big  Ball' AS raw, 'Storm Big Ball' AS cover, 'Big Two' AS short, 'storm-pyyro' AS place, 'a_b_' || p_size || '_url' AS resource FROM (SELECT * FROM part)")
def name_rules(spark, d):
    raw = F.lit("Storm™ Big  Ball")
    short = T.strip_generic(F.lit("Big  Bowling Ball Two"))
    resource = T.resource_key(F.concat(F.lit("A & b--"), F.col("p_size").cast("string"), F.lit("!")))
    return _part(spark, d).select("p_partkey", raw.alias("raw"), T.cover_name(raw).alias("cover"), short.alias("short"), T.slug(F.lit(" Storm P/Yyro "), True).alias("place"), resource.alias("resource"))


@query("SELECT a.p_partkey, a.p_partkey % 3 > 0 AS plausible FROM part a")
def plausible_names(spark, d):
    a = F.concat(F.lit("Xy Phaze"), F.col("p_partkey").cast("string"))
    b = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("phaze"), F.col("p_partkey").cast("string"), F.lit("! of"))).otherwise("xy of")
    return _part(spark, d).select("p_partkey", M.plausible(a, b).alias("plausible"))


@query("SELECT p_partkey AS our_id, 'listing' AS field_name, 'missing' AS reason FROM part WHERE p_size % 2 = 1")
def coverage_gaps(spark, d):
    m = _part(spark, d).select(F.col("p_partkey").alias("our_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("their_id"))
    return M.coverage_gap(m)
