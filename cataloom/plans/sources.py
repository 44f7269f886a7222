"""Queries of crawls, OCR blocks, search responses, captions, transcripts, labelled texts and names, each beside its DuckDB SQL.

The inputs are built from the rows of part, broken ones among them, and the SQL computes the result from the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import match as M
from ..sources import extract as X
from ..sources import views as V
from .queries import query


def _part(spark, d):
    return V.table(spark, d, "part")


@query(
    "SELECT '/c/' || (p_partkey - p_partkey % 7) AS start, '/c/' || p_partkey AS page, CAST(p_partkey % 7 AS INT) AS depth FROM part "
    "WHERE p_partkey % 7 < 5 AND (p_partkey - p_partkey % 7) % 3 < 2 OR p_partkey % 7 = 0"
)
def listing_crawl(spark, d):
    """Chains of seven pages, five followed; a third of the first pages link to themselves."""
    k = F.col("p_partkey")
    after = F.when((k % 7 == 0) & (k % 3 == 2), k).when(k % 7 == 6, k - 6).otherwise(k + 1)
    html = F.concat(F.lit("<a href='/ball/1'>x</a> <a class=\"next page-numbers\" href=\"/c/"), after, F.lit('">next</a>'))
    link = F.nullif(F.regexp_extract(html, r'class="next[^"]*" href="([^"]+)"', 1), F.lit(""))
    pages = _part(spark, d).select(F.concat(F.lit("/c/"), k).alias("page"), link.alias("next"))
    return X.crawl(pages, F.substring("page", 4, 20).cast("long") % 7 == 0, 5)


@query(
    "WITH p AS (SELECT 't' || p_partkey AS tbl, * FROM part WHERE p_partkey % 4 > 0) SELECT tbl, 1 AS \"row\", 1 AS col, p_name AS text FROM p UNION ALL "
    "SELECT tbl, 1, 2, CAST(p_size AS VARCHAR) FROM p UNION ALL SELECT tbl, 2, 1, '' FROM p UNION ALL SELECT tbl, 2, 2, '' FROM p"
)
def ocr_cells(spark, d):
    """A cell of some words, one of one, one without children and one whose child isn't there; every fourth block is no table."""
    k = F.col("p_partkey")
    none = F.lit(None)
    ident = lambda kind: F.concat(F.lit(kind), k)

    def block(name, kind, row=none, col=none, text=none, children=none):
        return F.struct(name.alias("id"), kind.alias("kind"), row.cast("int").alias("row"), col.cast("int").alias("col"), text.cast("string").alias("text"), children.cast("array<string>").alias("children"))

    cell = lambda name, row, col, children: block(ident(name), F.lit("CELL"), F.lit(row), F.lit(col), none, children)
    words = F.transform(F.split("p_name", " "), lambda w, i: block(F.concat(F.lit("w"), k, F.lit("_"), i), F.lit("WORD"), text=w))
    named = F.transform(words, lambda w: w["id"])
    fixed = F.array(
        block(ident("t"), F.when(k % 4 > 0, "TABLE").otherwise("LINE"), children=F.array(*map(ident, "abcd"))),
        cell("a", 1, 1, named), cell("b", 1, 2, F.array(ident("n"))), cell("c", 2, 1, none), cell("d", 2, 2, F.array(ident("gone"))),
        block(ident("n"), F.lit("WORD"), text=F.col("p_size")),
    )
    blocks = _part(spark, d).select(F.inline(F.concat(fixed, words)))
    return X.ocr_grid(blocks)


@query(
    "SELECT 'v' || p_partkey AS video, p_name AS title, p_brand AS channel, CAST(epoch(TIMESTAMP '2024-01-02 03:04:00') AS BIGINT) + p_size AS published, 'h' || p_partkey AS thumbnail FROM part WHERE p_partkey % 5 > 0 "
    "UNION ALL SELECT 'w' || p_partkey, 'A \"' || p_type || '\"', NULL, NULL, 'd' || p_partkey FROM part WHERE p_partkey % 5 > 0"
)
def video_search_rows(spark, d):
    """Two items a body, the second without a high thumbnail, a channel or a readable date; every fifth body is cut off."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    url = lambda kind: F.struct(F.concat(F.lit(kind[0]), k).alias("url")).alias(kind)

    def item(kind, *snippet):
        return F.struct(F.struct(F.concat(F.lit(kind), k).alias("videoId")).alias("id"), F.struct(*snippet).alias("snippet"))

    at = F.format_string("2024-01-02T03:04:%02dZ", size % 60)
    first = F.to_json(item("v", F.col("p_name").alias("title"), F.col("p_brand").alias("channelTitle"), at.alias("publishedAt"), F.struct(url("default"), url("high")).alias("thumbnails")))
    second = F.to_json(item("w", F.concat(F.lit('A "'), "p_type", F.lit('"')).alias("title"), F.lit("soon").alias("publishedAt"), F.struct(url("default")).alias("thumbnails")))
    body = F.concat(F.lit('{"items":['), first, F.lit(","), second, F.when(k % 5 > 0, "]}").otherwise(""))
    rows = X.video_results(_part(spark, d).select(body.alias("body")), "body")
    return rows.select("video", "title", "channel", F.unix_timestamp("published_at").alias("published"), "thumbnail")


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'human' WHEN 2 THEN 'asr' WHEN 3 THEN 'first' WHEN 4 THEN 'de' END || CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN CAST(p_size AS VARCHAR) END AS url, "
    "CASE p_partkey % 6 WHEN 1 THEN 'en-GB' WHEN 2 THEN 'en' WHEN 3 THEN 'en' WHEN 4 THEN 'de' END AS language FROM part"
)
def caption_tracks(spark, d):
    """No list, one with both kinds of English, spoken English only, two by people, no English, and broken JSON."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    track = lambda name, language, kind="": F.concat(F.lit('{"baseUrl":"' + name), size, F.lit(f'","languageCode":"{language}"' + (f',"kind":"{kind}"' if kind else "") + "}"))
    listed = lambda *t: F.concat(F.lit('<script>"captionTracks":[\n'), F.concat_ws(",\n", *t), F.lit('],"audio":[1]</script>'))
    german, asr = track("de", "de"), track("asr", "en", "asr")
    html = F.when(k % 6 == 0, "<p>none</p>").when(k % 6 == 1, listed(german, asr, track("human", "en-GB"))).when(k % 6 == 2, listed(german, asr))
    html = html.when(k % 6 == 3, listed(track("first", "en"), track("second", "en-US"))).when(k % 6 == 4, listed(german, track("fr", "fr"))).otherwise('"captionTracks":[{"baseUrl":]')
    found = X.caption_track(html)
    return _part(spark, d).select("p_partkey", found["baseUrl"].alias("url"), found["languageCode"].alias("language"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' a & <b>' END END AS said FROM part")
def transcript_text(spark, d):
    """Words as nodes with space around them, a blank node and one of references; empty and missing transcripts."""
    k = F.col("p_partkey")
    nodes = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("<text start='1'>\n "), w, F.lit(" </text>"))), "")
    xml = F.when(k % 5 == 0, "<transcript/>").otherwise(F.concat(F.lit("<transcript>"), nodes, F.lit("<text> </text><text>a &amp; &lt;b&gt;</text></transcript>")))
    return _part(spark, d).select("p_partkey", X.transcript(F.when(k % 7 > 0, xml)).alias("said"))


@query(
    "WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'RG ' || p_size || '.5 in' WHEN 1 THEN '-0.0' || p_size WHEN 2 THEN 'diff .0' || p_size || ' in' WHEN 3 THEN p_size || '.2.3' WHEN 4 THEN 'none' END AS t FROM part) "
    "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(t, '[0-9.]+'), '') AS DOUBLE) AS unsigned_, TRY_CAST(nullif(regexp_extract(t, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE) AS signed_, "
    "CASE WHEN regexp_full_match(t, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(t AS DOUBLE) END AS whole FROM t"
)
def number_variants(spark, d):
    """The three ways to read a number: digits and points only, with sign, and of texts that are numbers."""
    k = F.col("p_partkey")
    size = F.col("p_size")
    cat = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    t = F.when(k % 6 == 0, cat("RG ", size, ".5 in")).when(k % 6 == 1, cat("-0.0", size)).when(k % 6 == 2, cat("diff .0", size, " in")).when(k % 6 == 3, cat(size, ".2.3")).when(k % 6 == 4, "none")
    return _part(spark, d).select("p_partkey", T.number(t, False).alias("unsigned_"), T.number(t).alias("signed_"), T.mass_bias(t).alias("whole"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END END AS core, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 > 0 THEN p_name END AS cover FROM part"
)
def labelled_fields(spark, d):
    """Labels in any case, of which the last line counts; lines without a label or with one in their middle; missing texts."""
    k = F.col("p_partkey")
    again = F.when(k % 2 == 0, F.concat(F.lit("core: "), "p_type")).otherwise("the core: none")
    cover = F.when(k % 3 > 0, F.concat(F.lit("COVER TYPE:"), "p_name"))
    text = F.when(k % 5 > 0, F.concat_ws("\n", F.concat(F.lit(" Core:  "), "p_brand", F.lit("\t\r")), F.lit("  "), cover, again))
    fields = X.label_fields(text, ["Core:", "Cover type:"])
    return _part(spark, d).select("p_partkey", fields["Core:"].alias("core"), fields["Cover type:"].alias("cover"))


@query(
    "WITH w AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_type || ' of xy' ELSE 'xy' END AS other FROM part) "
    "SELECT p_partkey, len(list_filter(list_intersect(string_split(p_name, ' '), string_split(regexp_replace(lower(other), '[^a-z0-9 ]', '', 'g'), ' ')), lambda x: length(x) >= 3)) > 0 AS plausible, "
    "p_brand || ' ' || p_name AS shop_query, p_brand || ' ' || p_name || ' bowling ball' AS video_query, p_name AS cover, replace(p_type, '_', ' ') || ' ' || p_size AS core FROM w"
)
def search_names(spark, d):
    """Names with marks and codes, what shops and videos are searched by, and whether two names share a long word."""
    k = F.col("p_partkey")
    other = F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k % 3 == 1, F.concat("p_type", F.lit(" of xy"))).otherwise("xy")
    marked = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("®  ")), F.lit("™"))
    core = F.concat(F.when(k % 2 == 0, "S_").otherwise(""), "p_type", F.lit("_"), "p_size")
    return _part(spark, d).select(
        "p_partkey", M.plausible(F.col("p_name"), other).alias("plausible"), T.search_query(F.col("p_brand"), F.col("p_name")).alias("shop_query"),
        T.search_query(F.col("p_brand"), F.col("p_name"), True).alias("video_query"), T.cover_name(marked).alias("cover"), T.without_brand_code(core).alias("core"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN DATE '2021-12-25' + CAST(p_size AS INT) END AS released FROM part")
def shopify_release_dates(spark, d):
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2021-12-25").cast("date"), F.col("p_size")), "MMMM d, yyyy")
    return _part(spark, d).select("p_partkey", T.release_date(F.when(k % 4 > 0, day).otherwise("December 2021"), "shopify").alias("released"))
