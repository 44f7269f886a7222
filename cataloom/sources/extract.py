"""Rows from sitemaps, pages, JSON documents, packed tables, label lines and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_folder

SITEMAP = "url array<struct<loc:string,lastmod:string>>"
VIDEOS = "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,channelTitle:string,publishedAt:string,thumbnails:map<string,struct<url:string>>>>>"
TRACKS = "array<struct<baseUrl:string,languageCode:string,kind:string>>"


def stripped(c: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sitemap(df: DataFrame, xml: str, path_pattern: str) -> DataFrame:
    """(url, status, lastmod) of the sitemap's URLs that match; group 1 of the pattern is the status."""
    rows = df.select(F.inline(F.from_xml(F.col(xml), F.lit(SITEMAP)).getField("url")))
    url = stripped(F.col("loc"))
    return rows.select(url.alias("url"), F.regexp_extract(url, path_pattern, 1).alias("status"), stripped(F.col("lastmod")).alias("lastmod")).filter(F.col("url").rlike(path_pattern))


def links(df: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """(key, link): distinct first groups of a link pattern."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)))).alias("link"))


def crawl(pages: DataFrame, starts: Column, most: int = 20) -> DataFrame:
    """(start, page, depth) of the pages reached from each of starts by following next; pages(page, next) stand in a table.

    A round of joins for each depth, each written before the next: a chain stops after most pages, at a page without a next
    one, or at one seen before.
    """
    spark, root = pages.sparkSession, work_folder(pages.sparkSession, "crawl")

    def kept(df: DataFrame, depth: int) -> DataFrame:
        df.write.parquet(f"{root}/depth={depth}")
        return spark.read.schema(df.schema).parquet(f"{root}/depth={depth}")

    table = pages.select("page", "next")
    front = kept(table.filter(starts).select(F.col("page").alias("start"), "page", "next"), 0)
    rounds = [front]
    while len(rounds) < most and not front.filter("next IS NOT NULL").isEmpty():
        seen = rounds[0]
        for r in rounds[1:]:
            seen = seen.union(r)
        after = front.filter("next IS NOT NULL").select("start", F.col("next").alias("page")).join(seen, ["start", "page"], "left_anti")
        front = kept(after.join(table, "page").select("start", "page", "next"), len(rounds))
        rounds.append(front)
    out = None
    for depth, r in enumerate(rounds):
        own = r.select("start", "page", F.lit(depth).alias("depth"))
        out = own if out is None else out.union(own)
    return out


def video_results(df: DataFrame, body: str) -> DataFrame:
    """(video, title, channel, published_at, thumbnail) of search responses; a bad body gives none."""
    item = df.select(F.inline(F.from_json(F.col(body), VIDEOS).getField("items")))
    thumb = F.coalesce(F.col("snippet.thumbnails")["high"]["url"], F.col("snippet.thumbnails")["default"]["url"])
    return item.select(F.col("id.videoId").alias("video"), F.col("snippet.title").alias("title"), F.col("snippet.channelTitle").alias("channel"), F.try_to_timestamp("snippet.publishedAt").alias("published_at"), thumb.alias("thumbnail"))


def caption_track(html: Column) -> Column:
    """The caption track of a page: English by people, else English, else the first."""
    tracks = F.from_json(F.regexp_extract(html, r'(?s)"captionTracks":(\[.*?\])', 1), TRACKS)
    english = F.filter(tracks, lambda t: F.startswith(t["languageCode"], F.lit("en")))
    human = F.filter(english, lambda t: ~t["kind"].eqNullSafe(F.lit("asr")))
    zero = F.lit(0)
    return F.coalesce(F.get(human, zero), F.get(english, zero), F.get(tracks, zero))


def transcript(xml: Column) -> Column:
    nodes = F.xpath(xml, F.lit("//text/text()"))
    return F.array_join(F.filter(F.transform(nodes, stripped), lambda t: t != ""), " ")


def packed_rows(weights: Column, rg: Column, differential: Column, bias: Column) -> Column:
    """Array of (weight_lbs, rg, differential, mass_bias) from cells that hold one value a line; weights set the length."""
    split = lambda c: F.split(F.coalesce(c, F.lit("")), r"\n")

    def row(x: Column) -> Column:
        num = lambda k: F.regexp_extract(x[k], r"-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double").alias
        return F.struct(F.regexp_extract(x["w"], r"\d+", 0).try_cast("int").alias("weight_lbs"), num("rg")("rg"), num("d")("differential"), num("b")("mass_bias"))

    zipped = F.arrays_zip(split(weights).alias("w"), split(rg).alias("rg"), split(differential).alias("d"), split(bias).alias("b"))
    return F.filter(F.transform(zipped, row), lambda r: r["weight_lbs"].isNotNull())


def label_fields(text: Column, labels: list[str]) -> Column:
    """Map of label to value from lines that begin with one; the first label of a line and the last line count."""
    lines = F.filter(F.split(text, r"\n"), lambda x: stripped(x) != "")

    def pair(x: Column) -> Column:
        hit = F.get(F.filter(F.array(*map(F.lit, labels)), lambda k: F.startswith(F.lower(stripped(x)), F.lower(k))), F.lit(0))
        return F.struct(hit.alias("key"), stripped(F.substr(stripped(x), F.length(hit) + 1)).alias("value"))

    return _last_of_each(F.filter(F.transform(lines, pair), lambda p: p["key"].isNotNull()), "key", "value")


def _last_of_each(entries: Column, key: str, value: str) -> Column:
    """Map of the entries' keys to their values; the last of equal keys counts, whatever the session says of them."""
    keys = F.array_distinct(F.transform(entries, lambda e: e[key]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e[key] == k), -1)[value]))


def ocr_grid(blocks: DataFrame) -> DataFrame:
    """(tbl, row, col, text) of OCR blocks(id, kind, row, col, text, children): tables hold cells, cells hold words."""
    child = blocks.select(F.col("id").alias("parent"), F.posexplode("children").alias("at", "id"))
    cells = child.join(blocks.filter("kind = 'TABLE'").select(F.col("id").alias("parent")), "parent").join(blocks.filter("kind = 'CELL'"), "id").select(F.col("parent").alias("tbl"), F.col("id").alias("cell"), "row", "col")
    words = child.join(blocks.filter("kind = 'WORD'").select("id", "text"), "id").groupBy(F.col("parent").alias("cell")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    return cells.join(words, "cell", "left").select("tbl", "row", "col", F.coalesce("text", F.lit("")).alias("text"))


def widest_image(srcset: Column) -> Column:
    """The URL of the widest entry of a srcset; inline data is no image."""
    entries = F.filter(F.split(srcset, r",\s+"), lambda x: ~F.startswith(F.trim(x), F.lit("data:")))
    sized = F.transform(entries, lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"\s(\d+)w", 1).try_cast("int"), F.lit(0)).alias("w"), F.get(F.split(F.trim(x), r"\s+"), F.lit(0)).alias("url")))
    return F.array_max(sized)["url"]


def custom_fields(fields: Column) -> Column:
    """Map of lower-cased names to values; of equal names the last counts."""
    named = F.filter(fields, lambda f: f["name"].isNotNull())
    return _last_of_each(F.transform(named, lambda f: F.struct(F.lower(F.trim(f["name"])).alias("k"), f["value"].alias("v"))), "k", "v")


def collection_rows(pages: DataFrame, key: str, schema: str, items: str, limit: int, most: int = 20) -> DataFrame:
    """(key, the item's fields) of pages(key, page from 1, body) up to the first with fewer than limit items or a gap, most pages at most.

    A body that can't be read has no items, and so ends its collection.
    """
    read = pages.filter(F.col("page").between(1, most)).select(key, "page", F.coalesce(F.from_json("body", schema)[items], F.from_json(F.lit('{"%s":[]}' % items), schema)[items]).alias("items"))
    have = F.array_sort(F.collect_set("page"))
    ends = read.groupBy(key).agg(have.alias("have"), F.min(F.when(F.size("items") < limit, F.col("page"))).alias("short"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(most + 1)), "have")) - 1
    last = ends.select(F.col(key).alias("__key"), F.least(gap, F.coalesce("short", F.lit(most))).alias("__last"))
    j = read.join(last, (F.col(key) == F.col("__key")) & (F.col("page") <= F.col("__last")))
    return j.select(key, F.inline("items"))


def counted_rows(pages: DataFrame, key: str, schema: str, most: int = 100) -> DataFrame:
    """(key, fields of data) of pages(key, page, body) up to the total_pages that page 1 states, most pages at most."""
    read = pages.select(key, "page", F.from_json("body", schema).alias("x"))
    total = read.filter("page = 1").select(F.col(key).alias("__key"), F.least(F.coalesce("x.pagination.total_pages", F.lit(1)), F.lit(most)).alias("__total"))
    return read.join(total, (F.col(key) == F.col("__key")) & (F.col("page") <= F.col("__total"))).select(key, F.inline("x.data"))


def index_urls(pages: DataFrame, html: str, page: str) -> DataFrame:
    """(url): the distinct numbered products of index pages, at the root of the site that holds them."""
    ids = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"n_(\d+)"), F.lit(1)))
    root = F.regexp_extract(page, r"^[a-z]+://[^/]+", 0)
    return pages.select(root.alias("root"), ids.alias("n")).distinct().select(F.concat("root", F.lit("/n_"), "n").alias("url"))


def listing_links(html: Column, pattern: str, per_page: int) -> Column:
    """(links, may_be_cut): distinct links; as many as a page holds may mean that there are more."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))
    return F.struct(found.alias("links"), (F.size(found) >= per_page).alias("may_be_cut"))


def product_document(body: Column) -> Column:
    """The product of a JSON document; null fields if it can't be read."""
    return F.from_json(body, "product struct<title:string,handle:string,updated_at:string,variants:array<struct<grams:int,title:string>>>")["product"]
