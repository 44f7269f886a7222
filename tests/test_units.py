"""Cases that the SQL comparison doesn't reach: streams, extraction from literals, nulls and bad input."""

import datetime
import json

from cataloom.functions import text as T
from cataloom.operators import inventory, match, merge, ranking
from cataloom.sources import extract, tables, views
from cataloom.streaming import stock
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_stream_equals_batch(spark, tmp_path):
    h = views.stock_history(spark, SF)
    h.repartition(1).sortWithinPartitions("checked_at").write.parquet(str(tmp_path / "in"))
    stream = stock.readings(spark, str(tmp_path / "in"))
    out = stock.deltas(stream).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    got = spark.table("deltas").agg(F.sum("sold")).first()[0]
    assert got == inventory.daily_units(h).agg(F.sum("units")).first()[0]


def test_keyed_sink_keeps_the_last_row(spark, tmp_path):
    views.stock_history(spark, SF).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stock.readings(spark, str(tmp_path / "in"), 2)
    q = stock.merged_into(stream, str(tmp_path / "t"), ["sku"], "id", str(tmp_path / "c"), str(tmp_path / "bad"), F.col("quantity").isNotNull())
    q.awaitTermination(120)
    table = stock.merged(spark, str(tmp_path / "t"))
    want = views.stock_history(spark, SF).filter("quantity is not null").groupBy("sku").agg(F.max("id").alias("id"))
    assert table.select("sku", "id").exceptAll(want).count() == 0
    assert table.count() == want.count() == table.select("sku").distinct().count()


def test_prices_and_numbers(spark):
    for text, want in (("$1,149.99", "1149.99"), ("now 12 was 13.50", "13.50"), ("none", None), ("", None), ("5 - 6", "5.00")):
        got = one(spark, T.price(F.lit(text)))
        assert (None if got is None else str(got)) == want
    assert one(spark, T.duration_seconds(F.lit("PT1H2M3S"))) == 3723 and one(spark, T.duration_seconds(F.lit("PT"))) == 0
    assert one(spark, T.duration_seconds(F.lit("1H"))) is None
    assert one(spark, T.release_date(F.lit("1/2/99"), "commercebuild")) == datetime.date(1999, 1, 2)
    assert one(spark, T.release_date(F.lit("Sometime"), "craft")) is None
    assert one(spark, T.number(F.lit("rg .050"))) == 0.05 and one(spark, T.number(F.lit("1.2.3"), False)) is None


def test_similarity_skips_unknown_values(spark):
    row = "{0} as {1}rg, {2} as {1}differential, {3} as {1}core_type, 'solid' as {1}cover_type, null as {1}cover_material"
    df = spark.sql("select " + row.format("2.5D", "a_", "0.05D", "'symmetric'") + ", " + row.format("null", "b_", "0.05D", "'asymmetric'"))
    assert df.select(ranking.distance("a_", "b_")).first()[0] == 0.5


def test_sources_from_literals(spark):
    xml = "<transcript><text start='0'> one </text><text> </text><text>two</text></transcript>"
    assert one(spark, extract.transcript(F.lit(xml))) == "one two"
    html = '..."captionTracks":[{"baseUrl":"a","languageCode":"de"},{"baseUrl":"b","languageCode":"en","kind":"asr"},{"baseUrl":"c","languageCode":"en-GB"}]'
    assert one(spark, extract.caption_track(F.lit(html)))["baseUrl"] == "c"
    assert one(spark, extract.caption_track(F.lit("nothing"))) is None
    rows = one(spark, tables.weight_table(F.lit("16 lbs 15 lbs\nRG 2.48 2.50\nDIFF 0.050 0.049")))
    assert [(r.weight_lbs, r.rg, r.differential, r.mass_bias) for r in rows] == [(16, 2.48, 0.05, None), (15, 2.5, 0.049, None)]
    assert one(spark, extract.label_fields(F.lit("Core: X\nCover type: Y\ncore: Z"), ["Core:", "Cover type:"])) == {"Core:": "Z", "Cover type:": "Y"}
    assert one(spark, extract.widest_image(F.lit("data:x 900w, a.jpg 300w, b.jpg 600w"))) == "b.jpg"
    body = '{"items":[{"id":{"videoId":"v"},"snippet":{"title":"t","thumbnails":{"default":{"url":"d"}}}}]}'
    got = extract.video_results(spark.createDataFrame([(body,), ("broken",)], "b string"), "b").collect()
    assert [(r.video, r.thumbnail) for r in got] == [("v", "d")]


def test_ocr_grid(spark):
    rows = [("t", "TABLE", None, None, None, ["c1", "c2"]), ("c1", "CELL", 1, 1, None, ["w1", "w2"]), ("c2", "CELL", 1, 2, None, []), ("w1", "WORD", None, None, "15", []), ("w2", "WORD", None, None, "lb", [])]
    df = spark.createDataFrame(rows, "id string, kind string, row int, col int, text string, children array<string>")
    assert {(r.row, r.col, r.text) for r in extract.ocr_grid(df).collect()} == {(1, 1, "15 lb"), (1, 2, "")}


def test_crawl_stops_at_seen_pages(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", None)], "page string, next string")
    assert {tuple(r) for r in extract.crawl(pages, F.col("page").isin("a", "z")).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("z", "z", 0)}
    assert extract.crawl(pages, F.col("page") == "a", 2).count() == 2 and extract.crawl(pages, F.lit(False)).count() == 0


def test_of_equal_field_names_the_last_counts(spark):
    fields = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in ((" RG", "1"), ("Diff", "2"), ("rg ", "3"))])
    assert one(spark, extract.custom_fields(fields)) == {"rg": "3", "diff": "2"}
    assert one(spark, extract.custom_fields(F.filter(fields, lambda f: F.lit(False)))) == {}
    assert one(spark, extract.label_fields(F.lit(None).cast("string"), ["a"])) is None


def test_suffixes_that_distinguish_do_not_match(spark):
    ours = spark.createDataFrame([(1, "Zeta II"), (2, "Zeta-II Bowling Ball"), (3, "Low-Path Pearl")], "id long, name string")
    theirs = spark.createDataFrame([(10, "ZETA II!", 0), (11, "Low-Path", 1)], "id long, name string, position int")
    got = {r.our_id: (r.their_id, r.exact) for r in match.name_matches(ours, theirs).collect()}
    assert got == {1: (10, True), 2: (10, False), 3: (None, None)}


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5), (None, "n", 1)], "id long, name string, size int")
    new = spark.createDataFrame([(1, None, 4), (3, "c", 9)], "id long, name string, size int")
    once = merge.upsert(old, new, ["id"], {"name": merge.NEW_ELSE_OLD})
    assert sorted(once.collect(), key=str) == sorted(merge.upsert(once, new, ["id"], {"name": merge.NEW_ELSE_OLD}).collect(), key=str)
    assert {tuple(r) for r in once.collect()} == {(1, "a", 4), (2, "b", 5), (3, "c", 9), (None, "n", 1)}


def mentions(c):
    return str(c).count("marker")


def test_core_numbers_compute_their_tables_once(spark):
    assert mentions(tables.core_numbers(F.col("marker"))) == 1
    row = lambda *xs: "<tr>" + "".join(f"<td>{x}</td>" for x in xs) + "</tr>"
    first = row("RG", "9 lb") + row("RG", "9")
    second = row("x", "16 LB", "y", " 15lb", "14 lbs", "13 lb") + row("RG", "1", "2", "3") + row("rg", "2.5 in", "", "", ".5") + row("Diff", "", "", "0.05") + row("differential", "7", "", "8") + row("MB", "1") + row("ASY", "", "", "n/a")
    page = F.lit(f"<table>{first}</table><table>{second}</table><table>{second}</table>")
    got = [tuple(r) for r in one(spark, tables.core_numbers(tables.html_tables(page)))]
    assert got == [(16, 2.5, 7.0, 1.0), (15, None, 0.05, None), (14, 0.5, None, None)]
    assert one(spark, tables.core_numbers(tables.html_tables(F.lit(None).cast("string")))) is None


def test_grid_skus_compute_their_table_once(spark):
    assert mentions(tables.grid_skus(F.col("marker"))) == 1
    grid = lambda rows: [tuple(x) for x in one(spark, tables.grid_skus(F.lit(None).cast(tables.TABLE) if rows is None else F.from_json(F.lit(json.dumps(rows)), tables.TABLE))) or ()]
    header = [["", "16 lb", None, " 15LBS. ", "14 lb"], ["R.G.", "2.5", "9", "2.6"], None, ["rg", " ", "", "x 2.7"], ["", "PSA", "7", "8", ""], ["Diff", "", "", ".05 in", "n/a"]]
    assert grid(header) == [(16, 2.5, None, None), (15, 2.7, 0.05, 8.0), (14, None, None, None)]
    assert grid([["a", "16 lb", "2.5", "", "x.1"], ["b"], ["7", "14lb", "16 lb"], ["9", "15 lbs", ".5"]]) == [(16, None, 2.5, 0.1), (15, 9.0, 0.5, None)]
    assert grid(None) == grid([]) == grid([["16 lb x"], []]) == []
