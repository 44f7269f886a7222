"""Paged sources, page trees, chained and stateful streams, refits, nearest products, migrations and history."""

import datetime as dt
import http.server
import json
import random
import shutil
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.operators import merge, migrate, nearest, ranking
from cataloom.session import work_folder
from cataloom.sources import extract, files, paged, selectors as S
from cataloom.streaming import chain, ordered


# --- paged sources


class _Site(http.server.BaseHTTPRequestHandler):
    """25 items of key a; key b is one page; busy on the first request of each page; item 7 is moved to page 2 as a short page of key c."""

    seen: Counter = Counter()

    def do_GET(self):
        _, key, page = self.path.split("/")
        self.seen[self.path] += 1
        if self.seen[self.path] == 1:
            self.send_error(503)
            return
        n = {"a": 25, "b": 3, "c": 40}.get(key)
        if n is None:
            self.send_error(404)
            return
        items = list(range(n))[(int(page) - 1) * 10 : int(page) * 10]
        items = items[:4] if key == "c" and page == "2" else items
        body = json.dumps({"items": [{"x": i} for i in items]}).encode() if key != "b" or page == "1" else b"<html>"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{key}}/{{page}}"
    server.shutdown()


def test_paged_source_retries_and_stops(spark, site):
    found = paged.pages(spark, site, ["a", "b", "c", "none"], limit=10, most=9, per_task=2, wait=0.01)
    rows = extract.collection_rows(found, "key", "items array<struct<x:int>>", "items", 10, 9).collect()
    # c's third page follows a short one, so it doesn't count, whichever task reads it
    assert Counter(r.key for r in rows) == {"a": 25, "b": 3, "c": 14}
    assert sorted(r.x for r in rows if r.key == "a") == list(range(25))


def test_partition_read_twice_gives_the_same(site):
    reader = paged.PagedReader({"url": site, "keys": '["a"]', "limit": "10", "most": "9", "wait": "0.01"})
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(1, 5), (6, 9)]
    assert list(reader.read(parts[0])) == list(reader.read(parts[0])) and len(list(reader.read(parts[0]))) == 3
    total = paged.PagedReader({"url": site, "keys": "[]", "total": "p.n"})
    assert not total.is_last('{"p":{"n":3}}', 2) and total.is_last('{"p":{"n":3}}', 3) and total.is_last('{"p":[]}', 1) and total.is_last("<html>", 1)


def test_errors_that_stay_are_raised(monkeypatch):
    def refuse(*_, **__):
        raise paged.urllib.error.HTTPError("u", 403, "no", None, None)

    monkeypatch.setattr(paged.urllib.request, "urlopen", refuse)
    with pytest.raises(paged.urllib.error.HTTPError):
        paged.fetched("http://x.test/", wait=0.0)
    assert paged.fetched("file:///nowhere/at/all") is None


# --- page trees


def trees(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", S.tree("html").alias("t")).orderBy("k")


def one(spark, page, expr):
    return trees(spark, page).select(expr(F.col("t")).alias("x")).first().x


def test_selectors(spark):
    page = '<div id=a class="x y"><p>1<span title="Red ball">2</span></p></div><p class=y data-k="">3</p><h1>4</h1>'
    texts = lambda css: one(spark, page, lambda t: F.transform(S.select(t, css), lambda n: S.text(t, n)))
    assert texts("p") == ["12", "3"] and texts(".y") == ["12", "3"] and texts("div.x.y > p") == ["12"] and texts("div > span") == []
    assert texts("div span, h1, p.y") == ["2", "3", "4"] and texts("[data-k]") == ["3"] and texts('[title~="ball"]') == ["2"]
    assert texts("span[title^=Red]") == texts("[title$='ball']") == texts("[title*='d b']") == ["2"] and texts("* > span") == ["2"]
    for bad in ("", "p >", "p:first", ", p"):
        with pytest.raises(ValueError):
            S._compiled(bad)


def test_prices_are_as_stated(spark):
    pages = ["<b>$149.99</b>", "<b>USD 89</b>", "<b>Now: $129.99 (was $149.99)</b>", "<b>16 lb 1,249.50</b>", "<b>none</b>", "<i>5</i>", None, "", "<b"]
    got = [tuple(r.x) for r in trees(spark, *pages).select(S.page_price(F.col("t"), "b").alias("x")).collect()]
    assert [g[0] for g in got] == [149.99, 89.0, 129.99, 1249.5, None, None, None, None, None]
    assert [g[2] for g in got] == [None] * 4 + ["no price"] + ["no match"] * 4


def test_broken_and_deep_pages(spark):
    assert one(spark, "<p>a<b>b</p>c</b></i>", lambda t: F.transform(S.select(t, "p"), lambda n: S.text(t, n))) == ["ab"]
    # cells without end tags hold what follows them
    assert one(spark, "<table><tr><td>1<td>2</tr><tr><td>3</table>", lambda t: S.tables(t)) == [[["12", "2"], ["3"]]]
    nodes, texts = S.parsed("<div>" * 20000 + "x" + "</div>" * 20000)
    assert len(nodes) == 20000 and nodes[0][1] == 19999 and texts == [("x", False)]
    assert one(spark, "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", lambda t: S.tables(t, "table", False)) == [[["ab"]], [["b"]]]


def test_nodes_and_labels_are_computed_once(spark):
    mentions = lambda c: str(c).count("marker")
    t, marker = F.col("t"), F.col("marker")
    assert mentions(S.text(t, marker)) == mentions(S.spaced_text(t, marker)) == mentions(S.select(t, "b", marker)) == 1
    assert mentions(S.select(marker, "a b > i")) == 3 and mentions(S.labelled(marker, "li", "b", "i")) == 5  # a step each; two texts
    page = "<ul><li><b>A</b><i>1</i><b> a </b><i>2</i><b>B</b></li><li></li><li><i>3</i><b>C</b><b>D</b></ul><b>E</b><i>4</i>"
    assert one(spark, page, lambda t: S.labelled(t, "ul > li", "b", "li i")) == [{"a": "2"}, {}, {"c": "3"}]
    assert one(spark, None, lambda t: S.labelled(t, "li", "b", "i")) is None


def test_plain_pages_are_parsed_as_by_the_parser(spark):
    plain = "<UL Class=a id=''>x &amp; y&lt<li data-k='1\n>2' HIDDEN a=1 a=2>é\xa0</LI ><br></i><td><p></ul>\n<template>c</template>d"
    odd = ["<b/>", "<", "</b a>", "<title><i></title>", "<script>'<i>'</script>", "<!-- <i> -->", "<a\xa0b=c>", "<a b='&amp'>", "<a b=c/d>", "<a b = c>"]
    for page in (plain, "", "no tags", *(plain + x + plain for x in odd)):
        t = S._Tree()
        t.feed(page)
        assert S.parsed(page) == t.finished()
    assert S._plainly(plain) and not any(S._plainly(plain + x) for x in odd)
    got = [r.t for r in trees(spark, plain, None, "").collect()]
    nodes, texts = S.parsed(plain)
    assert [tuple(n) for n in got[0].nodes] == [(i, *n) for i, n in enumerate(nodes)]
    assert [tuple(x) for x in got[0].texts] == texts and got[1] is None and got[2].nodes == got[2].texts == []


# --- streams


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_chain_is_replayed_without_repeats(spark):
    root = work_folder(spark, "test-chain")
    stages = [chain.Stage("even", "in", lambda d: d.filter("n % 2 = 0")), chain.Stage("half", "even", lambda d: d.select((F.col("n") / 2).cast("long").alias("n"))), chain.Stage("minus", "even", lambda d: d.select((-F.col("n")).alias("n")))]
    for i in range(4):
        put(spark, f"{root}/in", [(10 * i + k,) for k in range(10)], "n long")
    run = lambda: {k: sorted(r.n for r in v.collect()) for k, v in chain.run_chain(spark, root, {"in": (f"{root}/in", "n long")}, stages, 1).items()}
    want = {"even": list(range(0, 40, 2)), "half": list(range(20)), "minus": sorted(-n for n in range(0, 40, 2))}
    assert run() == want and run() == want
    shutil.rmtree(f"{root}/half/checkpoint/commits")  # as if each batch had been written, but not committed
    assert run() == want
    shutil.rmtree(f"{root}/even/checkpoint")
    assert run() == want
    put(spark, f"{root}/in", [(100,), (101,)], "n long")
    assert run()["half"] == [*range(20), 50]
    with pytest.raises(ValueError):
        chain.run_chain(spark, root, {}, stages)


def arrival(spark, rows, late, make, name):
    root = work_folder(spark, name)
    for part in rows:
        put(spark, f"{root}/in", [(i, k, v, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)) for i, k, v, m in part], "id long, sku long, value string, checked_at timestamp")
    stream = spark.readStream.schema("id long, sku long, value string, checked_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = make(stream, late)
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{root}/out").collect())


def test_deltas_do_not_depend_on_arrival(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, None if i % 11 == 5 else str(rng.randint(0, 9)), i // 3 * 10) for i in range(60)]
    want, last = [], {}
    for i, k, v, _ in rows:
        if last.get(k) is not None and v is not None and int(v) < int(last[k]):
            want.append((k, i, int(last[k]) - int(v)))
        last[k] = v
    for seed in (None, 1):
        given = rows[:]
        if seed:
            random.Random(seed).shuffle(given)
        parts = [given[a : a + 20] for a in range(0, 60, 20)] + [[(-1, -1, None, 10**7)]]
        assert arrival(spark, parts, "30 days", lambda s, late: ordered.ordered_deltas(s, value="value", late=late), "test-deltas") == sorted(want)


def test_gone_and_late_sightings(spark):
    parts = [[(1, 7, "a", 0), (2, 7, "a", 10), (3, 7, "b", 20)], [(4, 7, "b", 3000)], [(6, 7, "b", 3001)], [(5, 7, "c", 5)], [(-1, -1, None, 10**7)]]
    got = arrival(spark, parts, "1 hour", lambda s, late: ordered.snapshot_diffs(s, "sku", "checked_at", "id", "value", 1.0, late), "test-gone")
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()) * 10**6
    # the sighting at 5 minutes comes after the watermark has passed it, and is left out
    assert [((at - zero) // 60_000_000, diff) for _, at, diff in got] == [(0, "new"), (10, "unchanged"), (20, "changed"), (20 + 1440, "gone"), (3000, "new"), (3001, "unchanged"), (3001 + 1440, "gone")]


def test_insert_once_over_restarts(spark):
    root = work_folder(spark, "test-once")
    schema = "k long, v string, at timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    for turn in range(3):
        put(spark, f"{root}/in", [(1, f"t{turn}", day(30 * turn)), (2 + turn, "x", day(30 * turn)), (2 + turn, "y", day(30 * turn)), (None, "n", day(30 * turn))], schema)
        ordered.insert_once(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/out", ["k"], "at", "1 day", f"{root}/c").awaitTermination()
    got = ordered.inserted(spark, f"{root}/out", schema).collect()
    assert sorted((r.k or 0) for r in got) == [0, 1, 2, 3, 4] and next(r.v for r in got if r.k == 1) == "t0"


# --- refits and nearest products


def test_refit_equals_lstsq(spark):
    rng = np.random.default_rng(2)
    kinds = [None, "a", "b", "c"]
    rows = [(float(rng.normal(5, 2)), float(rng.normal()), kinds[int(rng.integers(4))]) for _ in range(300)]
    y = [2 + 3 * a - b + {"a": 1.5, "b": -2.0}.get(c, 0.0) + 0.1 * float(rng.normal()) for a, b, c in rows]
    df = spark.createDataFrame([(*r, v) for r, v in zip(rows, y)] + [(None, 1.0, "a", 1.0), (1.0, 1.0, "a", None)], "a double, b double, c string, y double")
    got = {r.term: r.coefficient for r in ranking.refit(df, "y", ["a", "b"], {"c": ["a", "b"]}).collect()}
    x = np.array([[1, a, b, c == "a", c == "b"] for a, b, c in rows], float)
    assert np.allclose(list(got.values()), np.linalg.lstsq(x, np.array(y), rcond=None)[0])
    twice = {r.term: r.coefficient for r in ranking.refit(df.withColumn("a2", 2 * F.col("a")), "y", ["a", "a2", "b"], {"c": ["a", "b"]}).collect()}
    assert 0.0 in (twice["a"], twice["a2"]) and np.isclose(twice["a"] + 2 * twice["a2"], got["a"])
    assert [r.coefficient for r in ranking.refit(df.filter("false"), "y", ["a"]).collect()] == [0.0, 0.0]
    fitted = ranking.predicted(df, ranking.refit(df, "y", ["a", "b"], {"c": ["a", "b"]}), "f").filter("a IS NOT NULL AND y IS NOT NULL")
    assert fitted.agg(F.avg(F.abs(F.col("f") - F.col("y")))).first()[0] < 0.1


def test_nearest_equals_brute_force(spark):
    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    rows = [(i, pick(None, 2.5, round(2.4 + rng.random() * 0.4, 2)), pick(None, round(rng.random() * 0.06, 3)), pick("s", "a", None), pick("p", "h"), pick("u", "r", None)) for i in range(150)]
    rows += [(i, 2.5, 0.04, "s", "p", "u") for i in range(200, 230)] + [(300, 9.0, 0.9, "s", "p", "u")]
    schema = "product long, rg double, differential double, core_type string, cover_type string, cover_material string"
    specs = spark.createDataFrame(rows, schema)
    candidates = specs.filter("product % 3 <> 0")

    def score(a, b):
        square = sum(((p - q) / span) ** 2 for p, q, span in ((a[1], b[1], ranking.RG_RANGE), (a[2], b[2], ranking.DIFF_RANGE)) if p is not None and q is not None)
        return square**0.5 + sum(cost for p, q, cost in zip(a[3:], b[3:], ranking.MISMATCH.values()) if p is not None and q is not None and p != q)

    got = nearest.nearest(specs, candidates, 4)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    found = {(r.product, r["rank"]): (r.candidate, round(r.score, 6)) for r in got.collect()}
    for a in rows:
        best = sorted((round(score(a, b), 9), b[0]) for b in rows if b[0] != a[0] and b[0] % 3)[:4]
        assert [found[a[0], n + 1] for n in range(4)] == [(i, round(s, 6)) for s, i in best]
    assert nearest.nearest(specs, candidates.filter("false"), 4).count() == 0
    assert nearest.nearest(specs, specs.filter("product = 1"), 4).count() == len(rows) - 1


# --- merges, migrations, history


def test_merge_duplicates_twice_changes_nothing(spark):
    rows = [(1, 1, 1, "/a", "pending", True, 5), (2, 1, 1, "https://x/a", "pending", True, 6), (3, 1, 1, "http://y/a", "approved", False, 9), (4, 2, 1, "/b", "approved", True, 9), (5, 2, 1, "ftp://b", "pending", True, 1), (6, 3, None, None, None, None, None), (7, 3, None, "s:x", None, None, None)]
    df = spark.createDataFrame(rows, "id long, product long, site long, url string, status string, active boolean, created long")
    history = spark.createDataFrame([(i, i * 10) for i in range(1, 9)], "source long, price long")
    good = (F.col("status") == "approved") & F.col("active")
    kept, after, counts = merge.merge_duplicates(df, ["product", "site"], good, "created", "id", "url", {"h": (history, "source")})
    assert sorted((r.id, r.url) for r in kept.collect()) == [(1, "https://x/a"), (4, "ftp://b"), (6, "s:x")]
    assert sorted(r.source for r in after["h"].collect()) == [1, 1, 1, 4, 4, 6, 6, 8]
    assert tuple(counts.first()) == (3, 4, 7, 7)
    again, _, none = merge.merge_duplicates(kept, ["product", "site"], good, "created", "id", "url", {"h": (after["h"], "source")})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect())) and none.first()[1] == 0


def test_migration_resumes(spark):
    at = migrate.Versions(spark, work_folder(spark, "test-migration"))
    at.write("t", spark.createDataFrame([(1,), (2,)], "n long"), 0)
    failing = {"on": True}

    def double(t):
        if failing["on"]:
            raise RuntimeError("lost")
        return {"t": t["t"].select((F.col("n") * 2).alias("n"))}

    steps = [migrate.Step("add", lambda t: {"t": t["t"].select((F.col("n") + 1).alias("n"))}), migrate.Step("double", double)]
    with pytest.raises(RuntimeError):
        at.migrate(steps)
    failing["on"] = False
    at.write("t", spark.createDataFrame([(99,)], "n long"), 2)  # what a lost attempt had written is replaced
    assert at.migrate(steps) == ["double"] and at.migrate(steps) == []
    assert sorted(r.n for r in at.read("t").collect()) == [4, 6]
    with pytest.raises(ValueError):
        at.migrate([migrate.Step("zero", lambda t: {}), *steps])


def test_history_runs_and_prunes(spark):
    path = work_folder(spark, "test-history")
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 3)) for i in range(9)], "n long, at timestamp")
    for run in ("a", "b", "a"):
        files.append_history(rows, path, "at", run)
    assert files.history(spark, path).count() == 18
    one = files.history(spark, path, "2024-01-02", "2024-01-02")
    assert one.count() == 6 and "PartitionFilters: [isnotnull(period" in one._jdf.queryExecution().executedPlan().toString()


def test_sitemaps_split(spark):
    path = work_folder(spark, "test-sitemap")
    n = 20000
    body = "<urlset xmlns:i='u'>" + "\n".join(f"<url>\n<loc>https://x.test/b/current/{k}</loc><i:image><i:loc>z</i:loc></i:image></url>" for k in range(n)) + "<url/></urlset>"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = files.sitemap_files(spark, path, "/b/(current|retired)/")
        assert found.rdd.getNumPartitions() > 4
        assert found.distinct().count() == found.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
