"""Corpus operators against brute force on small fixtures, with nulls, empty tables, ties and clashing names."""

import math
import random
import re
import tracemalloc
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cataloom.llm import decontaminate, html_extract, line_dedup, lm_score, packing, pii, quality, sharding, simhash, toxicity
from cataloom.llm.common import pieces
from cataloom.llm.components import components
from cataloom.llm.words import blocked, hashed

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng.randint(3, 40), rng) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts[5] = texts[3]
    lines = texts[7].split("\n")
    words = lines[0].split()
    texts[9] = " ".join(words[:-1] + ["changed"]) + "\n" + "\n".join(lines[1:])
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, "some words in a text without an id.", "x"), (3, texts[3], "x"), (102, sentence(6000), "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, h string")


def empty(docs):
    return docs.filter("false")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_html():
    page = (
        "<html><head><title>t</title></head><body><header>top</header><nav><a href=x>menu</a></nav><div class='cookie-notice'>accept</div>"
        "<article><h1>Head&amp;line</h1><p>One\n  two<br>three<p>Four <b>five</b></p><form>f</form></article><aside>side</aside><div id=comments><p>nice</p></div><footer>end</footer>"
    )
    assert html_extract.main_text(page) == "Head&line\nOne two three\nFour five"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""


def test_html_names_in_part_leave_it_to_the_clusters():
    body = [f"Paragraph number {i} of the article, which has quite some words in it to read." for i in range(6)]
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in body) + "{}</article>"
    work, history = "Earlier work did this and that, in a paragraph as long as others are here.", "The patient lives alone and works in an office, as was said at the time."
    inner = f"<section id='related-work'><p>{work}</p></section><div class='social-history'><p>{history}</p></div><div class='related-posts'><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div><div class='reader-comments'><p>{work}</p></div>"
    assert html_extract.main_text(page.format(inner)) == "\n".join([*body, work, history])
    plain = "<body>" + "".join(f"<p>{x}</p>" for x in body)
    comment = "<p>I liked this article very much, since it has so many words in it to read.</p>"
    for end in (f"<div><h3>Comments</h3>{comment}</div>", f"<h3>3 Comments</h3>{comment}{comment}", f"<section><div><h4>Kommentare (2)</h4></div></section>"):
        assert html_extract.main_text(plain + end) == "\n".join(body)


def test_html_of_deep_pages_in_linear_time():
    deep = 20_000
    assert html_extract.main_text("<div>" * deep + "<p>some text of a page here</p>" + "</div>" * deep + "</x>" * deep) == "some text of a page here"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article>é</article>"), (None, None, None), (2, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df).collect()}
    assert got == {1: ("é", 1), None: ("", 0), 2: ("", 0)}
    assert html_extract.extract(df.filter("false")).count() == 0


def test_lm_base_and_score(docs):
    rows = docs.collect()
    train = Counter()
    for r in rows:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10:
            train.update([*words(r.text), ""])
    n, v = sum(train.values()), len(train)
    want = sorted(((r.doc_id or -1, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(r.text), ""]), 6), sum(train[w] > 0 for w in [*words(r.text), ""])) for r in rows))
    got = lm_score.score(docs).collect()
    assert sorted((r.doc_id or -1, round(r.base_score, 6), r.n_known) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert lm_score.score(empty(docs)).count() == 0


def test_trie_probabilities_sum_to_one():
    w = [b"the", b"then", b"there", b"a", b"an", b""]
    code, which = lm_score.word_codes(w, 7)
    code, count = lm_score._summed(code, np.array([9, 3, 2, 5, 4, 7])[which])
    made = []
    for k in range(7, -1, -1):
        ctx = code >> np.uint64(8)
        _, inverse = np.unique(ctx, return_inverse=True)
        made.append((code, count, np.bincount(inverse, count)[inverse]))
        if k:
            first = code >> np.uint64(8 * k)
            code, count = lm_score._summed(code & np.uint64((1 << 8 * k) - 1), np.where(first == 0, count, 1))
    trie = lm_score.Trie(made[::-1])
    for ctx in (b" ", b" th", b" the", b" zq"):
        codes = np.array([int.from_bytes(ctx + bytes([s]), "big") for s in range(256)], np.uint64)
        assert 0.9 < (10 ** trie.log10(codes, 7)).sum() <= 1.001


def brute_lm(train, texts, order=7):
    """Scores by a dictionary of all contexts of whole texts."""
    def steps(t):
        s = b"\0" * (order - 1) + b" " + (t or "").encode() + b"\xff"
        return [(s[i - order : i], s[i]) for i in range(order, len(s))]

    level = Counter(x for t in train for x in steps(t))
    nodes = {}
    for k in range(order, -1, -1):
        for (ctx, s), c in level.items():
            nodes.setdefault(ctx, {})[s] = c
        level = Counter((ctx[1:], s) for ctx, s in level) if k else level

    def p(ctx, s):
        if ctx not in nodes:
            return p(ctx[1:], s) if ctx else 1 / 257
        seen, n = nodes[ctx], sum(nodes[ctx].values())
        if s in seen:
            return (seen[s] - lm_score.DISCOUNT) / n
        lower = (lambda x: p(ctx[1:], x)) if ctx else (lambda x: 1 / 257)
        left = 1 - sum((c - lm_score.DISCOUNT) / n for c in seen.values())
        return left / (1 - sum(map(lower, seen))) * lower(s)

    return [sum(math.log10(p(ctx, s)) for ctx, s in steps(t)) for t in texts]


def lm_rows():
    rng = random.Random(12)
    texts = [f"{sentence(rng.randint(1, 25), rng)}\n Né {i}" for i in range(40)] + ["", None]
    texts += [" ".join(rng.sample(texts[3].split(), len(texts[3].split())))]
    return [(i, t) for i, t in enumerate(texts)]


def test_lm_score_keeps_every_context(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SLICE", 64)
    rows = lm_rows()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), want in zip(rows, brute_lm(train, [t for _, t in rows])):  # half a unit a byte, and single precision
        assert abs(got[i] - want) <= (len((t or "").encode()) + 1) * 0.51 / lm_score.UNIT


def test_lm_score_reads_over_words(spark):
    text = sentence(40)
    turned = " ".join(reversed(text.split()))
    df = spark.createDataFrame([(1, text), (2, text), (3, text), (4, turned)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(df, held=F.col("doc_id") == 4).collect()}
    assert got[4].base_score == pytest.approx(got[1].base_score) and got[4].score < 2 * got[1].score


def test_lm_codes_are_counted_over_slices_and_runs(monkeypatch):
    monkeypatch.setattr(lm_score, "SLICE", 16)
    monkeypatch.setattr(lm_score, "RUN", 96)
    texts = [(t or "").encode() for _, t in lm_rows()] + [b"", b"a" * 50, b"\0\0b"]
    for order in (3, 5, 7):
        padded = [b"\0" * (order - 1) + b" " + t + b"\xff" for t in texts]
        want = [[int.from_bytes(p[i - order : i + 1], "big") for i in range(order, len(p))] for p in padded]
        for train in (0, 20, len(texts)):
            seen, whole = (Counter(x for w in part for x in w) for part in (want[:train], want))
            u, c = lm_score._vocabulary(texts, train, order, 0)
            assert u.tolist() == sorted(whole) and c.tolist() == [seen[x] for x in sorted(whole)]
        data = lm_score.Padded(texts, lm_score.END)
        places = lm_score.Places(u)
        assert np.concatenate([u[places.of(data.codes(a, order))] for a in range(0, len(data.bytes), 16)]).tolist() == [x for w in want for x in w]
        word, which = map(np.concatenate, zip(*lm_score._word_slices(texts)))
        assert Counter(which.tolist()) == {i: len(t.split()) for i, t in enumerate(texts) if t.split()}
        u, c = lm_score._vocabulary(texts, 20, order, 1)
        seen = Counter(word[which < 20].tolist())
        assert u.tolist() == sorted({*word.tolist()}) and c.tolist() == [seen[x] for x in u.tolist()]


def test_lm_places_of_values_whose_slots_are_taken(monkeypatch):
    own = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64))
    asked = np.tile(own[::-1], 3)
    for mix in (lm_score.mix, lambda v: v % np.uint64(7) << np.uint64(61)):
        monkeypatch.setattr(lm_score, "mix", mix)
        assert (own[lm_score.Places(own).of(asked)] == asked).all()
    assert not len(lm_score.Places(own[:0]).of(own[:0]))
    with pytest.raises(KeyError):
        lm_score.Places(own[1:]).of(own[:1])


def test_lm_codes_cost_little_more_than_a_sort():
    rng = np.random.default_rng(3)
    vocabulary = np.array(["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(20_000)])
    texts = [" ".join(rng.choice(vocabulary, 500)).encode() for _ in range(1500)]
    data = lm_score.Padded(texts, lm_score.END)
    codes = np.concatenate([data.codes(a, 7) for a in range(0, len(data.bytes), lm_score.SLICE)])

    def least(work):
        took = []
        for _ in range(3):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: lm_score._vocabulary(texts, 1350, 7, 0)) < 6 * least(lambda: np.sort(codes))


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    odd = ["a@b.c._d@e.f", "x@y@z.w a@b", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111-1111 1111 4111111111111112", "é+1 (555) 010-9999.. +12", "𝔘 a@b.co", "", None, "." * 50_000 + "@x", "1" * 30_000, "a.b" * 20_000 + "@q.r", "+" + "1-" * 9000]
    rng = random.Random(3)
    odd += ["".join(rng.choice("a1.@+- 45") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(odd)], "doc_id long, text string, email string")
    got = pii.find_spans(df).select("id", pii.span_text(tuple(pii.PATTERNS)).alias("s")).collect()
    assert {r.id: r.s for r in got} == {i: brute_spans(t or "") for i, t in enumerate(odd)}
    assert pii.find_spans(df.filter("false")).count() == 0
    assert pii.sanitise(df).filter("doc_id = 5").first().text == "𝔘 [email]"


def test_pii_of_very_many_spans(spark):
    text = " ".join(f"u{i}@mail.org 10.0.{i % 256}.{i % 250}" for i in range(50_000))
    row = pii.find_spans(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).filter("id = 1").first()
    assert [(x.s, x.e) for x in row.email] == [m.span() for m in re.finditer(r"u[0-9]+@mail\.org", text)]
    assert len(row.ip) == 50_000 and all(text[x.s : x.e].startswith("10.0.") for x in row.ip[::997])


def test_pii_terms_that_reveal_an_entity(spark):
    rows = [(i, f"w{chr(97 + i % 26)}aaa Zorblax writes from zed@mail.org about word{chr(97 + i)} things") for i in range(4)] + [(10 + i, sentence(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.term for r in pii.find_spans(df).filter("size(term) > 0").collect()}
    assert set(got) == {0, 1, 2, 3} and all(any(rows[i][1][x.s : x.e] == "Zorblax" for x in v) for i, v in got.items())


def brute_fp(t):
    w = [x.encode() for x in words(t)]
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    lab = list(range(n))
    for _ in range(n):
        new = [min(lab[j] for j in range(n) if j == i or linked(i, j)) for i in range(n)]
        if new == lab:
            break
        lab = new
    return lab


def test_simhash(docs):
    rows = docs.filter("doc_id is not null").collect()
    fp = [brute_fp(r.text) for r in rows]
    lab = closure(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    least = {c: min(rows[i].doc_id for i in range(len(rows)) if lab[i] == c) for c in lab}
    got = simhash.simhash_classes(docs.filter("doc_id is not null")).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((r.doc_id, f"{f:016x}", least[c]) for r, f, c in zip(rows, fp, lab))
    assert simhash.simhash_classes(docs).count() == docs.count()
    assert simhash.simhash_classes(empty(docs)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 44])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 1 << 63, (700, 4 if radius > 40 else 1), dtype=np.uint64)
    for i in range(350, 700):
        fps[i] = fps[i - 350]
        for _ in range(rng.integers(0, radius + 3)):
            fps[i, rng.integers(0, fps.shape[1])] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    got = {(i, int(j)) for i, near in simhash.near_rows(fps, radius) for j in near}
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d <= radius, 1)))}


def test_large_blocks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rows = [(0, 7, i, [i & 1]) for i in range(100)]
    df = spark.createDataFrame(rows, "t int, key long, node long, fp array<long>")
    roots = components(simhash.links_in_blocks(df, 0)).collect()
    assert {r.node: r.root for r in roots} == {i: i & 1 for i in range(2, 100)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(5, 5), (3, 2), (100, 99)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 21 for i in range(22, 41)}, 100: 99}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_out_of_reach_are_abandoned():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, (700, 1), dtype=np.uint64)
    fps[650] = fps[3] ^ np.uint64(5)
    steps = []
    got = [(i, near.tolist()) for i, near in simhash.near_rows(fps, 2, steps)]
    assert got == [(3, [650])]
    assert min(steps) == 0 or steps[-1] < simhash.ROWS


def test_near_duplicates(spark, docs):
    text = sentence(200)
    w = text.split()
    near = " ".join(w[:100] + ["other"] + w[101:])
    df = spark.createDataFrame([(1, text, "a", 1), (2, near, "b", 2), (3, text, "c", 3), (4, sentence(200), "d", 4), (1, text, "a", 1)], "doc_id long, text string, id string, H int")
    got = simhash.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]
    assert simhash.drop_near_duplicates(empty(docs)).count() == 0
    assert simhash.drop_near_duplicates(docs).filter("coalesce(text, '') = ''").count() == 1


def test_near_duplicates_are_verified(spark):
    """Texts on both sides of 0.8, by brute force over sets of five-word shingles."""
    rng, texts = random.Random(9), []
    for b in range(12):
        base = [f"b{b}x{i}" for i in range(rng.randint(60, 300))]
        for cut in (0, 0.05, 0.1, 0.15, 0.18, 0.2, 0.22, 0.25, 0.3):
            n = int(cut * len(base))
            texts.append(" ".join(base[: len(base) - n] + ([f"n{b}x{cut}x{i}" for i in range(n)] if rng.random() < 0.4 else [])))
        texts.append(" ".join((base[:5] * 40) + base[5:]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    lab = closure(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    got = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(lab))


def brute_lines(rows):
    seen, gone = [], Counter()
    for i, t in sorted(set(rows)):
        for line in (t or "").split("\n"):
            s = frozenset(words(line))
            if not words(line):
                continue
            gone[i] += any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen)
            seen.append(s)
    return gone


def test_line_dedup(spark, docs):
    got = line_dedup.dedup_lines(docs.filter("doc_id is not null"))
    want = brute_lines([(r.doc_id, r.text) for r in docs.filter("doc_id is not null").collect()])
    assert {r.doc_id: r.n_removed for r in got.collect()} == {r.doc_id: want[r.doc_id] for r in got.collect()}
    assert sum(want.values()) > 3
    assert line_dedup.dedup_lines(docs).count() == docs.count() and line_dedup.dedup_lines(empty(docs)).count() == 0
    assert line_dedup.dedup_lines(docs).filter("doc_id = 100").first().text is None


def test_line_dedup_of_long_lines(spark):
    """Long lines over a small vocabulary: lengths on both sides of the limits of the parity bits, near and far from 0.8."""
    rng, rows = random.Random(8), []
    for size in (70, 95, 97, 128, 161, 200, 330):
        base = rng.sample(range(1500), size)
        for changed in (0.0, 0.05, 0.1, 0.11, 0.12, 0.15, 0.3):
            kept = rng.sample(base, size - int(changed * size))
            more = rng.sample(range(1500, 3000), rng.choice([0, int(changed * size)]))
            rows.append((len(rows), "short line\n" + " ".join(f"w{x}" for x in kept + more)))
        rows.append((len(rows), " ".join(f"w{x}" for x in base[: int(0.81 * size)])))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    assert {r.doc_id: r.n_removed for r in got} == {i: want[i] for i, _ in rows}
    assert 10 < sum(n > 1 for n in want.values()) < len(rows) - 10


def test_line_dedup_keeps_lines_whose_words_share_40_bits_of_hash(spark):
    # of the words u0 to u4999999 some pairs agree in the hash bits that order words
    rows = [(1, "user u929578 joined"), (2, "user u2808685 joined"), (3, "user u929578 joined u2808685"), (4, "joined user u929578")]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_line_dedup_lowers_only_a_to_z(spark):
    """Lines on both sides of 0.8 whose words differ in the case of other letters alone."""
    rng, rows = random.Random(12), []
    vocab = [f"é{a}{b}ö" for a in "bcdfgh" for b in "klmnpqrst"]
    for _ in range(60):
        base = rng.sample(vocab, rng.randint(12, 40))
        for share in (0.02, 0.06, 0.08, 0.1, 0.12):
            rows.append((len(rows), " ".join(w.replace("é", "É") if rng.random() < share else w.upper().replace("É", "é").replace("Ö", "ö") for w in base)))
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: want[i] for i, _ in rows}
    assert 20 < sum(want.values()) < 280


def test_blocked_words_are_those_of_hashed():
    rng = random.Random(13)
    long = "".join(rng.choice("ab") for _ in range(300))
    texts = ["", "\n\n", "a\n\n b", f"{long}\t{long.upper()} {long}a {long[:256]} {long[:255]}", "x \x00 \x00\x00 x\x00", "É é A a\x0bb\x0cc\rd", "abcdefgh abcdefghi abcdefghabcdefgh"]
    texts += ["".join(rng.choice("aB \n") for _ in range(200)) for _ in range(20)]
    a, b = (how([t.encode() for t in texts], range(3, 3 + len(texts))) for how in (hashed, blocked))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in ("row", "line", "first_line"))
    both = set(zip(a.hash.tolist(), b.hash.tolist()))
    assert len(both) == len({x for x, _ in both}) == len({y for _, y in both}) == len({w for t in texts for w in t.encode().lower().split()})


def test_line_sets_of_one_sum_are_told_apart(spark, monkeypatch):
    whole = line_dedup._line_rows
    monkeypatch.setattr(line_dedup, "_line_rows", lambda *a: whole(*a).withColumn("sid", F.pmod("sid", F.lit(7))))
    rows = [(i, f"w{i} x{i} y{i}") for i in range(40)] + [(100 + i, f"y{i} w{i} x{i}") for i in range(20)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(i >= 100) for i, _ in rows}


def test_line_dedup_of_many_variants(spark):
    rng = random.Random(8)
    base = [f"k{j}" for j in range(20)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(20)] = rng.choice(VOCAB)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: want[i] for i, _ in rows}


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choice(["read more", "Menu", "menu", "a b c", "a b c d", "a b c d e", "", " \t", "c b a", sentence(3, rng)]) for _ in range(8))) for i in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()
    want = brute_lines(rows)
    assert {r.doc_id: r.n_removed for r in got} == {i: want[i] for i, _ in rows}
    assert sum("read more" in r.text.split("\n") for r in got) == 1


def test_packing(docs):
    df = packing.pack_texts(docs)
    got = df.collect()
    assert sum(r.n_tokens for r in got) == sum(len((r.text or "").split()) for r in docs.collect())
    bins = {}
    for r in got:
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        used = sum(r.n_tokens for r in held)
        assert held[0].bin_length == min(x for x in packing.LENGTHS if x >= used)
        assert sorted(r.bin_offset for r in held) == sorted(np.cumsum([0, *[r.n_tokens for r in sorted(held, key=lambda r: r.bin_offset)]])[:-1].tolist())
    assert packing.pack_texts(empty(docs)).count() == 0


def test_packing_is_near_the_least_cost():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 4096) for _ in range(500)), reverse=True)
    where, caps = packing.pack(sizes)
    assert sum(caps) <= 1.05 * sum(sizes) and len(where) == 500


def test_decontamination(spark):
    rng = random.Random(11)
    items = [sentence(40, rng) for _ in range(5)]
    w = items[1].split()
    edited = " ".join(rng.choice(VOCAB) if k % 7 == 3 else x for k, x in enumerate(w))
    dropped = " ".join(x for k, x in enumerate(items[2].split()) if k % 9)
    rows = [(1, sentence(80, rng) + " " + items[0].upper() + " " + sentence(50, rng), 0), (2, sentence(30, rng) + " " + edited, 0), (3, sentence(300, rng), 0), (4, dropped, 0), (None, items[4], 0), (6, None, 0), (7, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item int")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, ""), (11, "two words")], "item_id long, text string")
    got = {(r.id, r.item) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 0), (2, 1), (4, 2), (None, 4)}
    assert [r.doc_id for r in decontaminate.drop_leaks(df, bench).orderBy("doc_id").collect()] == [3, 6, 7]
    assert decontaminate.leaks(df.filter("false"), bench).count() == decontaminate.leaks(df, bench.filter("false")).count() == 0


def test_pieces_of_a_batch():
    texts = ["a" * 30, None, "", "b" * 5, "é" * 40, None, "c" * 9]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    for size in (1, 10, 32, 1 << 20):
        got = list(pieces(b, 1, size))
        assert all(p.num_rows for p in got) and pa.Table.from_batches(got).to_pydict() == b.to_pydict()
        assert all(sum(len((t.as_py() or "").encode()) for t in p.column(1)) < size + 80 for p in got)  # the longest has 80
    assert len(list(pieces(b, 1, 32))) > 2 and not list(pieces(b.slice(0, 0), 1))


def traced(made):
    """What made() returns, and the most MB that were allocated in Python and numpy meanwhile."""
    tracemalloc.start()
    try:
        return made(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_large_batches():
    """Counting seeds and making shingle sets of 8 MB of text takes as much as a piece of it does."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocab, k=400)) for _ in range(4000)]
    items = decontaminate.Items(pa.array([1, 2]), [texts[5][:300], texts[5][:200]])
    b = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["node", "text"])
    counts, mb = traced(lambda: decontaminate.tally(iter([b.select(["text"])]), items))
    seeds = [tuple(w) for t in (texts[5][:300], texts[5][:200]) for w in zip(t.split(), t.split()[1:], t.split()[2:])]
    shared = set(seeds)
    found = Counter(w for t in texts for w in zip(t.split(), t.split()[1:], t.split()[2:]) if w in shared)
    assert counts.sum() == sum(found.values()) and mb < 30
    (sizes, last), mb = traced(lambda: [(sum(x), y) for x, y in [list(zip(*((s.num_rows, s.column(1)[-1].as_py()) for s in simhash.shingle_sets(iter([b]), 5))))]][0])
    assert sizes == 4000 and last[-1] == np.unique(simhash.shingle_hashes(texts[-1].encode().split(), 5)).tobytes() and mb < 6


def test_kept_text_is_sent_once(spark, docs):
    """The network of the pipeline's first stage gets each text once; columns, nulls and other types of text come back as they were."""
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    once = toxicity.drop_toxic(docs, labels)
    assert "__cataloom_text" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, once.collect())) == sorted(map(repr, docs.collect()))
    other = docs.withColumn("text", F.col("text").cast("binary"))
    assert sorted(map(repr, toxicity.drop_toxic(other, labels).collect())) == sorted(map(repr, other.collect()))


def brute_score(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_scores():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 30)
        assert decontaminate.align(a, b)[0] == brute_score(a, b)


def test_quality(spark):
    rng = random.Random(2)
    texts = [None, "", "one", " \t\x0b ", sentence(40, rng), "\n".join([sentence(12, rng)] * 5), "A B\x0bC " * 30, sentence(30, rng) + "\n" + sentence(30, rng)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["x y " * 6000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.judge_documents(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.judge_documents(df.filter("false")).count() == 0


def brute_passes(line):
    x = line.strip("\t\n\x0b\x0c\r ")
    n = len(x.split(" "))
    letters, capitals = sum(c.isalpha() for c in x), sum(c.isupper() for c in x)
    ends = x[-1] in ".!?:;,\u2026\"'\u201d\u2019\u00bb)]" or n <= 12
    noisy = n > 2 and 3 * len(re.findall(r"[!?*#$%&.,;:]{2,}(?=\s|$)", x)) > n
    shouted = re.search("[A-Z]{3}", x) and letters >= 20 and 2 * capitals > letters
    navigation = n > 3 and 4 * len(re.findall("[|\u00bb\u203a\u2192\u2022\u00b7/]\\s", x)) >= n
    boilerplate = n <= 30 and re.search(r"(?i)\b(?:cookie|privacy policy|copyright|newsletter|log ?in)", x)
    return bool(ends and not (noisy or shouted or 10 * sum(x.count(c) for c in "#*$%&|<>") > n or navigation or boilerplate))


def test_quality_removes_failing_lines(spark):
    rng = random.Random(6)
    bad = ["Home \u2022 Shop \u2022 Cart \u2022 Help", "We use cookies, see the privacy policy.", sentence(20, rng)[:-1], "what!! is!! this!!", "SHOUTING ALL THE TIME ABOUT IT", "# $ % &"]
    texts = ["\n".join(rng.choice([*bad, "", " \t", "A heading", sentence(15, rng), sentence(25, rng)]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    long = sentence(30, rng)
    texts += [long + "\n" + "\n".join(bad[:2]), None, "", "\n".join([bad[1]] * 9 + [long])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.judge_documents(df).collect()}
    for r in quality.clean_documents(df).collect():
        lines = (texts[r.doc_id] or "").split("\n")
        gone = [i for i, x in enumerate(lines) if x.strip() and not brute_passes(x)]
        whole, lost = sum(len(x) for x in lines if x.strip()), sum(len(lines[i]) for i in gone)
        assert r.removed_lines == gone and (r.line_chars, r.removed_chars) == (whole, lost)
        assert r.text == (None if texts[r.doc_id] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
        assert kept[r.doc_id][0] == (not kept[r.doc_id][1] and lost <= 0.5 * whole)
    assert {k for k, _ in kept.values()} == {True, False} and quality.clean_documents(df.filter("false")).count() == 0


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["vexol", "vexora", "vexing"]
    rows, labels = [], []
    for i in range(400):
        w = sentence(rng.randint(20, 90), rng).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1 if i % 4 == 0 else 0))
    rows += [(None, None, "x"), (1000, "", "x"), (1001, sentence(3000, rng) + " vexol vexora " + sentence(500, rng), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert got[1001].predicted == 1 and got[None].score == got[1000].score == 0
    assert toxicity.drop_toxic(df, lab).columns == df.columns
    assert toxicity.toxicity(df, lab.filter("false")).count() == df.count()


def test_sharding(docs):
    got = sharding.shard_rows(docs).collect()
    assert len(got) == docs.count()
    shard_of, slots = {}, {}
    for r in got:
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard and r.grown_shard is None and r.law == "bytes"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(8))
    want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.size, r.text_crc32) for r in got) == want
    assert sharding.shard_rows(empty(docs)).count() == 0


def brute_cut(sizes, shards):
    best = {(0, 0): 0}
    for n in range(1, shards + 1):
        for i in range(len(sizes) + 1):
            best[n, i] = min((max(best[n - 1, j], sum(sizes[j:i])) for j in range(i + 1) if (n - 1, j) in best), default=10**9)
    return best[shards, len(sizes)]


def test_cuts_are_minimax():
    for _ in range(20):
        sizes = [RNG.randint(0, 30) for _ in range(RNG.randint(1, 14))]
        capacity, at = sharding.cuts(sizes, 3)
        assert capacity == max(1, brute_cut(sizes, 3)) and len(at) < 3


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(r.text.split()) for r in docs.collect())


LONG = "<p>" + "A paragraph about rivers and the boats that go on them. " * 5 + "</p>"
PARAGRAPH = ("A paragraph about rivers and the boats that go on them. " * 5).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div class=top><a href=x>Home</a></div><div class=story><h1>Rivers</h1>{LONG}<p>Short.</p>{LONG}</div><div class=x><p>Reader Bob wrote: nice post</p></div><div>(c) 2020 Foo</div></body>", ["Rivers", PARAGRAPH, "Short.", PARAGRAPH]),
        (f"<body><a href=x>Home</a><br><a href=y>About</a><h1>Rivers</h1>{LONG}<p>Short.</p>{LONG}<p>Reader Bob wrote: nice post</p><p>(c) 2020 Foo</p></body>", ["Rivers", PARAGRAPH, "Short.", PARAGRAPH]),
        (f"<article><h1>T</h1>{LONG}<div class='search-tips'>Use quotes</div><p class='alert-level'>Level two</p><div class='comment-list'><p>hey</p></div><p>x</p><div class=ad>buy</div></article><footer>f</footer>", ["T", PARAGRAPH, "Use quotes", "Level two", "x"]),
        (f"<main><p>Menu of the day</p></main><main>{LONG}<p>y</p></main>", [PARAGRAPH, "y"]),
        (f"<nav><ul><li>never closed<article>{LONG}</article>", [PARAGRAPH]),
        ("<div>a</div>", ["a"]),
        ("<p><a href=x>only a link</a></p>", []),
    ],
)
def test_html_regions(page, want):
    assert html_extract.main_text(page) == "\n".join(want)


def brute_terms(rows):
    """Terms that disclose, by counting whole texts."""
    spans = [brute_spans(t) for _, t in rows]
    ents = [{(k, (t[int(a) : int(b)].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", t[int(a) : int(b)]))) for k, a, b in (x.split(":") for x in s.split(",") if x)} for (_, t), s in zip(rows, spans)]
    terms = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", re.sub(PATTERNS["email"], " ", t))} for _, t in rows]
    n = len(rows)
    own = [e | {(k,) for k, _ in e} for e in ents]
    shown = {}
    for e in set().union(*own):
        df_e = sum(e in o for o in own)
        if len(e) == 2 and len({t for (_, t), o in zip(rows, own) if e in o}) < pii.SUPPORT or df_e == n:
            continue
        for w in set().union(*(t for t, o in zip(terms, own) if e in o)):
            both = [i for i in range(n) if e in own[i] and w in terms[i]]
            df_t = sum(w in t for t in terms)
            if len({rows[i][1] for i in both}) >= pii.SUPPORT and math.log2(n * len(both) / (df_e * df_t)) >= pii.DISCLOSURE * math.log2(n / df_e) - 1e-9:
                shown.setdefault(w, set()).add(e[0] if len(e) == 1 else "value")
    out = {}
    for (i, t), o in zip(rows, ents):
        kinds = {k for k, _ in o} | {"value"}
        mail = [m.span() for m in re.finditer(PATTERNS["email"], t)]
        out[i] = [m.span() for m in re.finditer(r"[^\W\d_]{4,}", t) if shown.get(m[0].lower(), set()) & kinds and not any(a < m.end() and m.start() < b for a, b in mail)]
    return out


def test_pii_terms_by_count(spark):
    rng = random.Random(21)
    rows = []
    for i in range(160):
        t = sentence(rng.randint(5, 30), rng)
        if i % 9 == 0:
            t += f" Contactme under user{i}@mail.org please"
        if i % 16 == 1:
            t += " Zorblax of 10.0.0.7 wrote"
        if i % 80 == 3:
            t += " zorblax alone, Contactme"
        rows.append((i, t))
    rows += [(200, rows[0][1]), (201, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(x.s, x.e) for x in r.term] for r in pii.find_spans(df).collect()}
    want = brute_terms(rows)
    assert got == want
    assert any(rows[3][1][s:e] == "zorblax" for s, e in want[3]) and sum(map(len, want.values())) > 20


def test_rows_of_one_id_and_text_are_parted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    monkeypatch.setattr(sharding, "CELLS", 8)
    df = spark.createDataFrame([(None if i % 2 else 7, "one two three") for i in range(400)] + [(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(5)
    packed = packing.pack_texts(df).collect()
    assert len(packed) == 440 and len({r.bin_id >> 32 for r in packed if r.doc_id == 7}) > 1
    used = Counter()
    for r in packed:
        used[r.bin_id] += r.n_tokens
    assert all(used[r.bin_id] <= r.bin_length for r in packed) and sum(used.values()) == 400 * 3 + 80
    assert len({(r.bin_id, r.bin_offset) for r in packed}) == 440
    slots = sharding.shard_rows(df, 3).collect()
    for k in range(3):
        assert sorted(r.slot for r in slots if r.shard == k) == list(range(sum(r.shard == k for r in slots)))


def test_packing_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    rows = [(i if i % 3 else i // 3, sentence(rng.choice([5, 60, 300, 700]), rng)) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    a, b = (packing.pack_texts(spark.createDataFrame(r, "doc_id long, text string")).collect() for r in (rows, rows[::-1]))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    named = packing.pack_texts(spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")).collect()
    assert len(named) == len(a)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_decontamination_takes_any_item_id(spark, kind):
    rng = random.Random(3)
    items = [sentence(20, rng) for _ in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    df = spark.createDataFrame([(1, sentence(9, rng) + " " + items[2]), (2, sentence(40, rng))], "doc_id int, text string")
    got = decontaminate.leaks(df, bench)
    assert got.schema["item"].dataType == bench.schema["item_id"].dataType and [str(r.item) for r in got.collect()] == ["2"]


def test_decontamination_against_alignment_without_seeds(spark):
    """Copies in which up to every fourth word is changed, dropped or added, against Smith-Waterman over all pairs."""
    rng = random.Random(17)
    items = [sentence(30, rng) for _ in range(6)]
    rows = []
    for i in range(60):
        w = items[i % 6].split()
        share = rng.choice([0, 0.08, 0.15, 0.25])
        out = []
        for x in w:
            u = rng.random()
            out += [x] if u >= share else rng.choice([[], [rng.choice(VOCAB)], [x, rng.choice(VOCAB)]])
        rows.append((i, " ".join([sentence(20, rng), *out, sentence(20, rng)])))
    code = {}
    ints = lambda t: np.array([code.setdefault(w, len(code)) for w in words(t)])
    want = {(i, j) for i, t in rows for j, item in enumerate(items) if decontaminate.align(ints(item), ints(t))[0] >= max(decontaminate.SHARE * 2 * len(words(item)), decontaminate.LEAST)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.id, r.item) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 40


def test_the_verdict_comes_from_the_recurrent_layer():
    import pyarrow as pa

    rng = random.Random(6)
    texts = [sentence(40, rng) + (" vexol vexora vexing " if i % 4 == 0 else " ") + sentence(30, rng) for i in range(400)]
    labels = [int(i % 4 == 0) for i in range(400)]
    net = toxicity.train(texts[:300], labels[:300])

    def found(net):
        got = np.zeros(100)
        for w in toxicity.chunks(pa.array(texts[300:])):
            row, logit = toxicity.window_scores(net, w)
            np.maximum.at(got, row, 1 / (1 + np.exp(-logit.astype(float))))
        return [int(x >= toxicity.THRESHOLD) for x in got]

    assert sum(a == b for a, b in zip(found(net), labels[300:])) >= 97
    net.p["x"], net.p["bx"] = np.zeros_like(net.p["x"]), np.zeros_like(net.p["bx"])  # states see no input
    assert len(set(found(net))) == 1


def test_toxicity_gradients():
    from cataloom.llm.words import hashed

    rng = np.random.default_rng(1)
    w = hashed([b"one two three four five six seven", b"two three bad words here and there now"], range(2))
    net = toxicity.Network(3)
    net.p = {k: v + 0.2 * rng.standard_normal(v.shape) for k, v in net.p.items()}
    i = toxicity.Inputs(w)
    start, row = toxicity.windows(w.row)
    ids, mask = toxicity._laid(w.row, i, start, row)
    label, ones = np.array([0.0, 1.0]), np.ones(2)
    g = net.gradients(i, ids, mask, label, ones, np.ones(len(i.word)))

    def loss():
        logit = net.forward(net.vectors(i), ids, mask)
        return float(np.mean(np.log1p(np.exp(logit)) - label * logit))

    for k, v in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if k in ("word", "gram"):
                at = (int(rng.choice(i.word if k == "word" else i.gram)), at[1])
            old, sides = v[at], []
            for step in (1e-3, -1e-3):
                v[at] = old + step
                sides.append(loss())
            v[at] = old
            assert abs((sides[0] - sides[1]) / 2e-3 - g[k][at]) < 5e-4, (k, at)
