"""Tokenizer alignment, top-k search and the conversation trie against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cataloom.llm import alignment, conversations, topk

WORDS = r"[^\x20\x09-\x0D]+"


# --- alignment


@pytest.fixture(scope="module")
def both():
    return alignment.load(alignment.TOKENIZERS)


def brute_alignment(texts, t):
    made, counts = [], Counter()
    for text in texts:
        links, groups, sides = [], "", [[], []]
        if text:
            want = (" " + text).encode()
            ids = (t.plain.encode(" " + text, add_special_tokens=False).ids, t.pieces.encode(text))
            for side, own, v in zip(sides, ids, (t.a, t.b)):
                at = 0
                for i in own:
                    piece = v.spelled[i]
                    side.append((i, at, at + len(piece), piece))
                    at += len(piece)
            if any(b"".join(x[3] for x in s) != want for s in sides):
                sides = [[], []]
            links = [(a[0], b[0]) for a in sides[0] for b in sides[1] if a[1] < b[2] and b[1] < a[2]]
            cuts = sorted({a[2] for a in sides[0]} & {b[2] for b in sides[1]})
            spans = list(zip([0, *cuts], cuts))
            groups = ";".join("|".join(",".join(str(x[0]) for x in s if lo <= x[1] < hi) for s in sides) for lo, hi in spans)
            made.append((len(sides[0]), len(sides[1]), len(spans), links, groups))
        else:
            made.append((0, 0, 0, [], ""))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if a else "") for a, b, g, links, s in made]


def test_alignment(spark, both):
    rng = random.Random(2)
    words = ["naïve", "über", "Thtion", "x1y2", "  ", "\n", "\t", "don't", "<|endoftext|>", "</s>", "123456", "日本語", "🙂", "é́", "a" * 40, "the", "of", "re", "...", "\x00", "ſ"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += [None, "", " ", "\n\n", "a▁b", "plain text", "plain text", "<s>", "plain text " * 3000]
    rows = [(i, x, "y") for i, x in enumerate(texts)] + [(None, "plain text", "z"), (5, texts[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, *(r[k] for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in alignment.align(df).collect())
    want = brute_alignment([r[1] for r in rows], both)
    assert got == sorted((r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, want))
    zero = {r[0]: r for r in got}
    assert all(zero[60 + i][1:] == (0, 0, 0, 0, 0, 0, "") for i in (0, 1, 4))
    assert alignment.align(df.filter("false")).count() == 0


def test_alignment_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some words of text " * (i + 1)) for i in range(9)], "doc_id long, text string")
    one = sorted(map(tuple, alignment.align(df).collect()))
    monkeypatch.setattr("cataloom.llm.common.SEND_BYTES", 0)
    assert sorted(map(tuple, alignment.align(df).collect())) == one


def test_both_encoders_agree_on_stable_text(both):
    rng = random.Random(4)
    stable = [chr(c) for c in (*range(0x250), *range(0x400, 0x460), *range(0x2010, 0x2028), 0x20AC)]
    for _ in range(300):
        text = "".join(rng.choice(stable if rng.random() < 0.5 else "abc \n'") for _ in range(80))
        assert not alignment._STABLE.search(text)
        assert both.encode_a(text) == both.plain.encode(text, add_special_tokens=False).ids


# --- top-k


def brute_top_k(rows, k=5):
    v = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in e]) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for a, (i, x) in enumerate(v):
        if i is not None and i % 50 == 0:
            s = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j if j is not None else 0) for b, (j, y) in enumerate(v) if b != a)
            out += [(i, r + 1, None if none else j, -score) for r, (score, none, j) in enumerate(s[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [40, 8192])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CELL_ROWS", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[rng.integers(6)] + 0.2 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1200)]  # ties
    rows += [(50, rows[3][1]), (50, rows[50][1]), (50, rows[50][1]), (-50, [0.5] * 8), (None, [9.0] * 8), (2000, None), (2050, [None] + [1.0] * 7), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2250, [])]
    df = spark.createDataFrame([(i, e, "s") for i, e in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted((tuple(r) for r in topk.top_k(df).collect()), key=str)
    assert got == brute_top_k(rows)
    assert topk.top_k(df.filter("false")).count() == 0
    assert topk.top_k(df.filter("vec_id = 7")).count() == 0
    few = df.filter("vec_id in (50, 51) and score = 's'")
    assert len(topk.top_k(few).collect()) == len(brute_top_k([r for r in rows if r[0] in (50, 51)]))


def test_cover_tree_holds_its_invariants():
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(500, 5)) * 100, np.zeros((50, 5))]))
    tree = topk.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(550)) and (tree.x == x[tree.order]).all()
    for level, start in zip(tree.levels, tree.starts):
        for c, r, a, z in zip(level.centre, level.radius, start, [*start[1:], len(x)]):
            assert np.sqrt(((tree.x[a:z] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
    assert len(tree.levels) > 2 and tree.levels[-1].first[-1] == len(x)


def test_pairs_are_pruned():
    rng = np.random.default_rng(5)
    x = np.round(np.concatenate([rng.normal(size=(400, 4)) + 300 * np.eye(4)[i] for i in range(4)]))
    q, tree = topk.CoverTree(x[:100]), topk.CoverTree(x)
    best = topk.Best(100, 5)
    topk.dual_search(q, tree, best, np.arange(len(x))[tree.order], np.arange(len(x))[tree.order], np.full(100, -1))
    i, _, _ = topk.surviving_leaves(q, tree, best.score[:, -1].astype(float))
    assert len(i) < 0.5 * (len(q.levels[-1].first) - 1) * (len(tree.levels[-1].first) - 1)


def test_products_beyond_floats_are_exact():
    x = np.array([[2.0**30, 3.0]])
    assert topk.inner_products(x, np.array([[2.0**30, 5.0]])).tolist() == [[2**60 + 15]]


# --- trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = []
    for p, who in members.items():
        below = [x for x in members if x[: len(p)] == p]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ended = sorted(c for c in who if convs[c] == p)
        saved = sum((len(members[x]) - 1) * len(re.findall(WORDS, x[-1][1])) for x in below if x)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(len(x) == len(p) + 1 for x in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=str)


def turns(seed=7, n=70):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 2)))) for c in range(n) for t in range(rng.randint(1, 5))]
    rows += [(200, t, "user", f"turn {t}") for t in range(300)]  # a deep one
    rows += [(201, t, "user", f"turn {t}") for t in range(150)] + [(c, t, "user", f"turn {t}") for c in (202, 203) for t in range(300)]
    return rows + [(300, None, None, None), (300, None, "x", "y"), (300, 1, "a", "b"), (300, 1, "a", "b"), (None, 1, "a", "b"), (41, 0, None, "zz zz")]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_trie(spark, bits):
    rows = turns(n=70 if bits else 8)
    rows = rows if bits else rows[:20]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(6)
    got = sorted((tuple(r[k] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in conversations.prefix_trie(df, bits=bits).collect()), key=str)
    assert got == brute_trie(rows)


def test_turnless_and_empty_tables(spark):
    rows = [(c, 0, "user", "only") for c in (21, 22, 23, 24, 25, 26)]  # their block's first conversation is absent
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[k] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in conversations.prefix_trie(df).collect()), key=str)
    assert got == brute_trie(rows)
    assert conversations.prefix_trie(df.filter("false")).count() == 0


def test_carries_join_runs_over_partitions():
    key = np.repeat([1, 2, 3], [4, 30, 6])
    term = np.random.default_rng(0).integers(0, 1 << 63, len(key), dtype=np.uint64)
    whole = conversations.Scan().add(key, term, [np.arange(len(key))])
    edges, local = [], []
    for part, (a, z) in enumerate([(0, 7), (7, 7), (7, 19), (19, 25), (25, 40)]):
        if a < z:
            scan = conversations.Scan()
            nth, fp, (s,) = scan.add(key[a:z], term[a:z], [np.arange(a, z)])
            edges.append((part, key[a], key[z - 1], int(nth[-1]), int(fp[-1].view(np.int64)), [int(s[-1])]))
            local.append((part, key[a:z], nth, fp, s))
    into = conversations.carries(edges)
    got = []
    for part, k, nth, fp, s in local:
        first, n, carried, (total,) = into.get(part, (None, 0, 0, [0]))
        for i in range(len(k)):
            own = int(k[i] == first)
            power = pow(conversations._P, int(nth[i]), 1 << 64)
            got.append((nth[i] + n * own, (int(fp[i]) + carried * power * own) % (1 << 64), s[i] + total * own))
    assert got == list(zip(whole[0].tolist(), whole[1].tolist(), whole[2][0].tolist()))
