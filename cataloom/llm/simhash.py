"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside blocks, and connected classes.

Candidates meet in blocks. For a small radius the blocks are exact: the 64 bits are cut into five parts and any two
fingerprints at distance <= 2 agree on three of them, so ten (3 of 5) keys lose no link. For similarity classes on word
shingles the blocks are bands of a min-wise signature and the fingerprint has 256 bits; near pairs are then verified by exact Jaccard.
Inside a block, bit planes are stored vertically; distances of many pairs are counted at once by carry-save counters,
and a row of comparisons is abandoned as soon as all of it exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, groups, pieces, sent, staged, tidy, word_bytes
from .components import components

SEED = 42
#: Members of a block compared by one task at once; larger blocks are dealt out as pairs of chunks.
CHUNK = 4096
#: Query rows compared with a whole chunk in one numpy operation.
ROWS = 256
#: Min-wise signature for similarity classes: at similarity 0.8 a pair shares a band with probability 0.9998.
BANDS, BAND_ROWS = 16, 4
#: Least Jaccard similarity of shingle sets that links documents.
SIMILARITY = 0.8
#: Filter among 256 bits before similarity is computed: the expected distance at similarity 0.8 is 39, its deviation 6.
SIMILAR_RADIUS = 72
PARTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; of the whole sequence if there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    norm = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends[: -k]]]
    h = xxhash.xxh64_intdigest
    return np.array([h(norm[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes; 0 for none."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, as a signed long; fp 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(majority_bits(shingle_hashes(word_bytes(t.as_py()), k))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {field_type(src, 'id')}, fp bigint")


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """An independent-looking 64-bit hash of h for every i (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _wide(words: list[bytes], k: int) -> tuple[list[int], list[int], int]:
    """256 fingerprint bits of the set of shingles as four longs, a key for each band, and a hash of the set."""
    u = np.unique(shingle_hashes(words, k))
    fp = [_signed(majority_bits(mixed(u, 1000 + i))) for i in range(4)]
    node = _signed(xxhash.xxh64_intdigest(u.tobytes(), SEED))
    if not len(u):
        return fp, [0] * BANDS, node
    sig = np.array([mixed(u, i).min() for i in range(BANDS * BAND_ROWS)], np.uint64).reshape(BANDS, BAND_ROWS)
    return fp, [_signed(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(sig)], node


def wide_fingerprints(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, fp, bands, node): h is the hash of the text that tells rows of one id apart, node that of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in pieces(whole, 2)):
            made = [_wide(word_bytes(t.as_py()), k) for t in b.column(2)]
            arrays = [b.column(0), b.column(1), *(pa.array([m[j] for m in made], pa.list_(pa.int64())) for j in (0, 1)), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "fp", "bands", "node"])

    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {field_type(src, 'id')}, h bigint, fp array<bigint>, bands array<bigint>, node bigint")


def near_rows(fps: np.ndarray, radius: int, steps: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later members within the radius) for the members of a block; fps: n x words of uint64.

    steps: gets the number of rows still compared, now and then.
    """
    n, words = fps.shape
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8 * words), axis=1)
    width = -(-n // 64)
    planes = np.zeros((bits.shape[1], width * 64), np.uint8)
    planes[:, :n] = bits.T
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    full = ~np.uint64(0)
    depth = int(radius).bit_length()
    first = (1 << depth) - 1 - radius  # so that the counter overflows exactly beyond the radius
    valid = np.packbits(np.r_[np.ones(n, np.uint8), np.zeros(width * 64 - n, np.uint8)], bitorder="little").view("<u8")
    # planes that differ for most members come first, so that blocks are abandoned early
    order = np.argsort(np.abs(bits.mean(axis=0) - 0.5), kind="stable")
    order = order[(bits[:, order].min(axis=0) != bits[:, order].max(axis=0))]
    for at in range(0, n, ROWS):
        rows = np.arange(at, min(n, at + ROWS))
        lo = at // 64  # members before the first row were compared already
        count = [np.full((len(rows), width - lo), full if first >> j & 1 else 0, np.uint64) for j in range(depth)]
        over = np.broadcast_to(~valid[lo:], (len(rows), width - lo)).copy()
        own = rows // 64 - lo  # a row and those before it are out, so that it is abandoned once all later ones are
        over |= np.where(np.arange(width - lo) < own[:, None], full, np.uint64(0))
        over[np.arange(len(rows)), own] |= full >> (np.uint64(63) - (rows % 64).astype(np.uint64))
        for done, p in enumerate(order):
            carry = planes[p, lo:][None, :] ^ np.where(bits[rows, p], full, np.uint64(0))[:, None]
            for j in range(depth):
                count[j], carry = count[j] ^ carry, count[j] & carry
            over |= carry
            if done % 4 == 3:
                alive = (over != full).any(axis=1)
                if steps is not None:
                    steps.append(int(alive.sum()))
                if not alive.all():
                    rows, over, count = rows[alive], over[alive], [c[alive] for c in count]
                    if not len(rows):
                        break
        for i, o in zip(rows, ~over):
            near = np.flatnonzero(np.unpackbits(o.view(np.uint8), bitorder="little")) + lo * 64
            near = near[near > i]
            if len(near):
                yield int(i), near


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect the members of a block as all pairs within the radius would, at most n - 1 of them."""
    label, links = np.arange(len(fps)), []
    for i, near in near_rows(fps, radius):
        others, first = np.unique(label[near], return_index=True)
        for root, j in zip(others, near[first]):
            if root != label[i]:
                links.append((i, int(j)))
                label[label == root] = label[i]
    return links


def apart(fps: np.ndarray, root: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """All pairs of members within the radius that have different roots."""
    return [(i, int(j)) for i, near in near_rows(fps, radius) for j in near[root[near] != root[i]]]


def links_in_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v) links that join the nodes of rows(t, key, node, fp array) whenever fingerprints in one block are near.

    With a column root, all pairs near each other in one block whose roots differ.
    A block of more than CHUNK members is dealt out as all pairs of its chunks, so that no task holds a whole large block.
    """
    big = staged(rows.groupBy("t", "key").count().filter(F.col("count") > CHUNK), "blocks")
    m = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / CHUNK).cast("int")
    labelled = "root" in rows.columns
    root = F.col("root") if labelled else F.lit(0).cast("long").alias("root")
    mine = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    dealt = (
        rows.join(big, ["t", "key"], "left").withColumn("m", m).withColumn("c", mine)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("t", "key", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "node", "fp", root)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 4):
            node = g.column(4).to_numpy()
            flat = g.column(5).combine_chunks()
            flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
            fps = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(node), -1)
            found = forest(fps, radius) if not labelled else apart(fps, g.column(6).to_numpy(), radius)
            if found:
                a, b = (pa.array(node[list(x)], pa.int64()) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([a, b], ["u", "v"])

    keys = ["t", "key", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def _with_least(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(node, least) with the least of the whole class: (node, component_id)."""
    roots = staged(components(links), "roots")
    linked = nodes.join(roots.union(roots.select("root", "root").distinct()), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    per_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(per_root, "root").select("node", "component_id")


def shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, x) for batches of (node, text): the sorted shingle hashes of each text as bytes, for a piece of a batch at a time."""
    for b in (p for whole in batches for p in pieces(whole, 1)):
        made = [np.unique(shingle_hashes(word_bytes(t.as_py()), k)).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["node", "x"])


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs(u, v) whose sets of k-word shingles have similarity SIMILARITY or more, computed from the texts of nodes."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    where = staged(nodes.join(wanted, "node", "left_semi").select("node", F.col("least.id").alias("wid"), F.col("least.h").alias("wh")), "wanted")
    d = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    texts = d.join(sent(where), d.id.eqNullSafe(where.wid) & (d.h == where.wh)).select("node", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shingle_sets(batches, k)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= SIMILARITY * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    sets = staged(texts.mapInArrow(shingles, "node bigint, x binary").dropDuplicates(["node"]), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), "x"), "u").join(sets.select(F.col("node").alias("v"), F.col("x").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(judge, "u bigint, v bigint")


def similar_links(nodes: DataFrame, df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(u, v) verified links that connect nodes as all verified pairs would.

    First a forest of each block is verified. Then the pairs between the classes which that makes are, all of them; pairs
    inside a class can't change it.
    """
    blocks = nodes.select("node", "fp", F.posexplode("bands").alias("t", "key")).select("t", "key", "node", "fp")
    first = staged(links_in_blocks(blocks, SIMILAR_RADIUS).distinct(), "pairs")
    sure = staged(_verified(first, nodes, df, k, id_col, text_col), "similar")
    roots = staged(components(sure), "roots")
    labelled = blocks.join(roots, "node", "left").select("t", "key", "node", "fp", F.coalesce("root", "node").alias("root"))
    pairs = links_in_blocks(labelled, SIMILAR_RADIUS).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = staged(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
    return sure.union(staged(_verified(more, nodes, df, k, id_col, text_col), "similar"))


@tidy
def simhash_classes(df: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row: fingerprints link at two or fewer differing bits.

    fingerprint: 16 hex digits. component_id: the smallest id reachable through links, the row's own included (null only
    if every id of the class is null). Null and empty texts have fingerprint zero, which links like any other; equal texts,
    ties and repeated rows share a class; a row comes out once for each time it comes in. Other columns are not read.
    """
    rows = staged(fingerprints(df, k, id_col, text_col), "fingerprints", keep=True)
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")).select(F.col("fp").alias("node"), "least"), "nodes")
    masks = [sum((1 << z) - (1 << a) for a, z in chosen) for chosen in combinations(PARTS, 3)]
    keys = [F.struct(F.lit(t).alias("t"), F.col("node").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    blocks = nodes.select("node", F.array("node").alias("fp"), F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "node", "fp")
    classes = staged(_with_least(nodes, links_in_blocks(blocks, 2)), "classes", keep=True)
    out = rows.join(classes, rows.fp == classes.node)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@tidy
def drop_near_duplicates(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each class of near-duplicates: the one with the smallest id, then text hash.

    Rows link when the Jaccard similarity of their sets of k-word shingles is SIMILARITY or more, computed from the texts.
    Pairs are found by a shared band (0.9998 of those at 0.8) and 256-bit fingerprints within SIMILAR_RADIUS. All empty and null texts form one class. A null id comes first; of rows equal in
    id and text one stays. Columns of df are returned unchanged, whatever their names.
    """
    rows = staged(wide_fingerprints(df, k, id_col, text_col), "wide")
    same = rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("least"), F.min_by(F.struct("fp", "bands"), F.struct("id", "h")).alias("x"))
    nodes = staged(same.select("node", "least", "x.fp", "x.bands"), "nodes")
    classes = _with_least(nodes.select("node", "least"), similar_links(nodes, df, k, id_col, text_col))
    kept = staged(classes.select(F.col("component_id.id").alias("_id"), F.col("component_id.h").alias("_h")).distinct(), "kept", keep=True)
    d = df.withColumn("__cataloom_h", F.xxhash64(text_col)).withColumn("__cataloom_id", F.col(id_col))
    stay = d.join(sent(kept), d["__cataloom_id"].eqNullSafe(kept["_id"]) & (d["__cataloom_h"] == kept["_h"]), "left_semi")
    return stay.dropDuplicates(["__cataloom_id", "__cataloom_h"]).drop("__cataloom_id", "__cataloom_h")
