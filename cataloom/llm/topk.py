"""Exact search for the highest inner products with two cover trees at a time.

Queries are rows of the table, so both share one index. Its upper nodes are cells around pivots, which a farthest-first walk
over a bounded sample picks; every vector belongs to its nearest pivot. A cell is dealt out in blocks, and each block has a
cover tree of its own. A pair of nodes (Q of queries, X of candidates) with centres q, x and covering radii r, s is pruned if
<q,x> + |q|s + |x|r + rs, which no pair of their members exceeds, is below the worst k-th score of Q's queries. Each block
first searches its own queries, which gives these scores; pairs of cells are pruned by them on the driver (CELLS is the
bound), the pairs of nodes below in the tasks of the blocks, to which the surviving groups of queries stream.
Scores are exact integers: they are computed in floating point only where every partial sum is below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, tidy

#: Pivots at most, vectors of a cell while there are fewer, vectors of the sample that pivots are picked from.
CELLS, CELL_ROWS, SAMPLE = 1024, 2048, 8192
#: Vectors of a block at most, about; points of a leaf, about; shrinking of the radius from level to level.
BLOCK, LEAF, BASE = 8192, 32, 1.3
#: Points that a group of queries is compared with at a time.
STEP = 1024
NONE = -(1 << 62)
NO_ID = (1 << 63) - 1


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(axis=-1))


def farthest_first(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the centres, the distance of each to the earlier ones, nearest centre of each point)."""
    square = (x**2).sum(axis=1)
    at, gap, nearest = [0], [np.inf], np.zeros(len(x), np.int64)
    near = np.maximum(square - 2 * (x @ x[0]) + square[0], 0)
    while len(at) < most:
        i = int(near.argmax())
        if near[i] <= 0:
            break
        d = np.maximum(square - 2 * (x @ x[i]) + square[i], 0)
        gap.append(float(np.sqrt(near[i])))
        closer = d < near
        nearest[closer] = len(at)
        near[closer] = d[closer]
        at.append(i)
    return np.array(at), np.array(gap), nearest


@dataclass
class Level:
    """Nodes of a level: centre, its norm, covering radius; the children of node i are first[i]:first[i + 1] of the next level."""

    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    first: np.ndarray


class CoverTree:
    """Nested levels of centres: those of a level are farther apart than its radius, and within it from all they cover.

    The last level's children are points in the tree's own order.
    """

    def __init__(self, x: np.ndarray):
        at, gap, nearest = farthest_first(x, -(-len(x) // LEAF))
        sizes = [1]
        bound = gap[1] if len(gap) > 1 else 0.0
        while sizes[-1] < len(at):
            bound /= BASE
            n = int(np.searchsorted(-gap, -bound, "left"))
            if n > sizes[-1]:
                sizes.append(n)
        # the node of each centre on each level, from the leaves up
        ancestors = [np.arange(len(at))]
        for n in sizes[-2::-1]:
            square = (x[at] ** 2).sum(axis=1)
            gaps = square[:, None] - 2 * (x[at] @ x[at[:n]].T) + square[None, :n]
            parent = gaps.argmin(axis=1)
            parent[:n] = np.arange(n)
            ancestors.append(parent[ancestors[-1]])
        ancestors.reverse()
        leaf_order = np.lexsort(ancestors[::-1])
        place = np.empty(len(at), np.int64)
        place[leaf_order] = np.arange(len(at))
        self.order = np.argsort(place[nearest], kind="stable")
        self.x = x[self.order]
        leaf = nearest[self.order]
        self.levels: list[Level] = []
        self.starts: list[np.ndarray] = []
        for node in ancestors:
            own = node[leaf]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            centre = x[at[own[start]]]
            distance = _distance(self.x, np.repeat(centre, np.diff(np.r_[start, len(x)]), axis=0))
            self.levels.append(Level(centre, np.sqrt((centre**2).sum(axis=1)), np.maximum.reduceat(distance, start), np.zeros(0)))
            self.starts.append(start)
        below = [*self.starts[1:], np.arange(len(x))]
        for level, start, next_start in zip(self.levels, self.starts, below):
            level.first = np.r_[np.searchsorted(next_start, start), len(next_start)]

    def least(self, values: np.ndarray, depth: int) -> np.ndarray:
        """The smallest of the values (in the tree's order) below each node of a level."""
        return np.minimum.reduceat(values, self.starts[depth])


def bounds(q: Level, i: np.ndarray, x: Level, j: np.ndarray) -> np.ndarray:
    """What no inner product between members of the nodes i and j exceeds."""
    inner = np.einsum("ij,ij->i", q.centre[i], x.centre[j])
    reach = (q.norm[i] + q.radius[i]) * (x.norm[j] + x.radius[j])
    return inner + q.norm[i] * x.radius[j] + x.norm[j] * q.radius[i] + q.radius[i] * x.radius[j] + 1e-9 * reach + 1e-6


def _expanded(level: Level, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in nodes, child) for each child of each node."""
    n = level.first[nodes + 1] - level.first[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + level.first[nodes][which]


def surviving_leaves(q: CoverTree, x: CoverTree, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query leaf, candidate leaf, bound) of all pairs not pruned; kth in the order of q's points."""
    i, j, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), [0, 0]
    while True:
        a, b = q.levels[depth[0]], x.levels[depth[1]]
        most = bounds(a, i, b, j)
        keep = most >= q.least(kth, depth[0])[i]
        i, j, most = i[keep], j[keep], most[keep]
        if depth[0] + 1 == len(q.levels) and depth[1] + 1 == len(x.levels) or not len(i):
            return i, j, most
        if depth[0] + 1 < len(q.levels):
            which, i = _expanded(a, i)
            j, depth[0] = j[which], depth[0] + 1
        if depth[1] + 1 < len(x.levels):
            which, j = _expanded(b, j)
            i, depth[1] = i[which], depth[1] + 1


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact, of whole numbers held as floats."""
    most = float(np.sqrt((q**2).sum(axis=1).max(initial=0) * (x**2).sum(axis=1).max(initial=0)))
    return (q @ x.T).astype(np.int64) if most < 2**52 else q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k highest (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE, np.int64), np.full((n, k), NO_ID, np.int64)
        self.fresh = np.ones((n, k), bool)

    @classmethod
    def of(cls, score: np.ndarray, ids: np.ndarray) -> Best:
        """Results known before; what is added later is fresh."""
        best = cls(0, score.shape[1])
        best.score, best.id, best.fresh = score.copy(), ids.copy(), np.zeros(score.shape, bool)
        return best

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        low = self.score[rows, -1]
        if score.shape[1] > k:
            low = np.maximum(low, np.partition(score, -k, axis=1)[:, -k])
        r, c = np.nonzero((score >= low[:, None]) & (score > NONE))
        if not len(r):
            return
        own = np.repeat(np.arange(len(rows)), k)
        new = np.r_[self.fresh[rows].ravel(), np.ones(len(r), bool)]
        r, s, d = np.r_[own, r], np.r_[self.score[rows].ravel(), score[r, c]], np.r_[self.id[rows].ravel(), ids[c]]
        o = np.lexsort((d, -s, r))
        r, s, d, new = r[o], s[o], d[o], new[o]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        top = rank < k
        self.score[rows], self.id[rows], self.fresh[rows] = (v[top].reshape(-1, k) for v in (s, d, new))


def dual_search(q: CoverTree, x: CoverTree, best: Best, ids: np.ndarray, uids: np.ndarray, own: np.ndarray) -> None:
    """Adds x's points (ids, uids in its order) to best; own: uids of q's points, in its order, each not compared with itself."""
    i, j, most = surviving_leaves(q, x, best.score[:, -1].astype(float))
    o = np.lexsort((-most, i))
    i, j, most = i[o], j[o], most[o]
    edge = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(1, np.int64)
    ql, xl = q.levels[-1].first, x.levels[-1].first
    for a, z in zip(edge[:-1], edge[1:]):
        rows = np.arange(ql[i[a]], ql[i[a] + 1])
        size = np.cumsum(xl[j[a:z] + 1] - xl[j[a:z]])
        at = a
        while at < z and most[at] >= best.score[rows, -1].min():
            to = a + int(np.searchsorted(size, (size[at - a - 1] if at > a else 0) + STEP)) + 1
            cols = np.concatenate([np.arange(xl[k], xl[k + 1]) for k in j[at : min(to, z)]])
            score = inner_products(q.x[rows], x.x[cols])
            score[own[rows][:, None] == uids[cols][None, :]] = NONE
            best.add(rows, score, ids[cols])
            at = to


def _blob(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _opened(blob: bytes, n: int, dims: int, k: int = 0) -> tuple[np.ndarray, ...]:
    """(uid, id, vectors, scores, ids of the best) of a block (k = 0) or a group of queries."""
    out, at = [], 0
    for width, kind in ((1, np.int64), (1, np.int64), (dims, np.int32), (k, np.int64), (k, np.int64)):
        a = np.frombuffer(blob, kind, n * width, at)
        out.append(a if width == 1 and len(out) < 2 else a.reshape(n, width))
        at += a.nbytes
    return out[0], out[1], out[2].astype(float), out[3], out[4]


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), dims), np.int32)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(uid, id, v) of the rows that take part; v: floor(scale * x) of each component."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * scale))
    fine = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31 / scale))
    return df.filter(F.col(vec_col).isNotNull()).filter(fine).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), x.cast("array<int>").alias("v"))


def _in_cells(vecs: DataFrame, pivots: np.ndarray) -> DataFrame:
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = (pivots**2).sum(axis=1)
        for b in batches:
            x = _matrix(b.column(2), dims).astype(float)
            cell = (square[None, :] - 2 * (x @ pivots.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(_distance(x, pivots[cell]))], ["uid", "id", "v", "cell", "far"])

    return vecs.mapInArrow(run, "uid bigint, id bigint, v array<int>, cell int, far double")


_ROW = "block int, cell int, is_query int, far double, kth bigint, n int, blob binary"


def _indexed(rows: DataFrame, dims: int, k: int, every: int) -> DataFrame:
    """A row for each block, and one for its queries with their best within the block."""

    def index(t: pa.Table) -> pa.Table:
        uid, ids = t.column("uid").to_numpy(), t.column("id").fill_null(NO_ID).to_numpy()
        v, far = _matrix(t.column("v").combine_chunks(), dims), t.column("far").to_numpy()
        made = [(False, far.max(), None, len(v), _blob(uid, ids, v))]
        asked = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
        if len(asked):
            x, q = CoverTree(v.astype(float)), CoverTree(v[asked].astype(float))
            asked = asked[q.order]
            best = Best(len(asked), k)
            dual_search(q, x, best, ids[x.order], uid[x.order], uid[asked])
            made.append((True, far[asked].max(), int(best.score.min()), len(asked), _blob(uid[asked], ids[asked], v[asked], best.score, best.id)))
        block, cell = t.column("block")[0].as_py(), t.column("cell")[0].as_py()
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.binary())
        cols = zip(*((block, cell, int(is_query), float(r), kth, n, blob) for is_query, r, kth, n, blob in made))
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["block", "cell", "is_query", "far", "kth", "n", "blob"])

    return rows.groupBy("block").applyInArrow(index, _ROW)


_FOUND = "uid bigint, query_id bigint, score bigint, vec_id bigint"


def _rows_of(best: Best, uid: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    r, c = np.nonzero(best.fresh & (best.score > NONE))
    found = best.id[r, c]
    return pa.RecordBatch.from_arrays([pa.array(uid[r]), pa.array(ids[r]), pa.array(best.score[r, c]), pa.array(found, mask=found == NO_ID)], ["uid", "query_id", "score", "vec_id"])


def _own_best(index: DataFrame, dims: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, blob in zip(b.column(0), b.column(1)):
                uid, ids, _, score, found = _opened(blob.as_py(), n.as_py(), dims, k)
                best = Best.of(score, found)
                best.fresh[:] = True
                yield _rows_of(best, uid, ids)

    return index.filter("is_query = 1").select("n", "blob").mapInArrow(run, _FOUND)


def _searched(streams: DataFrame, dims: int, k: int) -> DataFrame:
    """The new best of each query; rows come sorted by block, the block itself before the groups of queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, uid, ids = None, None, None
        for b in batches:
            for is_query, n, blob in zip(*(b.column(c) for c in ("is_query", "n", "blob"))):
                if not is_query.as_py():
                    uid, ids, v, _, _ = _opened(blob.as_py(), n.as_py(), dims)
                    tree = CoverTree(v)
                    uid, ids = uid[tree.order], ids[tree.order]
                    continue
                quid, qids, v, score, found = _opened(blob.as_py(), n.as_py(), dims, k)
                q = CoverTree(v)
                quid, qids, best = quid[q.order], qids[q.order], Best.of(score[q.order], found[q.order])
                dual_search(q, tree, best, ids, uid, quid)
                yield _rows_of(best, quid, qids)

    return streams.mapInArrow(run, _FOUND)


def surviving_cells(pivots: np.ndarray, asked: dict[int, tuple[float, int]], held: dict[int, float]) -> list[tuple[int, list[int]]]:
    """For each cell with queries the cells not pruned; asked: radius and worst k-th score of its queries, held: radius."""
    cells = np.array(sorted(held), np.int64)
    x = Level(pivots[cells], np.sqrt((pivots[cells] ** 2).sum(axis=1)), np.array([held[c] for c in cells.tolist()]), np.zeros(0))
    out = []
    for c, (far, kth) in asked.items():
        q = Level(pivots[[c]], np.sqrt((pivots[[c]] ** 2).sum(axis=1)), np.array([far]), np.zeros(0))
        most = bounds(q, np.zeros(len(cells), np.int64), x, np.arange(len(cells)))
        out.append((c, cells[most >= kth].tolist()))
    return out


@tidy
def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of every row whose id is divisible by every.

    Components become floor(scale * x). Candidates are all rows but the query's own; if there are fewer than k, all. Null
    vectors, vectors with null or non-finite components or with components beyond 32 bits take no part. Vectors of fewer
    components count as filled up with zeros. Repeated ids are queries, and candidates of each other, by row. A null id is
    no query; as a candidate it comes after all others in ties. An empty table, or one without queries, gives no rows. Other
    columns are not read.
    """
    spark = df.sparkSession
    vecs = staged(quantised(df, id_col, vec_col, scale), "vectors")
    n, dims = vecs.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = np.zeros((min(n, SAMPLE), dims))
    for row, (v,) in zip(sample, vecs.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").collect()):
        row[: len(v)] = v
    pivots = sample[farthest_first(sample, min(CELLS, max(1, n // CELL_ROWS)))[0]]
    placed = staged(_in_cells(vecs, pivots), "cells")
    sizes = {r.cell: (r.n, r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # CELLS rows at most
    parts, first, blocks = {}, {}, 0
    for c in sorted(sizes):
        parts[c], first[c] = -(-sizes[c][0] // BLOCK), blocks
        blocks += parts[c]
    layout = F.broadcast(spark.createDataFrame([(c, parts[c], first[c]) for c in parts], "cell int, parts int, first int"))  # CELLS rows at most
    tasks = max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism))
    rows = placed.join(layout, "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("uid"), "parts")).cast("int")).drop("parts", "first")
    index = staged(_indexed(rows.repartition(tasks, "block"), dims, k, every), "index", keep=True)
    asked = {r.cell: (r.far, r.kth) for r in index.filter("is_query = 1").groupBy("cell").agg(F.max("far").alias("far"), F.min("kth").alias("kth")).collect()}  # CELLS rows at most
    found = _own_best(index, dims, k)
    if asked and blocks > 1:
        near = spark.createDataFrame(surviving_cells(pivots, asked, {c: far for c, (_, far) in sizes.items()}), "cell int, cells array<int>")
        to = F.broadcast(near).select("cell", F.explode("cells").alias("to"))  # CELLS rows of CELLS numbers at most
        place = layout.select(F.col("cell").alias("to"), "first", "parts")
        targets = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))
        sent = index.filter("is_query = 1").join(F.broadcast(to), "cell").join(place, "to").select(targets.alias("target"), "block", "is_query", "n", "blob")
        sent = sent.filter("target <> block").select(F.col("target").alias("block"), "is_query", "n", "blob")
        streams = index.filter("is_query = 0").select("block", "is_query", "n", "blob").union(sent)
        found = found.union(_searched(streams.repartition(tasks, "block").sortWithinPartitions("block", "is_query"), dims, k))
    w = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
