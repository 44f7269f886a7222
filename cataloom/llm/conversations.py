"""The trie of conversation prefixes, by rolling fingerprints.

Turns are range-sorted by conversation, and numpy scans number them and roll a polynomial over their hashes: the value after
d turns is the fingerprint of that prefix. A conversation may run over any number of partitions; what each partition's last
conversation has come to (a row for each partition) is carried into the next one. Prefixes of equal depth and fingerprint are
candidates for one node. Each is verified against the group's smallest member: its last turn must be equal (SHA-256 of role
and text), and so must be the group of the prefix before, which covers the turns before that. Members that fail are given
another fingerprint from that depth on, and are verified anew until none fails.

A node is named by its smallest member and depth. The nodes of one smallest member form a chain from some depth to the end of
that conversation, since the smallest member of a prefix is that of its own longer prefixes too. So the rollup adds up chains:
pointers to the parent chain are doubled until none is left, then a scan sums each chain from its end to its top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sent, staged, tidy
from .words import _power_table

#: Conversations share the head of the first one of so many; the head has fewer turns than HEAD.
BLOCK, HEAD = 20, 4
#: Bytes of a chunk of ids on their way to their node's digest.
CHUNK_BYTES = 1 << 16
_P = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]])


def _rolled(term: np.ndarray, start: np.ndarray, nth: np.ndarray, before: np.uint64) -> np.ndarray:
    """The polynomial after each term; runs begin at start, and before is carried into the first run."""
    up, down = _power_table(len(term) + int(nth.max(initial=0)) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(term * down[: len(term)], dtype=np.uint64)
        base = np.r_[np.uint64(0), sums][start]
        run = np.cumsum(np.bincount(start, minlength=len(term))) - 1
        out = (sums - base[run]) * up[: len(term)]
        first = run == 0
        out[first] += before * up[nth[first]]
    return out


class Scan:
    """Running values of rows that come sorted by key: place in the key's run, polynomial of a term, sums."""

    def __init__(self):
        self.key, self.n, self.fp, self.sums = None, 0, np.uint64(0), None

    def add(self, key: np.ndarray, term: np.ndarray | None, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]:
        start = _runs(key)
        length = np.diff(np.r_[start, len(key)])
        nth = np.arange(1, len(key) + 1) - np.repeat(start, length)
        goes_on = self.key == key[0]
        fp = None if term is None else _rolled(term, start, nth, self.fp if goes_on else np.uint64(0))
        sums = []
        for i, v in enumerate(values):
            s = np.cumsum(v)
            s -= np.repeat(np.r_[0, s][start], length)
            if goes_on:
                s[: length[0]] += self.sums[i]
            sums.append(s)
        if goes_on:
            nth[: length[0]] += self.n
        self.key, self.n, self.sums = key[-1], int(nth[-1]), [int(s[-1]) for s in sums]
        self.fp = np.uint64(0) if fp is None else fp[-1]
        return nth, fp, sums


def carries(edges: list[tuple]) -> dict[int, tuple[int, int, int, list[int]]]:
    """part: (key, n, polynomial, sums) carried into its first run; edges: part, first key, last key, last run's n, fp, sums."""
    out, state = {}, None
    for part, first, last, n, fp, sums in sorted(edges, key=lambda e: e[0]):
        carried = state if state is not None and state[0] == first else None
        if carried is not None:
            out[part] = carried
        if carried is not None and last == first:
            state = (last, carried[1] + n, (carried[2] * pow(_P, n, 1 << 64) + (fp & _ALL)) & _ALL, [a + b for a, b in zip(carried[3], sums)])
        else:
            state = (last, n, fp & _ALL, list(sums))
    return out


def scanned(df: DataFrame, key: str, order: list[Column | str], keep: list[str], term: str | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, sums as running sums, and nth (place within the key, from 1) and, with a term, fp (its polynomial).

    Rows are range-sorted by key and order, so no key needs to fit in a task.
    """
    fields = list(dict.fromkeys([key, *keep, *sums, *([term] if term else [])]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(["part int", f"{key} bigint", *(f"{k} {types[k]}" for k in keep), *(f"{k} bigint" for k in sums), "nth bigint", "fp bigint"])
    names = ["part", key, *keep, *sums, "nth", "fp"]

    def values(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column(k).to_numpy().astype(np.int64) for k in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, part = Scan(), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                nth, fp, summed = scan.add(b.column(key).to_numpy(), b.column(term).to_numpy().view(np.uint64) if term else None, values(b))
                own = [pa.array(np.full(b.num_rows, part, np.int32)), b.column(key), *(b.column(k) for k in keep), *map(pa.array, summed), pa.array(nth)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.zeros(len(nth), np.int64) if fp is None else fp.view(np.int64))], names)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, keys = b.column("part").to_numpy(), b.column(key).to_numpy()
            cols = {k: b.column(k).to_numpy(zero_copy_only=False).copy() for k in (*sums, "nth", "fp")}
            for p in np.unique(parts):
                if int(p) not in into:
                    continue
                first, n, fp, summed = into[int(p)]
                at = np.flatnonzero((parts == p) & (keys == first))
                nth = cols["nth"][at]
                if term and len(at):
                    up, _ = _power_table(int(nth.max()) + 1)
                    with np.errstate(over="ignore"):
                        cols["fp"][at] = (cols["fp"][at].view(np.uint64) + np.uint64(fp) * up[nth]).view(np.int64)
                cols["nth"][at] = nth + n
                for k, s in zip(sums, summed):
                    cols[k][at] += s
            yield pa.RecordBatch.from_arrays([pa.array(cols[k]) if k in cols else b.column(k) for k in names], names)

    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(*fields)
    made = staged(rows.mapInArrow(run, schema), "scan")
    last = F.max_by(F.struct("nth", "fp", F.array(*(F.col(k) for k in sums)).cast("array<bigint>").alias("sums")), F.struct(key, "nth"))
    edges = made.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), last.alias("x")).collect()  # a row for each partition
    into = carries([(e.part, e.first, e.last, e.x.nth, e.x.fp, e.x.sums) for e in edges])
    return (made.mapInArrow(carry, schema) if into else made).drop("part", *(() if term else ("fp",)))


def numbered_turns(df: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv, digest, term, words, nth): all turns with an id, in order; null roles and texts are empty."""
    conv, turn, role, text = (F.col(c) for c in columns)
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    d = df.filter(conv.isNotNull()).select(
        conv.cast("long").alias("conv"), turn.alias("turn"), F.left(role, F.lit(32)).alias("r"), F.left(text, F.lit(32)).alias("t"), digest.alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), F.monotonically_increasing_id().alias("copy"),
    ).withColumn("term", F.xxhash64("digest"))
    return scanned(d, "conv", [F.col("turn").asc_nulls_first(), "r", "t", "digest", "copy"], ["digest", "term", "words"])


def _head(conv: str) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEAD


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, at, nth, digest, term, words): the head of the block's first conversation (at 0), then own turns after the head (at 1)."""
    own = turns.filter(F.col("nth") > _head("conv")).select("conv", F.lit(1).alias("at"), "nth", "digest", "term", "words")
    lead = turns.filter((F.col("conv") % BLOCK == 0) & (F.col("nth") < HEAD)).withColumnRenamed("conv", "lead")
    convs = turns.select("conv").distinct().withColumn("lead", F.col("conv") - F.col("conv") % BLOCK)
    return convs.join(lead, "lead").filter(F.col("nth") <= _head("conv")).select("conv", F.lit(0).alias("at"), "nth", "digest", "term", "words").union(own)


def verified_nodes(path: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes with their tags, nodes) of path(conv, d, fp, fp0, digest, words), where no two unlike prefixes share a node.

    A node is (d, fp, tag): first (smallest member), n_convs, and its words, fp0 and tag0 (of the prefix before).
    """
    path = path.withColumn("tag", F.lit(0).cast("long")).withColumn("tag0", F.lit(0).cast("long"))
    turn = 0
    while True:
        of_first = F.min_by(F.struct("digest", "words", "fp0", "tag0"), "conv").alias("x")
        groups = staged(path.groupBy("d", "fp", "tag").agg(F.min("conv").alias("first"), F.count("*").alias("n_convs"), of_first), "groups")
        x = groups.filter("n_convs > 1").select("d", "fp", "tag", F.col("x.digest").alias("y"), F.col("x.fp0").alias("y_fp0"), F.col("x.tag0").alias("y_tag0"))
        fails = (F.col("digest") != F.col("y")) | (F.col("fp0") != F.col("y_fp0")) | (F.col("tag0") != F.col("y_tag0"))
        failed = staged(path.join(x, ["d", "fp", "tag"]).filter(fails).groupBy("conv").agg(F.min("d").alias("from")), "failed")
        if failed.isEmpty():
            return path, groups.select("d", "fp", "tag", "first", "n_convs", "x.words", "x.fp0", "x.tag0")
        turn += 1
        moved = path.join(sent(failed), "conv", "left")
        tag = lambda t, d: F.when(d >= F.col("from"), F.xxhash64(t, "from", F.lit(turn))).otherwise(F.col(t)).alias(t)
        path = staged(moved.select("conv", "d", "fp", "fp0", "digest", "words", tag("tag", F.col("d")), tag("tag0", F.col("d") - 1)), "path")


def ended_digests(ends: DataFrame) -> DataFrame:
    """(d, fp, tag, ends_sha256) of the nodes where conversations end, from ends(d, fp, tag, conv).

    Ids are joined to chunks where they are range-sorted, then each node's chunks pass a running digest.
    """
    node = ["d", "fp", "tag"]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b.column(k).to_numpy() for k in node]
            start = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if b.num_rows else np.zeros(0, np.int64)
            ids = b.column("conv").to_pylist()
            rows = []
            for a, z in zip(start.tolist(), [*start[1:].tolist(), b.num_rows]):
                for at in range(a, z, CHUNK_BYTES // 21):
                    rows.append((*(int(k[a]) for k in keys), ids[at], ",".join(map(str, ids[at : min(z, at + CHUNK_BYTES // 21)]))))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (b.schema.field("d").type, pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*node, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *now, ids in zip(*(b.column(k).to_pylist() for k in (*node, "ids"))):
                if now != key:
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), row)) for row in out])
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip((*node, "ends_sha256"), (*key, state.hexdigest())))])

    cut = ends.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(chunk, "d bigint, fp bigint, tag bigint, least bigint, ids string")
    return cut.repartition(*node).sortWithinPartitions(*node, "least").mapInArrow(digest, "d bigint, fp bigint, tag bigint, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(first, leaves, saved) of each chain with all chains below it, from chains(first, up, leaves, saved); up: parent chain."""
    while not chains.filter("up IS NOT NULL").isEmpty():
        add = chains.filter("up IS NOT NULL").groupBy(F.col("up").alias("first")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        more = chains.join(add, "first", "left").select("first", "up", *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))))
        higher = chains.select(F.col("first").alias("up"), F.col("up").alias("next"))
        chains = staged(more.join(higher, "up", "left").select("first", F.col("next").alias("up"), "leaves", "saved"), "chains")
    return chains.select("first", "leaves", "saved")


@tidy
def prefix_trie(df: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), bits: int = 64) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first: each takes its first crc32(id) % HEAD turns from the first conversation of its block.
    Turns go by number (null first); equal numbers by role, then text (32 code points of each, then digest); repeated rows are
    turns of their own. Null roles and texts are empty. Rows without a conversation id take no part. A table without
    conversations has no nodes, not even a root. Other columns are not read. bits: of the fingerprints, fewer only to test
    collisions.
    """
    turns = numbered_turns(df, columns)
    made = scanned(rebuilt(turns).withColumnRenamed("nth", "place"), "conv", ["at", "place"], ["digest", "term", "words"], "term")
    inverse = pow(_P, -1, 1 << 64)

    def with_prefix_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, term = (b.column(k).to_numpy().view(np.uint64) for k in ("fp", "term"))
            with np.errstate(over="ignore"):
                before = (fp - term) * np.uint64(inverse)
            mask = np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("nth"), *(pa.array((x & mask).view(np.int64)) for x in (fp, before)), b.column("digest"), b.column("words")], ["conv", "d", "fp", "fp0", "digest", "words"])

    path = staged(made.mapInArrow(with_prefix_before, "conv bigint, d bigint, fp bigint, fp0 bigint, digest binary, words int"), "path")
    convs = staged(turns.select("conv").distinct(), "convs")
    least, n = convs.agg(F.min("conv"), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    path, nodes = verified_nodes(path)
    root = df.sparkSession.range(1).select(*(F.lit(v).cast(t).alias(k) for k, v, t in (("d", 0, "long"), ("fp", 0, "long"), ("tag", 0, "long"), ("first", least, "long"), ("n_convs", n, "long"), ("words", 0, "int"), ("fp0", 0, "long"), ("tag0", 0, "long"))))
    nodes = nodes.union(root)
    last = path.groupBy("conv").agg(F.max_by(F.struct("d", "fp", "tag"), "d").alias("x"))
    zero = F.lit(0).cast("long")
    ends = staged(convs.join(last, "conv", "left").select(*(F.coalesce(f"x.{k}", zero).alias(k) for k in ("d", "fp", "tag")), "conv"), "ends")
    digests = ended_digests(ends)
    # the top of each chain hangs at a node of another chain
    tops = nodes.groupBy("first").agg(F.min_by(F.struct("d", "fp0", "tag0"), "d").alias("x")).filter("x.d > 0")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("fp").alias("fp0"), F.col("tag").alias("tag0"), F.col("first").alias("up"))
    tops = staged(tops.select("first", "x.*").join(above, ["d", "fp0", "tag0"]).select("first", "d", "up"), "tops")
    hung = tops.groupBy(F.col("up").alias("first"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("hung"))
    bottom = ends.select(F.col("conv").alias("first"), "d", F.lit(1).alias("bottom"))
    nodes = nodes.join(hung, ["first", "d"], "left").join(bottom, ["first", "d"], "left").join(digests, ["d", "fp", "tag"], "left")
    children = (F.coalesce("hung", zero) + F.when(F.col("bottom").isNull(), 1).otherwise(0)).cast("long")
    nodes = nodes.select("first", "d", "n_convs", children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    nodes = staged(nodes.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")), "nodes")
    chains = nodes.groupBy("first").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(tops.select("first", "up"), "first", "left")
    totals = chain_totals(staged(chains.select("first", "up", "leaves", "saved"), "chains"))
    below = tops.join(totals, "first").groupBy(F.col("up").alias("first"), (F.col("d") - 1).alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    summed = nodes.join(below, ["first", "d"], "left").join(tops, ["first", "d"], "left")
    summed = summed.withColumn("n_leaves", F.col("leaves") + F.coalesce("l", zero)).withColumn("saved_tokens", F.col("saved") + F.coalesce("s", zero))
    parent = F.coalesce("up", F.when(F.col("d") > 0, F.col("first")))
    out = summed.select("first", "d", parent.alias("parent_conv_id"), "n_convs", "n_children", "ends_sha256", "n_leaves", "saved_tokens")
    out = scanned(out, "first", [F.desc("d")], ["d", "parent_conv_id", "n_convs", "n_children", "ends_sha256"], None, ("n_leaves", "saved_tokens"))
    out = staged(out, "trie", keep=True)
    return out.select(F.col("first").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
