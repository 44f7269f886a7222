r"""Language-model scores: prediction by partial matching over a byte trie of the corpus.

A text is scored as its UTF-8 bytes followed by one end symbol; contexts are the up to ORDER preceding bytes, whatever they
are, and the first byte follows a start edge. A seen symbol has (c - DISCOUNT) / n at a context of total n; the rest of the
mass is the escape, which goes to the next shorter context with the seen symbols excluded. Shorter contexts count by update
exclusion: a symbol counts once for each longer context that it was seen in. The probabilities of each context sum to one.

Texts are cut into blocks of about BLOCK_BYTES. A block sends each of its distinct codes (context and byte) once, with its
training count, to the part of the trie that owns the last KEY context bytes: contexts of KEY or more bytes back off inside
their part. All nodes are kept, and parts become more as the corpus grows; only the nodes of contexts shorter than KEY,
fewer than 256 ** KEY, are broadcast. Log-probabilities return to the blocks in the order in which codes were sent. Words of
the base score take the same way, told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type, held_out, staged, tidy
from .words import blocked, mix

ORDER = 7
#: Taken from every count for the escape.
DISCOUNT = 0.3
BLOCK_BYTES = 16 << 20
#: Log-probabilities return to the blocks in whole multiples of one in so many.
UNIT = 1 << 12
#: Positions of a block that are coded at once.
SLICE = 1 << 20
#: Positions whose codes are sorted at once, a multiple of SLICE.
RUN = 4 << 20
#: Bytes before each text in the padded array, as many as the longest context has.
PAD = 7
#: The context bytes that decide which part of the trie owns a code.
KEY = 3
#: Parts of the trie: at least so many, and one for each so many blocks.
LEAST_PARTS, BLOCKS_A_PART = 64, 1
#: Stands before a text.
EDGE = 0x20
#: Stands after a text; no UTF-8 text holds it.
END = 0xFF
FLOOR = 1.0 / 257
#: Of the compression of texts.
LEVEL = 7


def word_codes(words: list[bytes], order: int, end: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every word or text and its terminator: the (order + 1)-byte code of context and byte, and its number.

    A context holds the start edge and bytes; positions before that are zero.
    """
    data = Padded(words, end)
    made = [(data.codes(a, order), data.texts(a)) for a in range(0, len(data.bytes), SLICE)]
    return tuple(map(np.concatenate, zip(*made)))


class Padded:
    """Texts in one array, each after zeros and its edge, so that no context reaches into the text before."""

    def __init__(self, texts: list[bytes], end: int):
        head, tail = bytes(PAD - 1) + bytes([EDGE]), bytes([end])
        self.bytes = np.frombuffer(b"".join(x for t in texts for x in (head, t, tail)), np.uint8)
        size = np.fromiter((len(t) + PAD + 1 for t in texts), np.int64, len(texts))
        self.start = np.cumsum(size) - size
        self.own = np.ones(len(self.bytes), bool)
        for j in range(PAD):
            self.own[self.start + j] = False

    def codes(self, a: int, order: int) -> np.ndarray:
        """Codes of the positions from a that belong to texts, SLICE positions at most."""
        a, z = max(a, PAD), min(len(self.bytes), a + SLICE)
        if z <= a:
            return np.zeros(0, np.uint64)
        eight = np.ndarray(z - a, ">u8", self.bytes, a - PAD, (1,))  # each byte with the PAD bytes before it
        return (eight.astype(np.uint64) & _mask(order))[self.own[a:z]]

    def run(self, a: int, order: int) -> np.ndarray:
        """Codes of the positions from a that belong to texts, RUN positions at most."""
        z = min(len(self.bytes), a + RUN)
        code, n = np.empty(int(np.count_nonzero(self.own[a:z])), np.uint64), 0
        for b in range(a, z, SLICE):
            c = self.codes(b, order)
            code[n : n + len(c)] = c
            n += len(c)
        return code

    def texts(self, a: int) -> np.ndarray:
        """Text numbers of the same positions."""
        z = min(len(self.bytes), a + SLICE)
        first, last = np.searchsorted(self.start, [a, z - 1], "right") - 1
        edge = np.r_[a, self.start[first + 1 : last + 1], z]
        return np.repeat(np.arange(first, last + 1), np.diff(edge))[self.own[a:z]]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; the array given is sorted and overwritten, so that no second one is held."""
    values.sort()
    n, before, counts = 0, -1, []
    for a in range(0, len(values), SLICE):
        z = min(len(values), a + SLICE)
        last = np.ones(z - a, bool)
        last[: len(values) - 1 - a] = values[a:z][: len(values) - 1 - a] != values[a + 1 : z + 1]
        at = a + np.flatnonzero(last)
        values[n : n + len(at)] = values[at]
        counts.append(np.diff(at, prepend=before).astype(np.uint32))
        n, before = n + len(at), at[-1] if len(at) else before
    return values[:n].copy(), np.concatenate(counts) if counts else np.zeros(0, np.uint32)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and for each element the number of its value."""
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first], np.cumsum(first) - 1


class Places:
    """Where values stand in an array of distinct ones that holds them all: by hash, and where that place is taken in the next."""

    def __init__(self, own: np.ndarray):
        slots = max(2, 2 * len(own), min(4 * len(own), 1 << 24))
        self.own, self.bits = own, (slots - 1).bit_length()
        self.table = np.full(1 << self.bits, -1, np.int32)
        for a in range(0, len(own), SLICE):
            slot = self._slot(own[a : a + SLICE])
            todo = np.arange(a, a + len(slot), dtype=np.int32)
            while len(todo):
                free = np.take(self.table, slot, mode="clip") < 0
                self.table[slot[free]] = todo[free]
                left = np.take(self.table, slot, mode="clip") != todo
                todo, slot = todo[left], self._next(slot[left])

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (mix(values) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << self.bits) - 1

    def of(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0, np.int32)
        slot = self._slot(values)
        out = np.take(self.table, slot, mode="clip")
        todo = np.flatnonzero((out < 0) | (np.take(self.own, out, mode="clip") != values))
        slot, values = slot[todo], values[todo]
        while len(todo):
            if (out[todo] < 0).any():
                raise KeyError("a value that the array doesn't hold")
            slot = self._next(slot)
            out[todo] = at = np.take(self.table, slot, mode="clip")
            left = (at < 0) | (np.take(self.own, at, mode="clip") != values)
            todo, slot, values = todo[left], slot[left], values[left]
        return out


def _summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(code, return_inverse=True)
    return u, np.bincount(inverse, count, len(u)).astype(np.int64)


def _merged(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and summed counts of runs of sorted distinct values; each run goes into the longer ones before it."""
    code, count = made[-1]
    for other in made[-2::-1]:
        (u, c), (v, d) = ((code, count), other) if len(code) > len(other[0]) else (other, (code, count))
        if not len(v):
            code, count = u, c
            continue
        at = np.searchsorted(u, v)
        hit = u[np.minimum(at, len(u) - 1)] == v
        c[at[hit]] += d[hit]
        new = ~hit
        at, v, d = at[new], v[new], d[new]
        code, count = np.insert(u, at, v), np.insert(c, at, d)
    return code, count


class Trie:
    """Probabilities of nodes and the escape weights of their contexts, by order."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """nodes: for each order from 0, sorted codes, counts, and the total n of each code's context."""
        self.codes: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        for k, (code, count, n) in enumerate(nodes):
            p = (count - DISCOUNT) / n
            low = 10.0 ** self.log10(code & _mask(k - 1) if k else code, k - 1)
            ctx, inverse = _runs(code >> np.uint64(8))
            seen, excluded = np.bincount(inverse, p, len(ctx)), np.bincount(inverse, low, len(ctx))
            self.codes.append(code)
            self.logp.append(np.log10(p).astype(np.float32))
            self.contexts.append(ctx)
            self.escape.append(np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - excluded, 1e-9)).astype(np.float32))

    def log10(self, code: np.ndarray, order: int) -> np.ndarray:
        """log10 of the probability of the last byte of each code after the order bytes before it."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(order, -1, -1):
            if not len(todo):
                return out
            c = code[todo] & _mask(k)
            codes, contexts = self.codes[k], self.contexts[k]
            if not len(codes):
                continue
            i = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            hit = codes[i] == c
            out[todo[hit]] += self.logp[k][i[hit]]
            todo, c = todo[~hit], c[~hit] >> np.uint64(8)
            j = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            known = contexts[j] == c
            out[todo[known]] += self.escape[k][j[known]]
        out[todo] += np.log10(FLOOR)
        return out


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (8 * (k + 1))) - 1)


def _nodes(code: np.ndarray, count: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, counts and context totals of the orders from least to order, of sorted codes and their counts."""
    made = []
    for k in range(order, least - 1, -1):
        _, inverse = _runs(code >> np.uint64(8))
        made.append((code, count, np.bincount(inverse, count)[inverse].astype(np.int64) if len(code) else count))
        if k:
            code, count = _counted(code & _mask(k - 1))
    return made[::-1]


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n, "<u8"), dtype=np.uint64)


def _blocks(src: DataFrame, order: int) -> DataFrame:
    """A row for each block of texts, those to learn from first; short: the distinct codes of KEY context bytes in these."""
    schema = f"block bigint, ids array<{field_type(src, 'id')}>, train int, sizes binary, size bigint, texts binary, short binary, n_short int"

    def made(block: int, ids: pa.Array, held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        turn = np.argsort(held, kind="stable")
        train = len(held) - sum(held)
        texts = [texts[i] for i in turn]
        data = Padded(texts[:train], END)
        short = [_counted(data.codes(a, KEY))[0] for a in range(0, len(data.bytes), SLICE)]
        short = _counted(np.concatenate(short))[0] if short else np.zeros(0, np.uint64)
        whole = b"".join(texts)
        own = pa.ListArray.from_arrays(pa.array([0, len(turn)], pa.int32()), ids.take(pa.array(turn)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        values = [
            pa.array([block]), own, pa.array([train], pa.int32()), pa.array([sizes.tobytes()], pa.binary()), pa.array([len(whole)], pa.int64()),
            pa.array([pa.Codec("zstd", compression_level=LEVEL).compress(whole, asbytes=True)], pa.binary()), pa.array([_pack_sorted(short)], pa.binary()), pa.array([len(short)], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(values, ["block", "ids", "train", "sizes", "size", "texts", "short", "n_short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, held, texts, size = [], [], [], 0
        for b in batches:
            a = 0
            for i, (h, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()))):
                held.append(bool(h))
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield made(block, pa.concat_arrays([*ids, b.column(0).slice(a, i + 1 - a)]), held, texts)
                    ids, held, texts, size, a, block = [], [], [], 0, i + 1, block + 1
            ids.append(b.column(0).slice(a))
        if texts:
            yield made(block, pa.concat_arrays(ids), held, texts)

    return src.mapInArrow(run, schema)


def _texts(data: bytes, size: int, sizes: bytes) -> list[bytes]:
    whole = pa.decompress(data, size, "zstd", asbytes=True) if size else b""
    end = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [whole[a:z] for a, z in zip([0, *end], end)]


def _word_slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and the numbers of their texts, some texts at a time."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            w = blocked(texts[a : i + 1], range(a, i + 1))
            yield w.hash, w.row
            a, size = i + 1, 0


def _code_runs(texts: list[bytes], order: int) -> Iterator[np.ndarray]:
    data = Padded(texts, END)
    for a in range(0, len(data.bytes), RUN):
        yield data.run(a, order)


def _distinct(made: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; arrays are merged in rounds, so that few are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for values in made:
        held.append(_counted(values))
        del values  # else it is held while others are merged
        while len(held) > 1 and len(held[-1][0]) * 2 > len(held[-2][0]):
            held[-2:] = [_merged(held[-2:])]
    return _merged(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def _vocabulary(texts: list[bytes], train: int, order: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes (kind 0) or words (kind 1) of a block, sorted, with their training counts."""
    (u, c), (v, _) = (_distinct((h for h, _ in _word_slices(part)) if kind else _code_runs(part, order)) for part in (texts[:train], texts[train:]))
    return _merged([(u, c), (v, np.zeros(len(v), np.uint32))])


def _dealt(codes: np.ndarray, kind: int, parts: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which values are sent, and where the values of each part begin and end."""
    part = np.empty(len(codes), np.uint16 if parts <= 1 << 16 else np.uint32)
    for a in range(0, len(codes), SLICE):  # the arrays over all codes stay few and narrow
        key = codes[a : a + SLICE]
        if kind == 0:
            key = key >> np.uint64(8) & np.uint64((1 << 8 * min(order, KEY)) - 1)
        part[a : a + SLICE] = mix(key) % np.uint64(parts)
    return np.argsort(part, kind="stable"), np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]


def _low_nodes(blocks: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes of the orders below KEY: how many distinct longer contexts each was seen in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, n in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_unpack_sorted(data.as_py(), n.as_py()).view(np.int64))], ["code"])

    short = blocks.select("short", "n_short").mapInArrow(run, "code bigint").distinct()
    t = short.groupBy(F.col("code").bitwiseAND((1 << 8 * KEY) - 1).alias("code")).agg(F.count("*").alias("c")).orderBy("code").toArrow()
    return _nodes(t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy(), KEY - 1, 0)


@tidy
def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, order: int = ORDER) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    base_score: words (lower-cased A-Z) and one end by their counts. score: the bytes of the text, as they are, and one end.
    held: column that is true for rows not learnt from; by default crc32 of the id mod 10 = 0. Null and empty texts are one
    end; repeated rows are learnt and scored each time; null ids are texts of their own; without training rows every
    count is 0 and the trie empty. order: from KEY to 7. Other columns are not read.
    """
    if not KEY <= order <= 7:
        raise ValueError(f"order {order} is not between {KEY} and 7")
    spark = df.sparkSession
    held = held_out(id_col, 10, 0) if held is None else held
    src = df.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = staged(_blocks(src, order), "blocks", keep=True)
    n_blocks, ends = blocks.agg(F.count("*"), F.coalesce(F.sum("train"), F.lit(0))).first()
    parts = max(LEAST_PARTS, -(-n_blocks // BLOCKS_A_PART))
    low = spark.sparkContext.broadcast(_low_nodes(blocks, order))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, train, sizes, size, data in zip(*(b.column(i) for i in range(5))):
                texts = _texts(data.as_py(), size.as_py(), sizes.as_py())
                cols: list[pa.Array] = [pa.array(np.arange(parts)), pa.array(np.full(parts, block.as_py()))]
                for kind in (0, 1):
                    u, c = _vocabulary(texts, train.as_py(), order, kind)
                    turn, edge = _dealt(u, kind, parts, order)
                    own = [turn[a:z] for a, z in zip(edge[:-1], edge[1:])]
                    cols += [pa.array(np.diff(edge)), pa.array([_pack_sorted(u[o]) for o in own], pa.binary()), pa.array([_pack(c[o]) for o in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "n", "codes", "counts", "m", "words", "times"])

    def judge(t: pa.Table) -> pa.Table:
        found = []
        for n, values, counts in (("n", "codes", "counts"), ("m", "words", "times")):
            size = t.column(n).to_numpy()
            sent = np.concatenate([_unpack_sorted(x.as_py(), k) for x, k in zip(t.column(values), size)])
            u, inverse = np.unique(sent, return_inverse=True)
            c = np.bincount(inverse, np.concatenate([_unpack(x.as_py(), k, "<u4") for x, k in zip(t.column(counts), size)]), len(u)).astype(np.int64)
            edge = np.r_[0, np.cumsum(size)]
            if n == "n":
                seen = c > 0
                result = Trie(low.value + _nodes(u[seen], c[seen], order, KEY)).log10(u, order)
                result = np.rint(result * -UNIT).astype("<i4")
            else:
                total, distinct = int(c.sum()), int((c > 0).sum())
                result = c.astype("<i8")
            found.append([_pack(result[inverse[a:z]]) for a, z in zip(edge[:-1], edge[1:])])
        rows = t.num_rows
        cols = [t.column("block").combine_chunks(), t.column("part").combine_chunks(), *(pa.array(x, pa.binary()) for x in found), pa.array([total] * rows, pa.int64()), pa.array([distinct] * rows, pa.int64())]
        return pa.Table.from_arrays(cols, ["block", "part", "lp", "c", "total", "distinct"])

    sent = blocks.select("block", "train", "sizes", "size", "texts").mapInArrow(send, "part bigint, block bigint, n bigint, codes binary, counts binary, m bigint, words binary, times binary")
    judged = sent.groupBy("part").applyInArrow(judge, "block bigint, part bigint, lp binary, c binary, total bigint, distinct bigint")
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: left.column(k)[0] for k in left.column_names}
        train, n = row["train"].as_py(), len(row["ids"])
        texts = _texts(row["texts"].as_py(), row["size"].as_py(), row["sizes"].as_py())
        right = right.sort_by("part")
        del left

        def known(kind: int) -> tuple[Places, np.ndarray]:
            name, dtype = (("lp", "<i4"), ("c", "<i8"))[kind]
            u = _vocabulary(texts, train, order, kind)[0]
            turn, edge = _dealt(u, kind, parts, order)
            value = np.zeros(len(u), dtype)
            value[turn] = np.concatenate([_unpack(x.as_py(), k, dtype) for x, k in zip(right.column(name), np.diff(edge))])
            return Places(u), value

        total = sum(right.column("total").to_pylist()) + ends
        distinct = sum(right.column("distinct").to_pylist()) + (ends > 0)
        base, n_tokens, n_known = np.full(n, np.log10(ends + 0.1)), np.ones(n, np.int64), np.full(n, int(ends > 0))
        places, count = known(1)
        for h, which in _word_slices(texts):
            c = count[places.of(h)]
            base += np.bincount(which, np.log10(c + 0.1), n)
            n_tokens += np.bincount(which, minlength=n)
            n_known += np.bincount(which[c > 0], minlength=n)
        base -= n_tokens * np.log10(total + 0.1 * (distinct + 1))
        places, lp = known(0)
        sc, data = np.zeros(n), Padded(texts, END)
        for a in range(0, len(data.bytes), SLICE):
            sc += np.bincount(data.texts(a), lp[places.of(data.codes(a, order))] / -UNIT, n)
        held_col = pa.array(np.arange(n) >= train)
        made = [pa.array(n_tokens), pa.array(n_known), pa.array(np.full(n, total)), pa.array(base), pa.array(sc)]
        return pa.Table.from_arrays([row["ids"].values, held_col, *made], names)

    out = f"`{id_col}` {field_type(df, id_col)}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = blocks.drop("short", "n_short")
    return texts.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(finish, out)
