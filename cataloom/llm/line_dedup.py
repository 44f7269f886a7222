r"""Line de-duplication as an exact set-similarity join over lines.

A line is the set of its words. The words of a line are ordered by rarity, and two lines of similarity >= 0.8 share one of
their first few words (prefix filter); pairs must also agree in length and have enough words left after the shared one
(length and positional filters). Surviving pairs are verified by exact Jaccard. A line is removed if an earlier line is
that similar, whether or not the earlier one was itself removed.

Rarity is a count of word hashes in a table of SKETCH counters, filled from all texts. Any fixed order keeps the prefix
filter exact, so counters shared by several words cost only time. A second such table counts the postings of each prefix
word: a word with one posting can't meet another line, and words of very many are dealt out in chunks. Lines also carry 96
parity bits of their words: the bits in which two lines differ never outnumber the words they don't share (bitmap filter).
Lines of more than LONG words carry 128 bits more, those of more than VERY_LONG words 512.
Lines with equal sets of words need no comparison: 64-bit hashes of their words agree in sum, in sum of squares and in number. A posting names the prefix word
before it: two lines that share that one too have met there already. A word shared by thousands of like lines makes no
square of pairs: each line is first verified against its earliest candidate for each word; only lines that none of these
matches meet all their other candidates, by the postings of their own words.
Postings travel as packed arrays, a row for each map task and bucket; the prefix and the parity bits of a line as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, field_type, pack, release, sent, staged, tidy, unpack
from .words import Words, blocked, chunks, mix

#: Counters of the rarity table, one byte each: the broadcast has 4 MB, whatever the corpus.
SKETCH = 1 << 22
PIECES = 256
#: The least similarity, PART / WHOLE.
PART, WHOLE = 4, 5
THRESHOLD = PART / WHOLE
#: Sets of so many words reach THRESHOLD only when equal, which their hash tells; they need no postings.
ONLY_EQUAL = 3
#: Lines of more words carry longer parity bits: two unlike lines of n words differ in half the bits, and 2n/9 are allowed.
LONG, VERY_LONG = 96, 160
#: Lines that may share a word and be compared in one task; words that more may share are dealt out as pairs of chunks.
CHUNK = 4096
#: Postings of a bucket, about; lines whose postings are packed together.
BUCKET, PACKED_LINES = 1 << 17, 1 << 15
#: Bytes of a prefix word, and of the parity bits that all lines carry.
WORD, BITS = 5, 12
#: Groups of up to so many lines are compared together, larger ones by themselves.
SMALL_GROUP = 256
#: Texts are hashed so many bytes at a time, few enough that the arrays stay in the processor's cache.
HASHED_BYTES = 1 << 17
EPS = 1e-9


def _level(count: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: exact to 16, then in eighths of a doubling."""
    c = np.maximum(count, 1)
    return np.where(c <= 16, count, np.minimum(255, 16 + 8 * np.log2(c / 16))).astype(np.uint8)


def _most(level: np.ndarray) -> np.ndarray:
    """What a count of a level over 16 doesn't exceed."""
    return 16 * 2.0 ** ((level - 15) / 8)


def _copies(level: np.ndarray) -> np.ndarray:
    """Chunks of the lines that share a word of a level; each line is sent once for each chunk."""
    return np.where(level <= 16, 1, np.ceil(_most(level) / CHUNK)).astype(np.int64)


def _counted(df: DataFrame, hashes) -> np.ndarray:
    """Levels of the counts of 64-bit hashes by hash mod SKETCH; hashes(batch) makes arrays of them."""
    width = SKETCH // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.uint32)
        for b in batches:
            for h in hashes(b):
                np.add.at(total, (h & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        for i in range(PIECES):
            own = total[i * width : (i + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([own[at].astype("<u4").tobytes()], pa.binary())], ["piece", "at", "many"])
        pa.default_memory_pool().release_unused()

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for at, many in zip(t.column("at"), t.column("many")):
            total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(many.as_py(), "<u4")
        return pa.table({"piece": t.column("piece")[:1], "level": pa.array([_level(total).tobytes()])})

    made = df.mapInArrow(run, "piece int, at binary, many binary")
    out = np.zeros(SKETCH, np.uint8)
    for piece, level in made.groupBy("piece").applyInArrow(add, "piece int, level binary").collect():
        out[piece * width : (piece + 1) * width] = np.frombuffer(bytes(level), np.uint8)
    return out


def rarity(df: DataFrame, text_col: str) -> np.ndarray:
    """Levels of the counts of all words of all texts."""
    return _counted(df.select(F.col(text_col).cast("string")), lambda b: (w.hash for w in chunks(b.column(0), HASHED_BYTES, blocked)))


def postings(sets: DataFrame) -> np.ndarray:
    """Levels of the counts of all prefix words, by word mod SKETCH."""
    return _counted(sets.select("prefix"), lambda b: [_words(_binary(b.column(0))[1])])


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column without nulls, from its first row's bytes on."""
    a = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offset = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return offset - offset[0], np.frombuffer(a.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]


def _from_bytes(offset: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _words(data: np.ndarray) -> np.ndarray:
    """Prefix words from their bytes."""
    out = np.zeros((len(data) // WORD, 8), np.uint8)
    out[:, :WORD] = data.reshape(-1, WORD)
    return out.view("<u8").reshape(-1)


def line_sets(w: Words, level: np.ndarray, min_words: int) -> dict[str, np.ndarray]:
    """The lines of enough words of a chunk: row, line, n, sid and alt (sums of the words' hashes and of their squares), sig (parity bits), and their prefix words."""
    h, line = w.hash, w.line
    if min_words > 1 and len(h):
        long = np.bincount(line)[line] >= min_words
        h, line = h[long], line[long]
    if not len(h):
        return {}
    at = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    lines, edge = line[at], np.r_[at, len(line)]
    rank = level[(h & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
    parts = []
    for a in range(0, len(lines), 65536):  # line, rarity and word share one sort key
        z = min(len(lines), a + 65536)
        own = slice(edge[a], edge[z])
        k = np.repeat(np.arange(z - a, dtype=np.uint64) << np.uint64(48), np.diff(edge[a : z + 1])) | rank[own]
        o = np.argsort(k)
        k, x = k[o], h[own][o]
        new = np.r_[True, k[1:] != k[:-1]]
        if (x[1:] != x[:-1])[~new[1:]].any():  # words that agree in the bits of the key
            x = x[np.lexsort((x, k))]
            new[1:] |= x[1:] != x[:-1]
        parts.append(((k[new] >> np.uint64(48)).astype(np.int64) + a, x[new]))
    which, h = (np.concatenate(x) for x in zip(*parts))
    n = np.bincount(which, minlength=len(lines))
    start = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        sid, alt = np.add.reduceat(h, start), np.add.reduceat(h * h, start)
    place = (h >> np.uint64(40)) % np.uint64(96)
    low, bit = place < 64, np.uint64(1) << (place & np.uint64(63))
    sig, sig2 = (np.bitwise_xor.reduceat(np.where(own, bit, np.uint64(0)), start) for own in (low, ~low))
    width, more = long_bits(h, which, n)
    size = _prefix_size(n)
    use = np.arange(len(h)) - start[which] < size[which]
    row = np.searchsorted(w.first_line, lines, "right") - 1
    return {"row": row + w.rows.start, "line": lines - w.first_line[row], "n": n, "sid": sid, "alt": alt, "sig": sig, "sig2": sig2, "width": width, "more": more, "size": size, "word": h[use] >> np.uint64(24)}


def _prefix_size(n: np.ndarray) -> np.ndarray:
    return n - np.ceil(THRESHOLD * n - EPS).astype(np.int64) + 1


def _width(n: np.ndarray) -> np.ndarray:
    """Bytes of the longer parity bits of lines of n words."""
    return np.where(n > VERY_LONG, 64, np.where(n > LONG, 16, 0))


def _parity_bytes(x: dict[str, np.ndarray]) -> pa.Array:
    """The parity bits of lines: BITS bytes of sig and sig2, then the longer ones."""
    offset = np.r_[0, np.cumsum(BITS + x["width"])]
    out, rest = np.empty(offset[-1], np.uint8), np.ones(offset[-1], bool)
    at = offset[:-1, None] + np.arange(BITS)
    out[at] = np.concatenate([x["sig"].astype("<u8").view(np.uint8).reshape(-1, 8), x["sig2"].astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    rest[at] = False
    out[rest] = x["more"]
    return _from_bytes(offset, out)


def _parities(n: np.ndarray, offset: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """sig, sig2, width, fold and full of lines of n words whose parity bits begin at offset of data."""
    both = np.ascontiguousarray(data[offset[:, None] + np.arange(BITS)])
    width = _width(n)
    own = {"sig": np.ascontiguousarray(both[:, :8]).view("<u8").reshape(-1), "sig2": np.ascontiguousarray(both[:, 8:]).view("<u4").reshape(-1), "width": width}
    return own | long_parities(data, offset + BITS, width)


def long_bits(h: np.ndarray, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each line, all bytes): 512 parity bits of very long lines, folded to 128 for long ones, none for others."""
    width = _width(n)
    own = n > LONG
    if not own.any():
        return width, np.zeros(0, np.uint8)
    m = h[own[which]]
    place, start = (m >> np.uint64(16)) & np.uint64(511), np.cumsum(n[own]) - n[own]
    bit = np.uint64(1) << (place & np.uint64(63))
    full = np.stack([np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, bit, np.uint64(0)), start) for k in range(8)], axis=1)
    folded = n[own] <= VERY_LONG
    full[folded, :2] = _fold(full[folded])
    keep = np.ones(full.shape, bool)
    keep[folded, 2:] = False
    return width, full[keep].view(np.uint8)


def _fold(full: np.ndarray) -> np.ndarray:
    """128 parity bits from 512."""
    return np.bitwise_xor.reduce(full.reshape(-1, 4, 2), axis=1)


def long_parities(data: np.ndarray, offset: np.ndarray, width: np.ndarray) -> dict[str, np.ndarray]:
    """fold (128 bits) and full (512 bits) of lines whose width bytes (0, 16 or 64) begin at offset of data."""
    fold, full = np.zeros((len(width), 2), np.uint64), np.zeros((len(width), 8 if (width == 64).any() else 0), np.uint64)
    for size in (16, 64):
        at = np.flatnonzero(width == size)
        if len(at):
            got = np.ascontiguousarray(data[offset[at][:, None] + np.arange(size)]).view(np.uint64)
            fold[at] = got if size == 16 else _fold(got)
            if size == 64:
                full[at] = got
    return {"fold": fold, "full": full}


def _line_rows(src: DataFrame, level, min_words: int) -> DataFrame:
    """A row for each line of enough words: sid, alt, id, h, line, n, bits and prefix (40 bits of its words' hashes, from the rarest)."""
    schema = f"sid bigint, alt bigint, id {field_type(src, 'id')}, h bigint, line int, n int, bits binary, prefix binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in chunks(b.column(2), HASHED_BYTES, blocked):
                x = line_sets(w, level.value, min_words)
                if x:
                    at = pa.array(x["row"])
                    prefix = _from_bytes(np.r_[0, np.cumsum(WORD * x["size"])], x["word"].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD])
                    cols = [*(pa.array(x[k].view(np.int64)) for k in ("sid", "alt")), b.column(0).take(at), b.column(1).take(at), *(pa.array(x[k].astype(np.int32)) for k in ("line", "n")), _parity_bytes(x), prefix]
                    yield pa.RecordBatch.from_arrays(cols, ["sid", "alt", "id", "h", "line", "n", "bits", "prefix"])

    return src.mapInArrow(run, schema)


def _passes(i: np.ndarray, j: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs of the lines i and j pass the length, positional and bitmap filters, are two lines and didn't meet at the word before: positions."""
    n, place, prev, sid = x["n"], x["place"], x["prev"], x["sid"]
    a, b = n[i], n[j]
    at = np.flatnonzero(WHOLE * np.minimum(a, b) >= PART * np.maximum(a, b))
    i, j = i[at], j[at]
    total = a[at] + b[at]
    need = -(-PART * total // (PART + WHOLE))
    spare = total - 2 * need
    good = np.flatnonzero(np.bitwise_count(x["sig"][i] ^ x["sig"][j]).astype(np.int64) + np.bitwise_count(x["sig2"][i] ^ x["sig2"][j]) <= spare)
    at, i, j, need, spare = at[good], i[good], j[good], need[good], spare[good]
    p, q = place[i], place[j]
    good = np.minimum(n[i] - p, n[j] - q) + np.minimum(p, q) >= need
    good &= ((prev[i] != prev[j]) | (p == 0) | (q == 0)) & (sid[i] != sid[j])
    for size, bits in ((16, "fold"), (64, "full")):
        own = np.flatnonzero(good & (x["width"][i] >= size) & (x["width"][j] >= size))
        if len(own):
            good[own] = np.bitwise_count(x[bits][i[own]] ^ x[bits][j[own]]).sum(axis=1, dtype=np.int64) <= spare[own]
    return at[good]


def candidates(x: dict[str, np.ndarray], group: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each line i the earliest j before it in its group that passes the filters; with every, all such j for the lines in x["open"] alone.

    group: ascending group numbers; within a group lines stand in corpus order. They are compared by length, as far as lengths agree.
    """
    best, found = np.full(len(group), len(group)), [np.zeros((2, 0), np.int64)]

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.maximum(i, j), np.minimum(i, j)
        if every:
            own = np.flatnonzero(x["open"][i])
            i, j = i[own], j[own]
        at = _passes(i, j, x)
        if every:
            found.append(np.stack([i[at], j[at]]))
        else:
            np.minimum.at(best, i[at], j[at])

    size = np.bincount(group)
    by_n = np.argsort(group << 32 | x["n"]) if len(group) else group
    n, start = x["n"][by_n], np.repeat(np.cumsum(size) - size, size)
    small = size[group] <= SMALL_GROUP
    at, k = np.flatnonzero(small), 1
    while len(at):  # all small groups at once: each line with the k-th shorter one
        at = at[at - k >= start[at]]
        at = at[WHOLE * n[at - k] >= PART * n[at]]
        for a in range(0, len(at), 1 << 15):
            meet(by_n[at[a : a + (1 << 15)]], by_n[at[a : a + (1 << 15)] - k])
        k += 1
    for a in np.unique(start[~small]):
        z = a + size[group[a]]
        low = np.maximum(a, a + np.searchsorted(WHOLE * n[a:z], PART * n[a:z]))
        for i in range(a, z, 64):
            own = np.arange(i, min(z, i + 64))
            other = own - low[own - a]
            meet(by_n[np.repeat(own, other)], by_n[np.arange(int(other.sum())) - np.repeat(np.cumsum(other) - other, other) + np.repeat(low[own - a], other)])
    if every:
        return tuple(np.concatenate(found, axis=1))
    i = np.flatnonzero(best < len(group))
    return i, best[i]


#: The arrays of a bundle of postings, in order.
FIELDS = (("key", "<u8"), ("prev", "<u8"), ("line", "<i4"), ("sid", "<u8"), ("n", "<i4"), ("place", "<i4"), ("open", "u1"))


def _bundles(t: pa.Table, level: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The postings of some lines, a row for each bucket: a key is a word, or for very frequent ones a pair of its chunks."""
    offset, data = _binary(t.column("prefix"))
    word, size = _words(data), np.diff(offset) // WORD
    who = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    prev = np.where(place > 0, np.roll(word, 1), np.uint64(0))
    lev = level[(word & np.uint64(SKETCH - 1)).astype(np.int64)]
    use = np.flatnonzero(lev > 1)
    who, place, prev, key, m = who[use], place[use], prev[use], word[use], _copies(lev[use].astype(np.int64))
    sid = t.column("sid").to_numpy().view(np.uint64)
    if (m > 1).any():
        c = (mix(sid)[who] % m.astype(np.uint64)).astype(np.int64)
        chunk = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        at = np.repeat(np.arange(len(who)), m)
        low, high = np.minimum(c[at], chunk).astype(np.uint64), np.maximum(c[at], chunk).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = np.where(m[at] > 1, mix(key[at] * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(1 << 32) + high), key[at])
        who, place, prev = who[at], place[at], prev[at]
    bucket = mix(key) % np.uint64(buckets)
    o = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    key, line, bucket = key[o], who[o], bucket[o].astype(np.int64)
    own = {k: t.column(k).to_numpy()[line] for k in ("line", "n", "open")}
    values = {**own, "key": key, "prev": prev[o], "sid": sid[line], "place": place[o]}
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    ids = t.column("id").combine_chunks().take(pa.array(line))
    offset, bits = _binary(t.column("bits").combine_chunks().cast(pa.binary()).take(pa.array(line)))
    values = {k: values[k].astype(kind) for k, kind in FIELDS}
    blobs = [pack([values[k][a:z] for k, _ in FIELDS]) for a, z in zip(edge[:-1], edge[1:])]
    lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), ids)
    arrays = [pa.array(bucket[edge[:-1]]), lists, pa.array(blobs, pa.binary()), _from_bytes(offset[edge], bits)]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "ids", "blob", "bits"])


def _opened(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The postings of a bucket that share their key, in order of key and corpus order, and their group numbers."""
    sizes = [len(x) for x in t.column("ids")]
    parts = [unpack(b.as_py(), n, [k for _, k in FIELDS]) for b, n in zip(t.column("blob"), sizes)]
    x = {k: np.concatenate([p[i] for p in parts]) for i, (k, _) in enumerate(FIELDS)}
    x["n"], x["place"] = x["n"].astype(np.int64), x["place"].astype(np.int64)
    offset, bits = np.cumsum(BITS + _width(x["n"])), _binary(t.column("bits"))[1]
    x["bits"] = np.r_[0, offset[:-1]] if len(offset) else offset
    o = np.argsort(x["key"])
    key = x["key"][o]
    same = np.r_[False, key[1:] == key[:-1]]
    o = o[same | np.r_[same[1:], False]]
    key = x["key"][o]
    if not len(key):
        return x, np.zeros(0, np.int64)
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    coded = pa.concat_arrays([c.flatten() for c in t.column("ids").chunks]).take(pa.array(o)).dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, np.int64)
    rank[0] = 0  # null ids come first
    rank[1 + pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
    order = rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1] << 32 | x["line"][o]
    o = o[np.lexsort((x["sid"][o].view(np.int64), order, group))]
    x = {k: v[o] for k, v in x.items()}
    return x | _parities(x["n"], x.pop("bits"), bits), group


def _candidates(sets: DataFrame, levels: np.ndarray, every: bool = False) -> DataFrame:
    """(sid, other): for each line and prefix word the earliest candidate; with every, all candidates of the lines that are open. Words of level 0 or 1 are left out."""
    spark = sets.sparkSession
    many = np.where(levels <= 16, levels, _most(levels.astype(np.int64)))
    buckets = max(16, -(-int((many * _copies(levels.astype(np.int64)))[levels > 1].sum()) // BUCKET))
    level = spark.sparkContext.broadcast(levels)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED_LINES:
                yield _bundles(pa.Table.from_batches(held), level.value, buckets)
                held, n = [], 0
        if n:
            yield _bundles(pa.Table.from_batches(held), level.value, buckets)
        pa.default_memory_pool().release_unused()

    def meet(t: pa.Table) -> pa.Table:
        x, group = _opened(t)
        i, j = candidates(x, group, every)
        pairs = np.unique(np.stack([x["sid"][i], x["sid"][j]], axis=1).view(np.int64), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.table({"sid": pairs[:, 0], "other": pairs[:, 1]})

    met = sets.select("id", "line", "sid", "n", "bits", "prefix", "open").mapInArrow(send, f"bucket bigint, ids array<{field_type(sets, 'id')}>, blob binary, bits binary")
    out = staged(met.groupBy("bucket").applyInArrow(meet, "sid bigint, other bigint").distinct(), "met")
    level.destroy()
    del met
    release(spark)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs(sid, other) whose lines' word sets have similarity >= THRESHOLD, compared as texts."""
    wanted = staged(pairs.select(F.explode(F.array("sid", "other")).alias("sid")).distinct(), "wanted")
    where = staged(sets.join(sent(wanted), "sid", "left_semi").select("sid", "id", "h", "line"), "where")
    rows = where.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("line", "sid")).alias("at"))
    d = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    split = d.join(sent(staged(rows, "where")), d.id.eqNullSafe(F.col("wid")) & (d.h == F.col("wh"))).select("at", F.split("text", "\n", -1).alias("lines"))
    found = split.select(F.inline(F.transform("at", lambda a: F.struct(a["sid"].alias("sid"), F.get("lines", a["line"]).alias("line")))))
    texts = staged(found.dropDuplicates(["sid"]), "texts")
    both = pairs.join(texts.withColumnRenamed("line", "x"), "sid").join(texts.select(F.col("sid").alias("other"), F.col("line").alias("y")), "other")

    def similar(x: bytes, y: bytes) -> bool:
        p, q = set(x.lower().split()), set(y.lower().split())
        shared = len(p & q)
        return shared * WHOLE >= PART * (len(p) + len(q) - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(k).cast(pa.binary()) for k in ("x", "y"))
            yield b.select(["sid", "other"]).filter(pa.array([similar(p.as_py(), q.as_py()) for p, q in zip(x, y)], pa.bool_()))

    return both.select("sid", "other", "x", "y").mapInArrow(run, "sid bigint, other bigint")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """(id, h, lines): the line numbers to remove from the rows of that id and text hash."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    level = spark.sparkContext.broadcast(rarity(df, text_col))
    lines = staged(_line_rows(src, level, min_words), "lines")
    level.destroy()
    where = F.struct(F.col("id").isNotNull().alias("some"), "id", "line", "h")
    payload = F.first(F.struct("n", "bits", "prefix")).alias("p")
    unlike = ((F.min("alt") != F.max("alt")) | (F.min("n") != F.max("n"))).alias("unlike")
    grouped = lambda x: staged(x.groupBy("sid").agg(F.min(where).alias("first"), payload, unlike).select("sid", "first.*", "p.*", "unlike"), "sets")
    sets = grouped(lines)
    mixed = sets.filter("unlike").select("sid", "unlike")
    if not mixed.isEmpty():  # sets of one sum that are not the same set
        lines = staged(lines.join(sent(staged(mixed, "mixed")), "sid", "left").withColumn("sid", F.when(F.col("unlike"), F.xxhash64("sid", "alt", "n")).otherwise(F.col("sid"))).drop("unlike"), "lines")
        sets = grouped(lines)
    wide, lines = lines, staged(lines.select("sid", "id", "h", "line"), "narrow")
    discard(wide)
    own = sets.filter(F.col("n") > ONLY_EQUAL)
    levels = postings(own)
    pairs = _candidates(own.withColumn("open", F.lit(0).cast("tinyint")), levels)
    gone = staged(_verified(pairs, sets, df, id_col, text_col).select("sid").distinct(), "matched")
    undecided = staged(pairs.join(gone, "sid", "left_anti").select("sid").distinct(), "undecided")
    if not undecided.isEmpty():  # their earliest candidate failed; meet all others
        opened = staged(own.join(sent(undecided), "sid", "left_semi").select("sid", F.lit(1).cast("tinyint").alias("open"), "prefix"), "open")
        marked = own.join(sent(staged(opened.select("sid", "open"), "open")), "sid", "left").fillna(0, "open")
        more = _candidates(marked, np.where(postings(opened) > 0, levels, 0).astype(np.uint8), every=True)
        gone = staged(gone.union(_verified(more, sets, df, id_col, text_col).select("sid")).distinct(), "matched")
    judged = lines.select("sid", "id", "h", "line").join(sets.select("sid", F.struct("some", F.col("id").alias("id"), "line", "h").alias("first")), "sid").join(gone.withColumn("gone", F.lit(True)), "sid", "left")
    return judged.filter(F.col("gone").isNotNull() | (where > F.col("first"))).groupBy("id", "h").agg(F.collect_set("line").alias("lines"))


@tidy
def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """df with repeated lines cut from the texts, and n_lines and n_removed (columns of df by these names are replaced).

    Lines are cut at line feeds; words are lower-cased (A-Z) and split at ASCII white space; lines of fewer than min_words
    words, or of none, stay. Earlier means smaller id (null first), then line number, then a hash of the set of words, and for equal sets the text hash. Rows equal in id and text get
    equal results; a null text stays null with 0 lines; a text may become empty. All other columns pass through.
    """
    gone = sent(staged(repeated_lines(df, id_col, text_col, min_words), "gone", keep=True)).withColumnsRenamed({"id": "__cataloom_id", "h": "__cataloom_h", "lines": "__cataloom_lines"})
    d = df.withColumn("__cataloom_key", F.xxhash64(text_col)).drop("n_lines", "n_removed")
    j = d.join(gone, d[id_col].eqNullSafe(gone["__cataloom_id"]) & (d["__cataloom_key"] == gone["__cataloom_h"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    cut = F.coalesce(F.col("__cataloom_lines"), F.array().cast("array<int>"))
    kept = F.filter(lines, lambda x, i: ~F.array_contains(cut, i))
    size = lambda text: F.length(text.cast("binary"))
    breaks = size(F.col(text_col).cast("string")) - size(F.replace(F.col(text_col).cast("string"), F.lit("\n")))
    out = j.withColumn("n_lines", F.coalesce(F.when(F.length(text_col) == 0, 0).otherwise(breaks + 1), F.lit(0)).cast("long")).withColumn("n_removed", F.size(cut).cast("long"))
    out = out.withColumn(text_col, F.when(F.size(cut) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    return out.drop("__cataloom_key", "__cataloom_id", "__cataloom_h", "__cataloom_lines")
