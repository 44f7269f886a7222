r"""Words of many texts as 64-bit hashes, without a Python object for each word.

A word's hash is a polynomial in its lower-cased (A-Z) bytes with random byte values, taken from running sums over the
joined texts, so the cost is a few numpy passes over the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES[65:91] = _VALUES[97:123]
_VALUES[_SPACE] = 0
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 256
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(x & (2**64 - 1)))]) for x in (_P, pow(_P, -1, 1 << 64)))
        _powers = up, down
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words in order: hash, row of the batch, line of all lines of the chunk, place in the bytes; first_line: of each row."""

    rows: range
    hash: np.ndarray
    row: np.ndarray
    line: np.ndarray
    first_line: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def hashed(texts: list[bytes], rows: range) -> Words:
    """The words of some texts; row numbers come from rows."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(data)
    up, down = _power_table(n + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_VALUES[data] * up[:n], dtype=np.uint64)
        space = _SPACE[data]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        ends = np.flatnonzero(space & ~np.r_[True, space[:-1]])
        before = np.where(starts > 0, sums[np.maximum(starts - 1, 0)], np.uint64(0))
        h = mix((sums[ends - 1] - before) * down[starts])
    breaks = np.cumsum(data == 10, dtype=np.int32)
    line = breaks[starts].astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offset = np.cumsum(size) - size
    first = np.where(offset > 0, breaks[np.maximum(offset - 1, 0)], 0).astype(np.int64)
    row_of_line = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, breaks[-1]]))
    return Words(rows, h, row_of_line[line] + rows.start, line, first, data, starts, ends)


def blocked(texts: list[bytes], rows: range) -> Words:
    """The words of some texts with other hashes than hashed gives, of eight bytes at a time: half the time for short words."""
    data = np.frombuffer(b"\n%b\n%b" % (b"\n".join(texts), bytes(8)), np.uint8)
    own = data[:-8]
    space = (own == 32) | (own - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends by turns
    start, end = edge[::2], edge[1::2]
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    eight = np.ndarray(len(own) + 1, "<u8", low, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = mix((eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_P))
        more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(more):
            h[more] = mix(h[more] * np.uint64(_P) + (eight[start[more] + done] & _LOW_BYTES[np.minimum(size[more] - done, 8)]))
            done += 8
            more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8).digest(), "little")
    breaks = np.flatnonzero(own == 10)
    line = np.repeat(np.arange(len(breaks) - 1), np.diff(np.searchsorted(start, breaks)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(breaks, np.cumsum(sizes) - sizes)
    row_of_line = np.repeat(np.arange(len(texts)), np.diff(np.r_[first, len(breaks) - 1]))
    return Words(rows, h, row_of_line[line] + rows.start, line, first, own, start, end)


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, hashed=hashed) -> Iterator[Words]:
    """The words of all texts of a batch, texts of about chunk_bytes at a time; nulls have none. A text is never divided."""
    held, at, size = [], 0, 0
    texts = column.cast(pa.binary())
    for i, t in enumerate(texts):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= chunk_bytes:
            yield hashed(held, range(at, i + 1))
            held, at, size = [], i + 1, 0
    if held:
        yield hashed(held, range(at, at + len(held)))
