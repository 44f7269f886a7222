"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: For each tidy operator that runs now, the folders it has staged and whether they stay.
_open: list[list[tuple[str, bool]]] = []
#: Largest staged table that is sent to all executors; beyond it tables are joined by a shuffle.
SEND_BYTES = 32 << 20
#: Text of a piece of a batch: what tasks make of texts at once, and what they return in one batch.
PIECE_BYTES = 1 << 20

#: ASCII white space of the word definition `[^\x20\x09-\x0D]+`; bytes.split() uses the same set.
SPACES = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode, where that is unset, one of our own."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors.

    Inside an operator marked tidy the folder goes when that returns, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-2 if keep and len(_open) > 1 else -1].append((path, keep and len(_open) == 1))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def staged_bytes(df: DataFrame) -> int:
    """Bytes on disk of a staged table."""
    p, fs = _path(df.sparkSession, df.inputFiles()[0].rpartition("/")[0]) if df.inputFiles() else (None, None)
    return int(fs.getContentSummary(p).getLength()) if p else 0


def sent(small: DataFrame) -> DataFrame:
    """A staged table, marked for sending to all executors if it has at most SEND_BYTES."""
    return F.broadcast(small) if staged_bytes(small) <= SEND_BYTES else small


def release(spark: SparkSession) -> None:
    """Shuffle files and broadcasts that nothing refers to any more are deleted now, not when the driver next lacks memory."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes a staged table that is read no more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p, fs = _path(df.sparkSession, folder)
        fs.delete(p, True)
    release(df.sparkSession)


def tidy(operator):
    """An operator (its first argument a DataFrame) whose staged tables are deleted when it returns, but those to be kept."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        _open.append([])
        try:
            return operator(df, *args, **kwargs)
        finally:
            spark = df.sparkSession
            for path, keep in _open.pop():
                if not keep:
                    p, fs = _path(spark, path)
                    fs.delete(p, True)
            release(spark)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field_type(df: DataFrame, name: str) -> str:
    """The DDL type of a column, for output schemas that carry it through."""
    return df.schema[name].dataType.simpleString()


def word_bytes(text: str | None) -> list[bytes]:
    r"""The lower-cased (A-Z only) words of a text as UTF-8; bytes.split() cuts at exactly `\x20\x09-\x0D`."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def held_out(id_col: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    """Join condition on keys where null equals null."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return pa.compress(b"".join(planes), "zstd", asbytes=True) if len(arrays[0]) else b""


def unpack(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.zeros(0, k) for k in kinds]
    planes = np.frombuffer(pa.decompress(data, n * sum(sizes), "zstd", asbytes=True), np.uint8).reshape(-1, n)
    cut = np.cumsum([0, *sizes])
    return [np.ascontiguousarray(planes[a:z].T).reshape(-1).view(k) for k, a, z in zip(kinds, cut[:-1], cut[1:])]


def whole_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows, sorted by their first n_keys columns, in tables that never divide a run of equal keys."""
    held: list[pa.Table] = []

    def last_run(t: pa.Table) -> int:
        keys = [t.column(i).to_numpy() for i in range(n_keys)]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        return int(cut[-1]) + 1 if len(cut) else 0

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        same = bool(held) and all(held[0].column(i)[0] == t.column(i)[0] for i in range(n_keys))
        at = last_run(t)
        if same and not at:
            held.append(t)
            continue
        yield pa.concat_tables([*held, t.slice(0, at)]).combine_chunks() if at else pa.concat_tables(held).combine_chunks() if held else t.slice(0, 0)
        held = [t.slice(at)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def pieces(b: pa.RecordBatch, column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about size bytes of a string or binary column; all rows in order, none divided."""
    n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(n, dtype=np.int64) // size
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, b.num_rows]
    for a, z in zip(edges[:-1], edges[1:]):
        if z > a:
            yield b.slice(a, z - a)


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal first n_keys columns, from rows sorted by them."""
    for t in whole_groups(batches, n_keys):
        if not t.num_rows:
            continue
        keys = [t.column(i).to_numpy() for i in range(n_keys)]
        edges = np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1, t.num_rows]
        for i in np.flatnonzero(np.diff(edges) > 1):
            yield t.slice(edges[i], edges[i + 1] - edges[i])
