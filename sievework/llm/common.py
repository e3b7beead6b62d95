"""Shared pieces: word hashing over Arrow buffers, scratch tables, checked broadcasts.

A *word* is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters in the
lower-cased UTF-8 text; everything else separates. Words are handled as mixed 64-bit hashes that
are computed for a whole Arrow slice at once, so no Python code runs per word or per document.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORDY = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORDY[_a:_b] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser; bijective on 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pow(n: int) -> tuple[np.ndarray, ...]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Buffer:
    """UTF-8 bytes of consecutive documents; at[i]:at[i+1] is document i."""

    data: np.ndarray
    at: np.ndarray

    def sums(self) -> np.ndarray:
        """Prefix sums from which span_hash() takes the hash of any byte span in O(1)."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _pow(len(self.data))[0], out=out[1:])
        return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _pow(len(sums))[1][start])


def buffer_of(column: pa.Array, lower: bool = True) -> Buffer:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    if not len(column):
        return Buffer(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return Buffer(raw, at - at[0])


@dataclass
class Words:
    """Words of a slice of documents: lo[i]:lo[i+1] are those of document i."""

    lo: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.lo)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo) - 1), self.count)


def words_of(buf: Buffer, hashes: bool = True) -> Words:
    n = len(buf.data)
    wordy = _WORDY[buf.data]
    first = wordy.copy()
    first[1:] &= ~wordy[:-1]
    begins = buf.at[:-1][buf.at[:-1] < n]
    first[begins] = wordy[begins]
    last = wordy.copy()
    last[:-1] &= ~wordy[1:]
    final = buf.at[1:][buf.at[1:] > 0] - 1
    last[final] = wordy[final]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    lo = np.searchsorted(start, buf.at)
    return Words(lo, start, end, span_hash(buf.sums(), start, end) if hashes else np.zeros(0, np.uint64))


def grams(w: Words, k: int) -> tuple[np.ndarray, ...]:
    """(hashes, lo) of all runs of k words; a document of fewer words has none."""
    count = np.maximum(w.count - k + 1, 0)
    lo = np.concatenate([[0], np.cumsum(count)])
    if not lo[-1]:
        return np.zeros(0, np.uint64), lo
    n = len(w.hash) - k + 1
    g = w.hash[:n].copy()
    for j in range(1, k):
        g *= U64(0xD6E8FEB86659FD93)
        g += w.hash[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, k):  # a run that begins j words before a later document crosses into it
        cross = w.lo[1:] - j
        inside[cross[(cross >= 0) & (cross < n)]] = False
    return mix(g[inside]), lo


_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory that is free back to the system: Python workers stay for the next task, several to an executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def each_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they are; memory is released after the last."""
    yield from batches
    release()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about limit bytes of text, or one longer document."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right"))
            j = max(j, i + 1)
            yield batch.slice(i, j - i)
            i = j
        del batch, size
    release()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return col(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def lists(values: np.ndarray, lo: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(lo.astype(np.int32)), pa.array(values, kind))


# scratch tables


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary folder is set for a
    session on one machine (tests), and anything else is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Written tables that cut lineage. Those of table() go at the end of the with block, those of
    result() when the session's file system is closed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        """While the tables are written, a batch that goes to Python holds about BATCH_BYTES, whatever the length of the texts."""
        self.before = self.spark.conf.get(_BATCH, None)
        self.spark.conf.set(_BATCH, str(BATCH_BYTES))
        return self

    def _write(self, df: DataFrame, *partition: str) -> tuple[DataFrame, object]:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def table(self, df: DataFrame, *partition: str) -> DataFrame:
        out, path = self._write(df, *partition)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame) -> DataFrame:
        out, path = self._write(df)
        self._fs(path).deleteOnExit(path)
        return out

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(_BATCH)
        else:
            self.spark.conf.set(_BATCH, self.before)
        for path in self.paths:
            self._fs(path).delete(path, True)


BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def free_name(df: DataFrame, base: str) -> str:
    """base, with as many underscores as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, with a broadcast hint if its files hold at most most bytes and limit rows; else df, which is
    then joined by a shuffle."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(size) <= most and (df.count() if rows is None else rows) <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
