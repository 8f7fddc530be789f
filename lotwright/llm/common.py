"""Helpers that the operators of this subpackage share: shared folders, byte views of Arrow text, and hashing.

Tables are read by path with Spark's own readers, so any file system that Spark knows will do. Whatever
has to outlive an executor goes below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles at once; a longer single text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one is set first, but only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders of the scratch blocks that are open, innermost last.
_SCRATCH: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_SCRATCH[-1] if _SCRATCH else shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to a folder of its own, which is deleted at the end; results must be written elsewhere by then."""
    own = shared_path(spark, "scratch")
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        discard(spark, own)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage and survives executors."""
    path = path or shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions: for groups of few bytes and much work, which adaptive execution would merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df, whatever its columns are called, and the columns of ddl."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs to its end inside; the session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidied(work: Callable) -> Callable:
    """``work``, a function for mapInArrow, that gives memory back when its task ends: the worker lives on, for tasks of other stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return run


def crc_bucket(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % modulus


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 2))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text or binary column end to end, and len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    else:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(0x5851F42D4C957F2D, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS[:n]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: np.ndarray):
    """Words of texts that lie end to end: runs of bytes that ``inside`` marks, never across two texts.

    Returns the 64-bit hash, start and end of each word, and len + 1 offsets of the texts into them.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    data = data[begin:end]
    cuts = offsets - begin
    mask = inside[data]
    first = np.empty(len(mask), bool)
    if len(mask):
        first[0] = mask[0]
        first[1:] = mask[1:] & ~mask[:-1]
        at = cuts[:-1][cuts[:-1] < len(mask)]
        first[at] = mask[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    positions = np.flatnonzero(mask)
    at = np.searchsorted(positions, starts)
    lengths = np.diff(np.append(at, len(positions)))
    ends = starts + lengths
    within = np.arange(len(positions)) - np.repeat(at, lengths)
    hashed = np.add.reduceat((lower[data[positions]].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[within], at)
    return mix(hashed ^ (lengths.astype(np.uint64) << np.uint64(48))), starts + begin, ends + begin, np.searchsorted(starts, cuts)


#: Bytes after A-Z became a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
