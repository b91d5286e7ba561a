"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, outliving, scratch, shared_folder  # noqa: F401  (the operators import them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; a null text is empty.

    Ids are integers, or texts of integers; any other id ends the job.  Other columns of ``docs``, whatever their names,
    never reach the operator.  The session then sends texts to Python in smaller batches (``small_batches``).
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Whole texts go to Python in batches of few rows, which JVM and worker both hold; a session's own choice stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(rows))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(n: int) -> np.ndarray:
    """``n`` integers that hash partitioning by an int column deals to the partitions 0 .. n - 1, one each.

    The hash is Murmur3 (32 bit, seed 42) of one 4-byte word, as Spark documents it for hash partitioning.
    """
    keys, found = np.full(n, -1, np.int64), 0
    start = 0
    while found < n:
        k = np.arange(start, start + 8 * n + 64, dtype=np.uint64)
        m = np.uint64(0xFFFFFFFF)
        turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & m
        x = turn(k * np.uint64(0xCC9E2D51) & m, 15) * np.uint64(0x1B873593) & m
        h = (turn(np.uint64(42) ^ x, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & m
        h ^= np.uint64(4)
        h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & m
        h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & m
        h ^= h >> np.uint64(16)
        part = h.astype(np.uint32).astype(np.int32).astype(np.int64) % n
        target, first = np.unique(part, return_index=True)
        new = keys[target] < 0
        keys[target[new]] = k[first[new]].astype(np.int64)
        found, start = int((keys >= 0).sum()), start + len(k)
    return keys


def release_memory() -> None:
    """Give what Arrow and numpy have freed back to the system; the workers of an executor stay between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker holds no freed memory."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return inner


def fold(doc_id: int, n: int) -> int:
    """crc32 of the id as text, modulo ``n``."""
    return zlib.crc32(str(doc_id).encode()) % n


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, as views where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut consecutive items into runs of about ``limit`` bytes (a single larger item is its own run)."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            out.append((start, i))
            start, total = i, 0
        total += s
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
