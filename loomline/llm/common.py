"""Helpers that several operators share: Arrow chunks, word splitting, hashing of word windows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker holds as one chunk (or one row, if that is longer).
CHUNK_BYTES = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    A local session without that setting gets one in the temporary folder; on a cluster it is an error, as
    each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/loomline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory of this worker to the system: workers stay for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _find_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


_trim = _find_trim()

#: What to call to free the tables that an operator keeps in a Python worker, by its name.
_kept_by: dict[str, Callable[[], None]] = {}


def keeps(name: str, free: Callable[[], None]) -> None:
    """An operator says that its tables stay in the worker from task to task, and how to free them."""
    _kept_by[name] = free


def rebatched(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES, keeper: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``text`` each, or one row.

    Workers are used again by later stages: tables that operators other than ``keeper`` left are freed.
    """
    for name, free in _kept_by.items():
        if name != keeper:
            free()
    try:
        for batch in batches:
            yield from _slices(batch, text, limit)
    finally:
        give_back()


def _slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The texts of a column as UTF-8; a null is empty."""
    column = batch.column(name)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def str_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column; a null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str | Column) -> DataFrame:
    """Only the columns that an operator needs, under fixed names, so that others cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *more)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it comes in fewer parts than there are cores (a small file is one part); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def carried(docs: DataFrame, text_col: str) -> list[Column]:
    """All columns but the text as one struct ``rest``, for operators that hand whole rows on."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")]


def with_rest(schema: str, own: DataFrame, names: tuple[str, ...] = ("text", "rest")) -> StructType:
    """The schema with the carried columns of ``own`` behind it, if it has any."""
    fields = [own.schema[n] for n in names] if "rest" in own.columns else []
    return StructType(StructType.fromDDL(schema).fields + fields)


def add_rest(out: pa.RecordBatch, batch: pa.RecordBatch, names: tuple[str, ...] = ("text", "rest")) -> pa.RecordBatch:
    if "rest" not in batch.schema.names:
        return out
    return pa.RecordBatch.from_arrays([*out.columns, *(batch.column(n) for n in names)], names=[*out.schema.names, *names])


def whole_rows(out: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` again, of rows that an operator carried."""
    return out.select([F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


class WordHasher:
    """64-bit hashes of words, with a bounded memory of those seen."""

    def __init__(self, seed: int = 0, limit: int = 200_000) -> None:
        self.seen: dict[bytes, int] = {}
        self.seed, self.limit = seed, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen, digest, seed = self.seen, xxhash.xxh3_64_intdigest, self.seed
        if len(seen) > self.limit:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = digest(w, seed)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= _ODD
        out += hashes[i : i + n]
    return mixed(out)
