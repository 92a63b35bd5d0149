"""Helpers the operators share: words, hashes, tables, shared folders, broadcasts in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.staging import numbered, scratch, stored

# A cache of hashes or ids is emptied beyond so many entries.
CACHE_ENTRIES = 400_000
# Bytes of a text column that a task turns into arrays at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(df: DataFrame) -> None:
    """Delete the files of a `stored` table that nothing will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(stream, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about so many bytes in a text or binary column, one row at least."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


class WordHashes(dict):
    """64-bit hashes of words, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hashes of a list of words."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` neighbours; the order within a run counts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + hashes[k : k + len(out)])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark's long holds."""
    return x.astype(np.uint64).view(np.int64)


def released(block) -> Iterator:
    """The value of one broadcast block; the worker forgets it after use, so one block is held at a time."""
    yield block.value
    block.__dict__.pop("_value", None)


def broadcast_blocks(sc: SparkContext, values: Iterator) -> list:
    """One broadcast per value, each of a size its maker bounds; the driver holds one value at a time."""
    return [sc.broadcast(v) for v in values]
