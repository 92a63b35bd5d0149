"""Size checks that choose between a plan for small and one for large inputs."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Below this many bytes per core an input may sit in fewer row groups than there are cores.
SMALL_BYTES_PER_CORE = 32 * 1024 * 1024
# What one task of a sorting write should hold, in stored bytes.
PARTITION_BYTES = 256 * 1024 * 1024
# What the optimizer reports for a source of unknown size.
UNKNOWN_BYTES = 2**63 - 1
BROADCAST_ROW_LIMIT = 100_000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a file scan the size of the files. Runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of all sources a frame reads, or None where one is of unknown size. Runs no job.

    Sizes of sources add up; the optimizer's own estimate of a join is a product, which says nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= UNKNOWN_BYTES for s in sizes) else sum(sizes)


def partitions_of(size: int | None, configured: int, of_input: int, task_bytes: int = PARTITION_BYTES) -> int:
    """Partitions by size, at least the configured number; those of the input where the size is unknown."""
    return max(configured, of_input if size is None else ceil(size / task_bytes))


def partitions_for(df: DataFrame, task_bytes: int = PARTITION_BYTES) -> int:
    """Partitions for a shuffle of the whole frame, in proportion to what its sources hold."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = source_bytes(df)
    return partitions_of(size, configured, df.rdd.getNumPartitions() if size is None else 0, task_bytes)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Deal a small input out to all cores by a unique key; leave a large one as it is.

    A file of one row group is read by one task however many cores there are, which starves
    the CPU-bound text work. Large inputs have more splits than cores and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < cores * SMALL_BYTES_PER_CORE:
        return df.repartition(cores, key)
    return df


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> tuple[DataFrame, bool]:
    """Mark a side for broadcast when counting it, up to the limit, shows that it is small.

    Returns the frame and whether it was marked; the caller has another way for a large side.
    """
    small = df.limit(row_limit + 1).count() <= row_limit
    return (F.broadcast(df), True) if small else (df, False)


def for_hash_join(df: DataFrame) -> DataFrame:
    """A side of narrow rows for a join with a much larger one: broadcast if small, else hashed after the shuffle.

    In both cases the larger side is not sorted, so it does not spill.
    """
    marked, small = broadcast_if_small(df)
    return marked if small else df.hint("shuffle_hash")
