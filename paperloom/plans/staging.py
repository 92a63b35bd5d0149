"""Tables written once to the folder that driver and executors share, and places in an order."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.plans.sizing import partitions_for
from paperloom.session import shared_folder, shuffles_dropped

# monotonically_increasing_id holds the task's number above so many bits.
TASK_BITS = 33


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with ``part`` and ``pos``: their place from 0 in an order.

    Rows are dealt out by ranges of that order, so that no task sees more than its range; a task
    numbers its own rows and a table of one row per task says where each begins. Written once: the
    places stay if an executor is lost.
    """
    placed = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("part", F.shiftright("_at", TASK_BITS))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = F.broadcast(sizes.select("part", before.alias("_start")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return placed.join(starts, "part").withColumn("pos", F.col("_start") + inside).drop("_at", "_start")
