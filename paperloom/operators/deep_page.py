"""Pages at any depth of a ranking, by selection instead of sorting.

A histogram of the scores tells which band of scores holds the wanted ranks and how many hits lie
above it. Only the hits of that band are sorted, dealt out by ranges of (score, id), so neither a
deep page nor many equal scores end up in one task; hits above and below the band are counted once
and never move. The total comes from the same histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.plans.staging import numbered, stored

# The histogram has at most so many rows.
BUCKETS = 4_096


def histogram(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hits with ``bucket`` (0: the best scores), and per bucket the hits in it, ``before`` it and in all."""
    ends = hits.agg(F.struct(F.max("score").alias("top"), F.min("score").alias("low")).alias("e")).scalar()
    share = F.try_divide(F.col("_e.top") - F.col("score"), F.col("_e.top") - F.col("_e.low"))
    bucket = F.coalesce(F.floor(share * (BUCKETS - 1)), F.lit(0)).cast("int")
    dealt = hits.withColumn("_e", ends).withColumn("bucket", bucket).drop("_e")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    everything, upto = Window.partitionBy(), Window.orderBy("bucket")
    table = counts.select(
        "bucket", "n", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(everything).alias("total")
    )
    return dealt, table


def deep_page(hits: DataFrame, start: int, size: int, tie: str = "id") -> DataFrame:
    """Hits of ranks ``start + 1`` to ``start + size`` with ``rank`` and ``total``; ties break on ``tie``.

    ``hits`` are (keys, score); they are written once, as they are read three times. A page
    beyond the last hit has no rows.
    """
    dealt, table = histogram(stored(hits, "hits"))
    table = stored(table, "histogram")
    band = table.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
    rows = dealt.join(F.broadcast(band.select("bucket")), "bucket", "left_semi").drop("bucket")
    above = band.agg(F.struct(F.min("before").alias("before"), F.max("total").alias("total")).alias("a")).scalar()
    placed = numbered(rows, F.desc("score"), F.asc(tie)).withColumn("_a", above)
    ranked = placed.withColumn("rank", F.col("_a.before") + F.col("pos") + 1).withColumn("total", F.col("_a.total"))
    return ranked.where((F.col("rank") > start) & (F.col("rank") <= start + size)).select(*hits.columns, "rank", "total")
