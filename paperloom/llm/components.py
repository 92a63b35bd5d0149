"""Connected components of a table of links, in rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); the component is its smallest node.

    Large-star and small-star steps (Kiveris and others 2014): each node's neighbours are tied to the smallest among
    them until nothing changes. Minima are aggregated before the shuffle; the number of links never grows.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod("v", F.lit(1 << 40))), F.sum(F.pmod("u", F.lit(1 << 40)))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(down.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
