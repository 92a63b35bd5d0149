"""Which kinds can be searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.naming import index_name
from paperloom.plans.columns import literal_rows
from paperloom.schemas import INDEX_NAME, KIND_NAMES


def type_config(spark: SparkSession, configured: dict[str, str]) -> DataFrame:
    """Configured kinds and their index suffixes, one row per kind."""
    rows = literal_rows(spark, [(k, configured.get(k, "")) for k in KIND_NAMES], ["kind", "index_suffix"])
    return rows.withColumn("index_suffix", F.nullif("index_suffix", F.lit("")))


def type_availability(config: DataFrame, indices: DataFrame, flags: dict[str, bool],
                      main: str = INDEX_NAME) -> DataFrame:
    """Per kind: ``active`` (configured and its index exists) and ``filter`` (and asked for)."""
    wanted = [k for k in KIND_NAMES if flags.get(k, False)]
    existing = indices.select("index_name", F.lit(True).alias("_exists")).distinct()
    named = config.withColumn(
        "index_name",
        F.when(F.col("index_suffix").isNotNull(), index_name(main, F.col("index_suffix"))),
    )
    joined = named.join(existing, "index_name", "left")
    active = F.coalesce("_exists", F.lit(False))
    return joined.select(
        "kind",
        active.alias("active"),
        (active & F.col("kind").isin(*wanted)).alias("filter"),
    )
