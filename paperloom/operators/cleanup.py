"""Reconciliation of state and corpus with the files that still exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(state: DataFrame, listing: DataFrame) -> DataFrame:
    """State rows whose path hash is not in the current listing."""
    return state.join(listing.select("path_hash"), "path_hash", "left_anti")


def without_orphans(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select("path_hash"), "path_hash", "left_anti")


def cleanup_counters(state: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: state rows seen and rows removed, in one join."""
    listed = listing.select("path_hash", F.lit(True).alias("_listed")).dropDuplicates(["path_hash"])
    joined = state.select("path_hash").join(listed, "path_hash", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("all_files"),
        F.count_if(F.col("_listed").isNull()).alias("removed_files"),
    )
