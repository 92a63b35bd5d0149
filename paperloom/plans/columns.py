"""Plan helpers about where and how often an expression is evaluated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add costly columns so that later filters on them do not evaluate them again.

    The optimizer copies an expression into every filter above its projection. It does not
    look through the output of a generator, so the columns travel as a one-row array.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline_outer(packed))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A few literal rows as a frame that the JVM makes by itself, without a Python data source."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    if not structs:
        raise ValueError("literal_rows needs at least one row")
    return spark.range(1).select(F.inline(F.array(*structs)))
