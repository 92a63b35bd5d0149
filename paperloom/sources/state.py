"""The saved state of earlier runs, as text lines and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.schemas import STATE_SCHEMA
from paperloom.sources.folders import committed_subfolders, subfolders

# Fixed value: the separator of state lines.
STATE_SEPARATOR = ";"


def parse_state_lines(lines: DataFrame) -> DataFrame:
    """State rows of lines ``content_hash;path_hash;path`` in column ``value``.

    Lines without exactly three parts are dropped.
    """
    parts = lines.select(F.split("value", STATE_SEPARATOR).alias("_p")).where(F.size("_p") == 3)
    return parts.select(
        F.col("_p")[1].alias("path_hash"),
        F.col("_p")[0].alias("content_hash"),
        F.col("_p")[2].alias("original_path"),
    )


def read_state_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_state_lines(spark.read.text(path))


def write_state_text(state: DataFrame, path: str) -> None:
    line = F.concat_ws(STATE_SEPARATOR, "content_hash", "path_hash", "original_path")
    state.select(line.alias("value")).write.mode("overwrite").text(path)


def write_state(state: DataFrame, path: str) -> None:
    """Write the whole state as a new version; readers switch once it is complete."""
    names = subfolders(state.sparkSession, path)
    number = max((int(n.split("=")[1]) for n in names), default=0) + 1
    rows = state.select(*STATE_SCHEMA.fieldNames())
    rows.write.partitionBy("doc_type").parquet(f"{path}/version={number:06d}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; an empty state where there is none."""
    names = committed_subfolders(spark, path)
    if not names:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path}/{names[-1]}").select(*STATE_SCHEMA.fieldNames())
