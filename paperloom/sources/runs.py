"""Run statistics as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.plans.columns import computed_once
from paperloom.schemas import RUN_SCHEMA

# Fixed value: the text form of times in run statistics and comments.
JSON_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def runs_to_json(runs: DataFrame) -> DataFrame:
    """One JSON text per run in column ``json``, with the model beside it if there is one."""
    names = [n for n in RUN_SCHEMA.fieldNames() if n in runs.columns]
    keep = [c for c in ("model",) if c in runs.columns]
    return runs.select(*keep, F.to_json(F.struct(*names), JSON_OPTIONS).alias("json"))


def runs_from_json(lines: DataFrame, column: str = "json") -> DataFrame:
    """Runs of JSON texts; empty and unreadable texts give no row."""
    keep = [c for c in lines.columns if c != column]
    parsed = computed_once(lines, keep, _r=F.from_json(column, RUN_SCHEMA, JSON_OPTIONS))
    return parsed.where(F.col("_r.id").isNotNull()).select(*keep, "_r.*")


def comment_to_json(text: Column, author: Column, date: Column, cid: Column, initials: Column) -> Column:
    """A comment as JSON text with absent members left out."""
    members = F.struct(
        text.alias("commentText"), author.alias("author"), date.alias("date"), cid.alias("id"),
        initials.alias("initials"),
    )
    return F.to_json(members, {"timestampFormat": JSON_TIME_FORMAT})


def write_run(runs: DataFrame, path: str) -> None:
    """Append runs; nothing is overwritten, the latest run is a query."""
    runs_to_json(runs).write.mode("append").partitionBy("model").text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs_from_json(spark.read.text(path).withColumnRenamed("value", "json"))
