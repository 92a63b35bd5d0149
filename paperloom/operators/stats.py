"""Index, activity and job statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.naming import index_name
from paperloom.schemas import INDEX_NAME, RUN_SCHEMA

TOTAL = "total"
# States of a job; a job nobody reported on is undefined.
JOB_STATES = ("Running", "Stopped", "Undefined")
UNDEFINED = "Undefined"
# What the statistics of an index count.
OPERATIONS = ("fetch", "query", "suggest")


def index_statistics(corpus: DataFrame, main: str = INDEX_NAME) -> DataFrame:
    """Documents and content bytes per index."""
    return corpus.groupBy(index_name(main, F.col("doc_type")).alias("index_name")).agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.sum(F.octet_length("content")).cast("double").alias("size_in_bytes"),
    )


def index_statistics_total(corpus: DataFrame, main: str = INDEX_NAME) -> DataFrame:
    """As `index_statistics` plus a row of totals, from one rollup."""
    sizes = corpus.select(
        index_name(main, F.col("doc_type")).alias("name"), F.octet_length("content").alias("bytes")
    )
    return sizes.rollup("name").agg(
        F.grouping("name").alias("_g"),
        F.count(F.lit(1)).alias("doc_count"),
        F.sum("bytes").cast("double").alias("size_in_bytes"),
    ).select(
        F.when(F.col("_g") == 1, TOTAL).otherwise(F.col("name")).alias("index_name"),
        "doc_count",
        "size_in_bytes",
    )


def activity_counters(log: DataFrame, operation: str, millis: Column) -> DataFrame:
    """How often each operation ran and how long altogether."""
    return log.groupBy(F.col(operation).alias("operation")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(millis).cast("long").alias("time_ms")
    )


def index_activity(corpus: DataFrame, log: DataFrame, main: str = INDEX_NAME) -> DataFrame:
    """Every existing index with its size and what was done with it; zero where nothing was.

    ``log`` has (doc_type, operation, millis), one row per call; other operations are left out.
    Both sides are one row per kind when they meet.
    """
    done = F.col("operation")
    calls = [F.count_if(done == o).alias(f"{o}_total") for o in OPERATIONS]
    times = [F.sum(F.when(done == o, F.col("millis"))).alias(f"{o}_time_ms") for o in OPERATIONS]
    per_kind = log.groupBy(index_name(main, F.col("doc_type")).alias("index_name")).agg(*calls, *times)
    joined = index_statistics(corpus, main).join(per_kind, "index_name", "left")
    counters = [f"{o}_{what}" for o in OPERATIONS for what in ("time_ms", "total")]
    return joined.select(
        "index_name", "doc_count", "size_in_bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters]
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The run of every model that ended last (the larger id among equals)."""
    columns = [c for c in runs.columns if c != "model"]
    order = F.struct("end_job", "id")
    latest = runs.groupBy("model").agg(F.max_by(F.struct(*columns), order).alias("run"))
    return latest.select("model", "run.*")


def runtime_statistics(processors: DataFrame, latest: DataFrame, states: DataFrame) -> DataFrame:
    """Processors (model, short_name) that have a latest run and a job state.

    One row per model on every side; the optimizer sees that they fit a broadcast.
    """
    return processors.join(latest, "model").join(states, "model").select(
        "short_name", *[f for f in RUN_SCHEMA.fieldNames()], "job_state"
    )


def job_state_report(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Every job with its state, undefined where nothing is known."""
    return jobs.join(states, "model", "left").select(
        "group_name", "model", F.coalesce("job_state", F.lit(UNDEFINED)).alias("job_state")
    )


def tagged_union(processing: DataFrame, cleanup: DataFrame) -> DataFrame:
    """Processing and cleanup runs in one frame, tagged with their group."""
    return processing.withColumn("group_name", F.lit("processing")).unionByName(
        cleanup.withColumn("group_name", F.lit("cleanup"))
    )


def vocabulary_size(terms: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct terms of rows (doc_type, term) per kind; the estimate shuffles only sketches."""
    if approximate:
        return terms.groupBy("doc_type").agg(F.approx_count_distinct("term").alias("terms"))
    return terms.distinct().groupBy("doc_type").agg(F.count(F.lit(1)).alias("terms"))
