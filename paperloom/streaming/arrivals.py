"""Ingest and cleanup of arrivals as Structured Streaming jobs.

The file source remembers paths, so a file rewritten under its old name is not read again: the
stream form is for arrivals, re-scans use the batch run.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from paperloom.plans.ingest import ingest_documents
from paperloom.sources.store import CorpusStore

# Batch size and interval of the ingest, batch size of the cleanup.
INGEST_BATCH = 50
INGEST_INTERVAL = "10 seconds"
CLEANUP_INTERVAL = "2 seconds"


def document_arrivals(spark: SparkSession, path: str, schema: StructType,
                      files_per_batch: int = INGEST_BATCH) -> DataFrame:
    """Stream of document tables (Parquet) as they arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def file_arrivals(spark: SparkSession, path: str, glob: str, files_per_batch: int = INGEST_BATCH) -> DataFrame:
    """Stream of binary files as they arrive in a folder."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def triggered(writer: DataStreamWriter, interval: str | None) -> DataStreamWriter:
    """A time interval, or everything available now and then stop (a periodic re-run)."""
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def ingest_stream(arrivals: DataFrame, store: CorpusStore, kind: str, checkpoint: str, staging: str,
                  prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                  interval: str | None = INGEST_INTERVAL) -> StreamingQuery:
    """Compare each micro-batch with the state and add what is new or changed.

    ``prepare`` turns arriving rows into corpus rows. A micro-batch is written to the staging
    folder first, as it is read more than once. Its layer bears the query and batch number, so
    a batch repeated after a restart replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        tag = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        path = f"{staging}/{kind}-{tag}"
        prepare(batch).write.mode("overwrite").parquet(path)
        ingest_documents(store, kind, session.read.parquet(path), tag=tag)

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()


def cleanup_stream(deletions: DataFrame, store: CorpusStore, kind: str, checkpoint: str,
                   now: datetime, interval: str | None = CLEANUP_INTERVAL) -> StreamingQuery:
    """Remove documents whose ids (column ``id``) arrive; repeated deletions change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store.delete(kind, batch.select("id").distinct(), now)

    writer = deletions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return triggered(writer, interval).start()


def progress_counters(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch number, rows read) of the recent micro-batches; `ProgressLog` keeps all of them."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]


PROGRESS_SCHEMA = "query string, run string, name string, batch long, stamp string, rows long, counters string"
COUNTERS = "counters"


def counted(arrivals: DataFrame) -> DataFrame:
    """The stream with counters of what passes by, taken in the same pass: documents seen and failed."""
    failed = F.col("error").isNotNull() if "error" in arrivals.columns else F.lit(False)
    return arrivals.observe(
        COUNTERS, F.count(F.lit(1)).alias("entire_doc_count"), F.count_if(failed).alias("processing_error")
    )


class ProgressLog(StreamingQueryListener):
    """Appends one row for every micro-batch of the session's queries to a table, with their `counted` counters.

    Register it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802 - names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        found = p.observedMetrics.get(COUNTERS)
        counters = json.dumps(found.asDict()) if found else None
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, counters)
        self.spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def progress_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a `ProgressLog` has written; a batch that ran again after a restart counts once, the last time."""
    rows = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    last = rows.groupBy("query", "batch").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("query", "batch")]), "stamp").alias("r"))
    return last.select("query", "batch", "r.*")
