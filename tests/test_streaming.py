"""Streaming forms: equal to the batch forms, safe to restart."""

from __future__ import annotations

import json
import time
from datetime import datetime

from paths import SMALL
from office_files import write_docx
from pyspark.sql import functions as F

from paperloom.plans import driver_tables as dt
from paperloom.plans import ingest
from paperloom.sources import office
from paperloom.sources.files import plain_path
from paperloom.sources.store import CorpusStore
from paperloom.streaming import arrivals, change_state


def finish(query):
    assert query.awaitTermination(120)
    return query


def test_stream_equals_batch(spark, folder):
    docs = dt.corpus(spark, SMALL).where(F.col("doc_type") == "word")
    docs.repartition(6).write.parquet(str(folder / "in"))
    store = CorpusStore(spark, str(folder / "store"))

    def start():
        stream = arrivals.document_arrivals(spark, str(folder / "in"), docs.schema, files_per_batch=2)
        return finish(arrivals.ingest_stream(
            stream, store, "word", str(folder / "check"), str(folder / "staging"), interval=None))

    query = start()
    assert len(arrivals.progress_counters(query)) == 3
    ids = {r.id for r in store.current(["word"]).collect()}
    assert ids == {r.id for r in docs.collect()}
    layers = store.layers("word")
    start()
    assert store.layers("word") == layers

    gone = docs.select("id").limit(3)
    gone.write.parquet(str(folder / "gone"))
    deletions = arrivals.document_arrivals(spark, str(folder / "gone"), gone.schema)
    finish(arrivals.cleanup_stream(
        deletions, store, "word", str(folder / "check2"), datetime(2024, 7, 1), interval=None))
    assert store.current(["word"]).count() == len(ids) - 3


def test_every_batch_is_logged_with_its_counters(spark, folder):
    rows = spark.range(12).select(F.col("id"), F.when(F.col("id") % 4 == 0, "bad").alias("error"))
    rows.repartition(4).write.parquet(str(folder / "in"))
    listener = arrivals.ProgressLog(spark, str(folder / "log"))
    spark.streams.addListener(listener)
    try:
        stream = arrivals.document_arrivals(spark, str(folder / "in"), rows.schema, files_per_batch=1)
        finish(
            arrivals.counted(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "check"))
            .trigger(availableNow=True).start(str(folder / "out"))
        )
        for _ in range(100):
            if (folder / "log").exists() and arrivals.progress_log(spark, str(folder / "log")).count() == 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    logged = arrivals.progress_log(spark, str(folder / "log")).orderBy("batch").collect()
    assert [r.batch for r in logged] == [0, 1, 2, 3] and sum(r.rows for r in logged) == 12
    counters = [json.loads(r.counters) for r in logged]
    assert sum(c["entire_doc_count"] for c in counters) == 12 and sum(c["processing_error"] for c in counters) == 3


def test_order_within_a_micro_batch(spark, folder):
    schema = "path_hash string, content_hash string, at long"
    first = [("p", "A", 1), ("p", "B", 3), ("p", "A", 2), ("p", "A", 4), ("q", "C", 1), ("q", None, 2)]
    for part in (first, [("p", "A", 5), ("q", "D", 2), ("p", "B", 6)]):
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
        found = change_state.stateful_changes(stream, "at")
        finish(
            found.writeStream.format("parquet").option("checkpointLocation", str(folder / "check"))
            .trigger(availableNow=True).start(str(folder / "out"))
        )
    rows = [tuple(r) for r in spark.read.parquet(str(folder / "out")).collect()]
    assert sorted(rows) == sorted(
        [("p", "A", "new"), ("p", "B", "changed"), ("p", "A", "changed"), ("q", "C", "new"), ("p", "B", "changed"), ("q", "D", "changed")]
    )


def test_file_stream(spark, folder):
    for i in range(3):
        write_docx(folder / "in" / f"{i}.docx", [f"Text {i}"])
    store = CorpusStore(spark, str(folder / "store"))
    stream = arrivals.file_arrivals(spark, str(folder / "in"), "*.docx", files_per_batch=2)

    def prepare(batch):
        files = batch.withColumn("path", plain_path(F.col("path")))
        extracted = office.extract_ooxml(files, "word")
        rows = ingest.to_documents(extracted, "word", str(folder / "in"), "https://r/", datetime(2024, 7, 1))
        return ingest.readable(rows)

    finish(arrivals.ingest_stream(
        stream, store, "word", str(folder / "check"), str(folder / "staging"), prepare, interval=None))
    assert sorted(r.content.strip() for r in store.current().collect()) == ["Text 0", "Text 1", "Text 2"]


def test_stateful_changes(spark, folder):
    schema = "path_hash string, content_hash string"
    out = folder / "out"
    for content_hash in ("A", "A", "B", "A"):
        spark.createDataFrame([("p", content_hash)], schema).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
        changes = change_state.stateful_changes(stream)
        finish(
            changes.writeStream.format("parquet")
            .option("checkpointLocation", str(folder / "check"))
            .trigger(availableNow=True)
            .start(str(out))
        )
    found = spark.read.parquet(str(out)).groupBy("content_hash", "label").count()
    assert {tuple(r) for r in found.collect()} == {("A", "new", 1), ("B", "changed", 1), ("A", "changed", 1)}


def test_a_path_not_seen_for_long_is_new_again(spark, folder):
    schema, out = "path_hash string, content_hash string", folder / "out"
    for n in (1, 2):
        spark.createDataFrame([("p", "A")], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        found = change_state.stateful_changes(spark.readStream.schema(schema).parquet(str(folder / "in")), keep_ms=1)
        query = (
            found.writeStream.format("parquet").option("checkpointLocation", str(folder / "check"))
            .trigger(processingTime="1 second").start(str(out))
        )
        for _ in range(150):
            if len(list(out.glob("_spark_metadata/[0-9]*"))) and spark.read.parquet(str(out)).count() == n:
                break
            time.sleep(0.2)
        query.stop()
    assert [r.label for r in spark.read.parquet(str(out)).collect()] == ["new", "new"]
