"""The layered corpus table."""

from __future__ import annotations

from datetime import datetime

from paperloom.operators import corpus as corpus_ops
from paperloom.plans import driver_tables as dt
from paperloom.plans.ingest import ingest_documents
from paperloom.sources import state
from paperloom.sources.store import CorpusStore
from paths import SMALL
from pyspark.sql import functions as F


def rows(spark, *pairs, at="2024-01-01"):
    data = [(i, h, f"/p/{i}", datetime.fromisoformat(at)) for i, h in pairs]
    return spark.createDataFrame(data, "id string, content_hash string, original_file_path string, process_time timestamp")


def content(store):
    return {r.id: r.content_hash for r in store.current(["word"]).collect()}


def test_layers(spark, folder):
    store = CorpusStore(spark, str(folder))
    assert store.existing() == [] and store.current().count() == 0
    store.append("word", rows(spark, ("a", "1"), ("b", "1")))
    store.append("word", rows(spark, ("b", "2"), ("c", "1")))
    assert content(store) == {"a": "1", "b": "2", "c": "1"}
    store.delete("word", rows(spark, ("a", "")), datetime(2024, 1, 1))
    assert content(store) == {"b": "2", "c": "1"}
    store.append("word", rows(spark, ("a", "3")))
    before = content(store)
    store.compact("word")
    assert content(store) == before == {"a": "3", "b": "2", "c": "1"}
    assert len(store.layers("word")) == 1
    store.replace("word", rows(spark, ("z", "9")))
    assert content(store) == {"z": "9"}


def test_unfinished_layer_is_ignored(spark, folder):
    store = CorpusStore(spark, str(folder))
    store.append("word", rows(spark, ("a", "1")))
    broken = folder / "doc_type=word" / "layer=000099-delta"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert content(store) == {"a": "1"}


def test_tagged_layer_replaces_itself(spark, folder):
    store = CorpusStore(spark, str(folder))
    store.append("word", rows(spark, ("a", "1")), tag="q-0")
    store.append("word", rows(spark, ("a", "2")), tag="q-0")
    assert content(store) == {"a": "2"}
    assert len(store.layers("word")) == 2


def test_empty_batch_adds_nothing(spark, folder):
    store = CorpusStore(spark, str(folder))
    assert store.append("word", rows(spark, ("a", "1")))
    layers = store.layers("word")
    assert not store.append("word", rows(spark, ("a", "1")).where("false"))
    assert store.layers("word") == layers


def test_ingest_twice_indexes_nothing(spark, folder):
    store = CorpusStore(spark, str(folder))
    docs = dt.corpus(spark, SMALL).where(F.col("doc_type") == "word")
    n = docs.count()
    assert ingest_documents(store, "word", docs) == (n, n)
    assert ingest_documents(store, "word", docs) == (n, 0)
    changed = docs.withColumn("content_hash", F.when(F.col("doc_id") == 6, "x").otherwise(F.col("content_hash")))
    assert ingest_documents(store, "word", changed) == (n, 1)
    assert ingest_documents(store, "word", docs) == (n, 1)


def test_id_lookup_is_pushed_down(spark, folder):
    store = CorpusStore(spark, str(folder))
    store.replace("word", rows(spark, ("a", "1"), ("b", "1")))
    plan = store.current(["word"]).where(F.col("id") == "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,a)" in plan


def test_upsert_is_idempotent(spark):
    base, batch = rows(spark, ("a", "1"), ("b", "1")), rows(spark, ("b", "2"), at="2024-01-02")
    once = corpus_ops.upsert(base, batch)
    twice = corpus_ops.upsert(once, batch)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_state_text_round_trip(spark, folder):
    rows_in = spark.createDataFrame([("p", "h", "/x")], "path_hash string, content_hash string, original_path string")
    state.write_state_text(rows_in, str(folder / "state"))
    assert [tuple(r) for r in state.read_state_text(spark, str(folder / "state")).collect()] == [("p", "h", "/x")]


def test_state_versions(spark, folder):
    path = str(folder / "state")
    assert state.read_state(spark, path).count() == 0
    first = spark.createDataFrame([("p", "h", "/x", "word")], state.STATE_SCHEMA)
    state.write_state(first, path)
    known = state.read_state(spark, path)
    more = known.unionByName(spark.createDataFrame([("q", "h", "/y", "pdf")], state.STATE_SCHEMA))
    state.write_state(more, path)
    assert state.read_state(spark, path).count() == 2
    plan = state.read_state(spark, path).where("doc_type = 'pdf'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_type" in plan


def test_repeated_ids_are_stored_and_counted_once(spark, folder):
    store = CorpusStore(spark, str(folder))
    batch = rows(spark, ("a", "1"), ("b", "1")).unionByName(rows(spark, ("a", "2"), at="2024-02-01"))
    assert ingest_documents(store, "word", batch) == (2, 2)
    assert store.current(["word"]).count() == 2 and content(store) == {"a": "2", "b": "1"}
    assert ingest_documents(store, "word", batch) == (2, 0)
    assert ingest_documents(store, "word", batch, full_refresh=True) == (2, 2)
    assert store.current(["word"]).count() == 2


def test_empty_deletions_add_no_layer(spark, folder):
    store = CorpusStore(spark, str(folder))
    store.append("word", rows(spark, ("a", "1")))
    before = store.layers("word")
    store.delete("word", rows(spark, ("a", "1")).limit(0), datetime(2024, 1, 1))
    assert store.layers("word") == before
