"""Plans: no nested loops, no Python, pruned reads, bounded rankings."""

from __future__ import annotations

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from paperloom.operators import corpus as corpus_ops
from paperloom.operators import hits, index, search, suggest
from paperloom.plans import driver_tables as dt
from paperloom.plans.columns import literal_rows
from paperloom.plans.catalog import REGISTRY
from paperloom.plans.sizing import broadcast_if_small, estimated_bytes, spread_small
from paperloom.session import shared_folder
from paperloom.sources import pages

FORBIDDEN = ("NestedLoop", "Cartesian", "PythonEval", "InPandas", "ArrowEval", "ExistingRDD")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_has_no_slow_operator(spark, name):
    text = plan(REGISTRY[name](spark, SMALL))
    assert not [word for word in FORBIDDEN if word in text]


def test_narrow_queries_do_not_read_text(spark):
    for name in ("path_hash", "mime_type", "index_list", "cleanup_orphans", "cleanup_counters", "search_match_all"):
        assert "text:string" not in plan(REGISTRY[name](spark, SMALL)), name


def test_page_is_not_sorted_as_a_whole(spark):
    assert "TakeOrderedAndProject" in plan(REGISTRY["search_page"](spark, SMALL)) or "limit=" in plan(
        REGISTRY["search_page"](spark, SMALL)
    )


@pytest.mark.parametrize("name", ["suggest", "search_batch", "corpus_upsert"])
def test_rankings_are_cut_before_the_shuffle(spark, name):
    text = plan(REGISTRY[name](spark, SMALL))
    assert "row_number(), " in text and ", Partial" in text and ", Final" in text


def test_postings_need_no_shuffle(spark):
    found = index.postings(dt.table(spark, SMALL, "documents"), F.col("text"), "doc_id")
    assert "Exchange" not in plan(found)


def test_ranking_reads_texts_once(spark):
    found = search.rank_texts(dt.table(spark, SMALL, "documents"), F.col("text"), ["the", "elle"], ["doc_id"])
    found.collect()
    final = plan(found).split("Initial Plan")[0]
    assert final.count("FileScan parquet [doc_id") == 1 or "ReusedExchange" in final


def test_page_is_ranked_before_texts_are_joined(spark):
    text = plan(REGISTRY["search_hits"](spark, SMALL))
    assert "TakeOrderedAndProject" in text


def test_small_page_filters_the_scan(spark):
    docs = dt.table(spark, SMALL, "documents")
    assert "In(doc_id, " in plan(hits.fetched(docs, {3: 1.0, 4: 0.5}, "doc_id"))


def test_spread_depends_on_size(spark, monkeypatch):
    docs = dt.table(spark, SMALL, "documents")
    assert 0 < estimated_bytes(docs) < 10_000_000
    assert spread_small(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("paperloom.plans.sizing.SMALL_BYTES_PER_CORE", 1)
    assert "hashpartitioning" not in plan(spread_small(docs, "doc_id"))


def test_broadcast_only_when_small(spark):
    assert broadcast_if_small(spark.range(10), 10)[1]
    assert not broadcast_if_small(spark.range(11), 10)[1]


# --- one key with a third of all rows -----------------------------------------------------


def test_hot_document_in_page_assembly(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 100).alias("key"),
        F.col("id").alias("n"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    whole = pages.assemble_pages(rows, "key", "n", "text", part_size=64)
    hot = whole.where("key = -1").first()
    assert hot.page_count == 3000
    assert hot.content == " ".join(f"t{i}" for i in range(0, 9000, 3))
    parts = pages.assemble_parts(rows, "key", "n", "text", part_size=64)
    assert parts.agg(F.max("page_count")).first()[0] <= 64
    assert parts.agg(F.sum("page_count")).first()[0] == 9000


def test_hot_document_on_a_result_page(spark):
    rows = spark.range(3000).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 1, F.lit("the same remark")).otherwise(F.lit("nothing")).alias("comment"),
        F.lit("a").alias("author"), F.lit("2024-01-01").cast("timestamp").alias("date"),
        F.col("id").cast("string").alias("number"), F.lit("A").alias("initials"),
    ).withColumnRenamed("number", "id")
    every = F.sort_array(F.collect_list(F.struct("turn", F.struct("comment", "author", "date", "id", "initials").alias("c"))))
    whole = rows.groupBy("doc_id").agg(F.transform(every, lambda x: x["c"]).alias("comments"))
    kept = hits.hit_comments(rows, ["the"], "doc_id", "turn")
    assert kept.select(F.size("comments")).first()[0] == 5
    details = [f.select(hits.comment_details(F.col("comments"), ["the"]).alias("d")).first().d for f in (whole, kept)]
    assert details[0] == details[1] and details[0][0]["id"] == "1"


def test_hot_document_in_first_words(spark):
    rows = spark.range(3000).select(
        F.lit(1).alias("key"), F.col("id").alias("n"),
        F.concat_ws(" ", F.lit("same"), (F.col("id") % 7).cast("string")).alias("text"),
    )
    words = pages.first_appearance_words(rows, "key", "n", "text").first()["words"]
    assert words == ["same", *map(str, range(7))]


def test_copies_of_one_id_in_a_batch(spark):
    batch = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.timestamp_seconds("id").alias("process_time"), F.col("id").cast("string").alias("content_hash"),
    )
    last = corpus_ops.last_write_per_id(batch)
    assert last.count() == 2001
    assert last.where("id = 'hot'").first()["content_hash"] == "2997"


def test_suggestions_take_turns(spark):
    terms = literal_rows(
        spark,
        [("word", "ab"), ("word", "ac"), ("pdf", "aa"), ("pdf", "ab"), ("msg", "b")],
        ["doc_type", "term"],
    )
    found = [(r.label, r.index_names) for r in suggest.suggest(terms, "A").collect()]
    assert found == [
        ("ab", ["officedocuments-word", "officedocuments-pdf"]),
        ("ac", ["officedocuments-word"]),
        ("aa", ["officedocuments-pdf"]),
    ]
    assert suggest.suggest(terms, "A", case_sensitive=True).count() == 0


def test_prefix_is_pushed_to_stored_terms(spark, folder):
    terms = literal_rows(spark, [("word", "ab"), ("word", "b"), ("pdf", "ac")], ["doc_type", "term"])
    suggest.write_terms(terms, str(folder / "terms"))
    stored = suggest.read_terms(spark, str(folder / "terms"))
    found = suggest.suggest(stored, "a", ["word"])
    assert "StringStartsWith(term,a)" in plan(found)
    assert [r.label for r in found.collect()] == ["ab"]


def test_shared_folder_is_kept(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(REGISTRY) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())


def test_partitions_grow_with_any_size():
    from paperloom.plans.sizing import PARTITION_BYTES, partitions_of

    assert [partitions_of(2**k, 4, 9) for k in (20, 40, 49, 51, 60)] == [4, *(2**k // PARTITION_BYTES for k in (40, 49, 51, 60))]
    assert partitions_of(None, 4, 9) == 9


def test_sizes_of_sources_add_up(spark):
    from paperloom.plans.sizing import source_bytes

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = source_bytes(docs)
    assert 0 < source_bytes(docs.join(docs.select("doc_id"), "doc_id")) <= 2 * one
