"""Search: scan form, index form, many queries, and their agreement."""

from __future__ import annotations

import pytest
from paths import MEDIUM, SMALL
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import batch_search, search
from paperloom.operators import index as ix
from paperloom.plans import driver_tables as dt
from paperloom.plans.columns import computed_once, literal_rows
from paperloom.plans.skew import heavy_keys, salted_join


@pytest.fixture(scope="module")
def corpus(spark):
    comments = dt.nested_comments(spark, SMALL)
    rows = dt.corpus_without_hash(spark, SMALL).join(comments, "doc_id", "left")
    none = F.array().cast(comments.schema["comments"].dataType)
    return rows.withColumn("comments", F.coalesce("comments", none)).drop("doc_id").cache()


def as_dict(hits):
    return {r.id: r.score for r in hits.collect()}


def test_known_document_frequencies(spark):
    counts = ix.term_counts(dt.documents(spark, MEDIUM), F.col("text"), "doc_id")
    wanted = {"the": 615, "with": 435, "thing": 200, "der": 127, "und": 118, "elle": 77, "erthat": 21, "queue": 10}
    found = ix.doc_freq(counts).where(F.col("term").isin(*wanted)).collect()
    assert {r.term: r.df for r in found} == wanted


def test_known_number_of_hits(spark):
    docs = dt.documents(spark, MEDIUM)
    assert search.rank_texts(docs, F.col("text"), ["the", "elle"], ["doc_id"]).count() == 691
    assert search.search_phrase(docs, F.col("text"), "of the", ["doc_id"]).count() == 274


def test_postings_equal_counts(spark):
    docs = dt.documents(spark, SMALL)
    counts = ix.term_counts(docs, F.col("text"), "doc_id").select("doc_id", "dl", "term", "tf")
    found = ix.postings(docs, F.col("text"), "doc_id")
    assert found.where(F.size("positions") != F.col("tf")).count() == 0
    narrow = found.select("doc_id", "dl", "term", "tf")
    assert narrow.exceptAll(counts).count() == 0 and counts.exceptAll(narrow).count() == 0


def test_index_form_equals_scan_form(spark, corpus, folder):
    path = str(folder / "index")
    ix.write_index(corpus, path, partitions=3)
    tables = ix.read_postings(spark, path), ix.read_doc_freq(spark, path), ix.read_field_stats(spark, path)
    for phrase, kinds in (("the elle la", None), ("der", ["word", "msg"]), ("nosuchterm", None)):
        assert as_dict(search.search_index(*tables, phrase, kinds)) == as_dict(search.search(corpus, phrase, kinds))
    both = search.search_index(*tables, "the with", require_all=True)
    assert as_dict(both) == as_dict(search.search(corpus, "the with", require_all=True))
    less = search.search_index(*tables, "der", must_not=["die"])
    assert as_dict(less) == as_dict(search.search(corpus, "der", must_not=["die"]))
    for phrase in (" ", "*"):
        assert as_dict(search.search_index(*tables, phrase)) == as_dict(search.search(corpus, phrase))
    plan = search.search_index(*tables, "the elle")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [elle,the])" in plan or "In(term, [the,elle])" in plan


def test_index_update_equals_rebuild(spark, corpus):
    changed = corpus.where(F.col("doc_type") == "word").withColumn("content", F.concat(F.lit("fresh "), "content"))
    removed = corpus.where(F.col("doc_type") == "msg").select("id")
    updated = ix.updated_postings(ix.corpus_postings(corpus), changed, removed)
    rest = corpus.where(~F.col("doc_type").isin("word", "msg"))
    rebuilt = ix.corpus_postings(rest.unionByName(changed))
    assert updated.exceptAll(rebuilt).count() == 0 and rebuilt.exceptAll(updated).count() == 0


def test_search_forms(spark, corpus):
    everything = corpus.count()
    assert search.search(corpus, "  ").count() == everything
    assert set(as_dict(search.search(corpus, "")).values()) == {1.0}
    assert search.search(corpus, "?!").count() == 0
    assert search.search(corpus, "the", kinds=[]).count() == 0
    some, less = as_dict(search.search(corpus, "der")), as_dict(search.search(corpus, "der", must_not=["die"]))
    assert set(less) < set(some)
    first = search.fetch_page(search.search(corpus, "the elle"), 0, 3)
    second = search.fetch_page(search.search(corpus, "the elle"), 3, 3)
    found, info = search.timed_page(search.search(corpus, "the elle"), "the elle", 0, 3)
    assert found == first and info["total"] > 6 and info["search_phrase"] == "the elle" and info["millis"] >= 0
    scores = [*first.values(), *second.values()]
    assert scores == sorted(scores, reverse=True) and not set(first) & set(second)


def test_phrase_forms_agree(spark):
    docs = dt.documents(spark, SMALL)
    for phrase in ("of the", "the the", "in"):
        direct = search.search_phrase(docs, F.col("text"), phrase, ["doc_id"])
        voted = search.phrase_from_postings(ix.postings(docs, F.col("text"), "doc_id"), phrase, ["doc_id"])
        assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, voted.collect()))


def batch(spark, sf_dir, **options):
    phrases = dt.table(spark, sf_dir, "benchmark")
    pairs = phrases.select(
        F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")
    )
    docs = dt.documents(spark, sf_dir)
    lengths = computed_once(docs, [], dl=F.size(tx.tokens(F.col("text"))))
    counts = batch_search.batch_counts(docs, F.col("text"), pairs, "doc_id")
    found = batch_search.search_batch(counts, pairs, ix.field_stats(lengths), 5, "doc_id", **options)
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in found.collect())


def test_pruned_batch_equals_plain_batch(spark):
    assert batch(spark, MEDIUM, pair_limit=0) == batch(spark, MEDIUM)


def test_batch_without_broadcast(spark, monkeypatch):
    plain = batch(spark, SMALL)
    monkeypatch.setattr(batch_search, "BROADCAST_ROW_LIMIT", 10)
    assert batch(spark, SMALL) == plain
    assert batch(spark, SMALL, pair_limit=0) == plain


def test_salted_join_equals_join(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = literal_rows(spark, [(0, "hot"), (1, "a"), (1, "b")], ["k", "v"])
    plain, salted = big.join(small, "k"), salted_join(big, small, "k", "id", salts=4)
    assert sorted(map(tuple, plain.select("k", "id", "v").collect())) == sorted(
        map(tuple, salted.select("k", "id", "v").collect())
    )


@pytest.mark.parametrize("rows", [6_000, 60_000])
def test_a_hot_term_spreads_with_the_data(spark, rows):
    """A term in a third of all rows gets a third of the shares at any size; no part of it holds more than others."""
    big = spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("k"))
    heavy = {r.k: r.parts for r in heavy_keys(big, "k", 120).collect()}
    assert heavy == {"hot": 40}
    small = literal_rows(spark, [("hot", 1), ("t1", 2), ("hot", 3)], ["k", "v"])
    assert salted_join(big, small, "k", "id", 120).groupBy("v").count().orderBy("v").collect() == [
        (1, rows // 3), (2, 1), (3, rows // 3)
    ]
    assert heavy_keys(big.where("false"), "k").count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def asked(spark, rows):
    """Documents of (doc_id, text) rows, the terms that two queries ask for and counts of these."""
    docs = literal_rows(spark, rows, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    pairs = literal_rows(spark, [(1, "the"), (1, "ä1"), (2, "the"), (2, "x_y")], ["query_id", "term"])
    return docs, pairs, batch_search.batch_counts(docs, F.col("text"), pairs, "doc_id")


def test_only_tokens_that_are_asked_for_move(spark, monkeypatch):
    rows = [(1, "The ä1 the; other's"), (2, "nothing"), (2, "the"), (2, "the"), (2, "the more"), (3, ""), (4, None), (None, "x_y the")]
    docs, pairs, counts = asked(spark, rows)
    moved = plan_of(counts).split("Exchange ")
    assert len(moved) == 2 and "text" not in moved[1] and "_asked" in moved[1]
    want = ix.term_counts(docs, F.col("text"), "doc_id", vocabulary=F.broadcast(pairs.select("term").distinct()))
    found = sorted(map(repr, counts.collect()))
    assert found == sorted(map(repr, want.select(*counts.columns).collect())) and len(found) == 6 and counts.dtypes == want.dtypes
    monkeypatch.setattr(batch_search, "NAMED_TERMS", 1)  # too many to be named: whole texts move
    assert sorted(map(repr, asked(spark, rows)[2].collect())) == found


def test_pruning_moves_no_row_per_query_and_document(spark, monkeypatch):
    from paperloom.session import joined_where_dealt

    plans, keep = [], batch_search.candidate_scores
    monkeypatch.setattr(batch_search, "candidate_scores", lambda *a: plans.append(keep(*a)) or plans[0])
    found = batch(spark, MEDIUM, pair_limit=0)
    assert found and len(plans) == 1
    with joined_where_dealt(spark):
        moved = [line for line in plan_of(plans[0].select("*")).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(doc_id" in line and "REPARTITION" in line or "hashpartitioning(query_id" in line for line in moved)
    # what is dealt out by query are its limits, not its documents
    assert sum("hashpartitioning(query_id" in line for line in moved) <= 1
