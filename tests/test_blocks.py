"""The block index: bounds, boolean searches, wildcards, layers, deep pages and prefix tables."""

from __future__ import annotations

import re
import time
from pathlib import Path

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from paperloom.operators import block_search as bs
from paperloom.operators import search, suggest
from paperloom.operators.block_index import BlockIndex
from paperloom.operators.deep_page import deep_page
from paperloom.operators.index import POSTINGS_SCHEMA, query_terms
from paperloom.plans import driver_tables as dt
from paperloom.plans.columns import literal_rows


@pytest.fixture(scope="module")
def corpus(spark):
    return dt.commented_corpus(spark, SMALL).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    return BlockIndex(spark, str(tmp_path_factory.mktemp("blocks"))).build(corpus)


@pytest.fixture(scope="module")
def texts(corpus):
    """(id, [tokens of content], [tokens of comments]) of every document."""
    return [
        (r.id, re.findall(r"\w+", r.content.lower()), re.findall(r"\w+", " ".join(c.comment for c in r.comments).lower()))
        for r in corpus.collect()
    ]


def ranking(hits):
    return [(r.id, r.score) for r in hits.orderBy(F.desc("score"), F.asc("id")).collect()]


@pytest.mark.parametrize("phrase", ["the elle la", "nosuchterm", "thing queue with of"])
@pytest.mark.parametrize("k", [7, 300])
def test_best_equals_the_first_of_all(corpus, index, phrase, k):
    found = bs.best(index, phrase, k).orderBy("rank").collect()
    want = ranking(search.search(corpus, phrase))[:k]
    assert [(r.id, r.score) for r in found] == want and [r["rank"] for r in found] == list(range(1, len(want) + 1))


def test_best_of_some_kinds_and_of_all_terms(corpus, index):
    some = bs.best(index, "the elle", 20, kinds=["word", "msg"])
    assert ranking(some.drop("rank")) == ranking(search.search(corpus, "the elle", ["word", "msg"]))[:20]
    every = bs.best(index, "the with", 20, require_all=True)
    assert ranking(every.drop("rank")) == ranking(search.search(corpus, "the with", require_all=True))[:20]


def test_bounds_hold_and_leave_intervals_out(index, corpus):
    terms = query_terms("la elle the")
    blocks = index.table("blocks").where(F.col("term").isin(*terms))
    bounds = bs.interval_bounds(blocks, bs.impacts(index, terms))
    where = index.forward().select("id", "doc_type", "interval").distinct()
    met = search.search(corpus, "la elle the").join(where, ["id", "doc_type"]).join(bounds, ["doc_type", "interval"], "left")
    assert met.where("bound is null or score > bound + 0.00001").count() == 0
    least = ranking(search.search(corpus, "la elle the"))[9][1]
    assert bounds.where(F.col("bound") < least).count() > 0


def test_joined_intervals_give_the_same(corpus, index, monkeypatch):
    monkeypatch.setattr(bs, "NAMED_INTERVALS", 0)
    assert ranking(bs.best(index, "the elle", 12).drop("rank")) == ranking(search.search(corpus, "the elle"))[:12]


def has(tokens, clause) -> bool:
    if isinstance(clause, bs.Term):
        return bool(query_terms(clause.text)) and all(any(t in f for f in tokens) for t in query_terms(clause.text))
    if isinstance(clause, bs.Phrase):
        terms = query_terms(clause.text)
        return bool(terms) and any(f[i : i + len(terms)] == terms for f in tokens for i in range(len(f)))
    if isinstance(clause, bs.Prefix):
        return any(t.startswith(clause.text) for f in tokens for t in f)
    if isinstance(clause, bs.Wildcard):
        pattern = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in clause.pattern))
        return any(pattern.fullmatch(t) for f in tokens for t in f)
    if isinstance(clause, bs.Not):
        return not has(tokens, clause.clause)
    if isinstance(clause, bs.Everything):
        return True
    return (all if isinstance(clause, bs.All) else any)(has(tokens, c) for c in clause.clauses)


CLAUSES = [
    bs.Term("elle"),
    bs.Term("with the"),
    bs.Phrase("in the the"),
    bs.Phrase("the the"),
    bs.AnyOf((bs.Phrase("of the"), bs.Phrase("the of"), bs.Wildcard("?rt*"))),
    bs.All((bs.Term("the"), bs.Not(bs.Term("of")), bs.AnyOf((bs.Prefix("er"), bs.Term("elle"))))),
    bs.Not(bs.AnyOf((bs.Prefix("th"), bs.Wildcard("*u*u*")))),
    bs.All((bs.Not(bs.Term("the")), bs.Not(bs.Not(bs.Term("der"))))),
    bs.All(()),
    bs.AnyOf(()),
    bs.AnyOf((bs.Everything(), bs.Term("nosuchterm"))),
    bs.All((bs.Term("..."), bs.Term("the"))),
    bs.AnyOf((bs.Phrase("-"), bs.Term("elle"))),
    bs.AnyOf((*(bs.Term(f"nosuch{k}") for k in range(70)), bs.Phrase("of the"), bs.Term("elle"), bs.Wildcard("er*at"))),
]


@pytest.mark.parametrize("clause", CLAUSES, ids=range(len(CLAUSES)))
def test_clauses(index, texts, clause):
    found = [r.id for r in bs.search(index, clause).collect()]
    assert sorted(found) == sorted(i for i, *tokens in texts if has(tokens, clause))


def test_scores_add_up(index, corpus):
    terms = dict(ranking(bs.search(index, bs.phrase_clause("the elle"))))
    assert terms == dict(ranking(search.search(corpus, "the elle")))
    both = dict(ranking(bs.search(index, bs.AnyOf((bs.Term("the"), bs.Term("elle"), bs.Prefix("er"), bs.Not(bs.Term("of")))))))
    prefix = {i for i, _ in ranking(bs.search(index, bs.Prefix("er")))}
    assert all(abs(s - terms.get(i, 0) - (i in prefix)) < 3e-6 for i, s in both.items())


@pytest.mark.parametrize("pattern", ["er*at", "*hat", "?he", "*", "t?e", "*a*b*", "the", "", "e.*"])
def test_patterns(index, texts, pattern):
    wanted = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern))
    terms = {t for _, *fields in texts for f in fields for t in f}
    found = [r.term for r in bs.matching_terms(index.table("grams"), index.table("doc_freq"), pattern).collect()]
    assert sorted(found) == sorted(t for t in terms if wanted.fullmatch(t))


def test_grams_narrow_patterns():
    assert bs.pattern_grams("er*at") == ["^er", "at$"]
    assert bs.pattern_grams("*th?ta*") == []
    assert bs.pattern_grams("queue") == ["^qu", "eue", "que", "ue$", "ueu"]


def rows(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def same_index(one: BlockIndex, other: BlockIndex):
    plain = [f.name for f in POSTINGS_SCHEMA]
    assert rows(one.postings(), plain) == rows(other.postings(), plain)
    assert rows(one.doc_freq(), one.doc_freq().columns) == rows(other.doc_freq(), other.doc_freq().columns)
    assert rows(one.field_stats(), one.field_stats().columns) == rows(other.field_stats(), other.field_stats().columns)
    assert rows(one.documents(), ["doc_type", "id"]) == rows(other.documents(), ["doc_type", "id"])


def test_layers_equal_a_rebuild(spark, corpus, folder):
    doc_id, none = F.col("doc_id"), corpus.where("false")
    index = BlockIndex(spark, str(folder / "layers")).build(corpus.where(doc_id % 3 != 0))
    index.apply(corpus.where(doc_id % 3 == 0), none.select("id"))
    changed = corpus.where(doc_id % 5 == 0).withColumn("content", F.concat(F.lit("new words elle "), F.substring("content", 1, 50)))
    index.apply(changed, corpus.where(doc_id % 7 == 0).select("id"))
    index.apply(none, corpus.where(doc_id % 4 == 0).select("id"))
    again = corpus.where(doc_id % 28 == 0)
    index.apply(again, none.select("id"))
    # The second run removed what it also changed: a changed row is in place, whatever else the run removes.
    left = corpus.where(~(doc_id % 4 == 0) & ~((doc_id % 7 == 0) & (doc_id % 5 != 0)) & (doc_id % 5 != 0))
    left = left.unionByName(changed.where(doc_id % 4 != 0)).unionByName(again)
    rebuilt = BlockIndex(spark, str(folder / "rebuilt")).build(left)
    same_index(index, rebuilt)
    assert ranking(bs.best(index, "elle new the", 15).drop("rank")) == ranking(search.search(left, "elle new the"))[:15]
    index.compact()
    assert len(index.layers()) == 1
    same_index(index, rebuilt)
    assert ranking(bs.search(index, bs.Prefix("new"))) == ranking(bs.search(rebuilt, bs.Prefix("new")))


def test_an_unfinished_layer_is_not_seen_and_is_written_over(spark, corpus, folder):
    index = BlockIndex(spark, str(folder / "broken")).build(corpus.where("doc_id % 2 = 0"))
    before = rows(index.doc_freq(), index.doc_freq().columns)
    corpus.where("false").select("id").write.parquet(f"{index.path}/gone/layer=2")
    index.table("doc_freq").drop("layer").write.parquet(f"{index.path}/doc_freq/layer=2")
    assert rows(index.doc_freq(), index.doc_freq().columns) == before
    index.apply(corpus.where("doc_id % 2 = 1"), corpus.where("false").select("id"))
    same_index(index, BlockIndex(spark, str(folder / "whole")).build(corpus))


def test_no_index_and_empty_corpus(spark, corpus, folder):
    with pytest.raises(ValueError, match="build"):
        BlockIndex(spark, str(folder / "none")).apply(corpus, corpus.select("id"))
    empty = BlockIndex(spark, str(folder / "empty")).build(corpus.where("false"))
    assert bs.best(empty, "the", 5).count() == 0
    assert bs.search(empty, bs.Not(bs.Term("the"))).count() == 0
    assert bs.search(empty, bs.Wildcard("*")).count() == 0


def test_pages_of_any_depth(spark):
    hits = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.round(F.rand(1) * 9, 3)).alias("score")
    ).cache()
    order = [(r.id, r.score) for r in hits.orderBy(F.desc("score"), F.asc("id")).collect()]
    for start, size in ((0, 10), (2000, 700), (4990, 50), (5000, 10)):
        page = deep_page(hits, start, size).orderBy("rank").collect()
        assert [(r.id, r.score) for r in page] == order[start : start + size]
        assert [(r["rank"], r.total) for r in page] == [(k + 1, 5000) for k in range(start, min(start + size, 5000))]


def test_a_page_of_equal_scores_and_of_nothing(spark):
    hits = spark.range(900).select(F.format_string("%04d", F.col("id")).alias("id"), F.lit(1.0).alias("score"))
    assert [r.id for r in deep_page(hits, 500, 3).orderBy("rank").collect()] == ["0500", "0501", "0502"]
    assert deep_page(hits.where("false"), 0, 3).count() == 0


@pytest.fixture(scope="module")
def terms(spark, corpus):
    return suggest.term_table(corpus.select("doc_type", "content")).cache()


@pytest.mark.parametrize("prefix", ["Er", "", "t", "nosuchprefix", "the", "x" * 40])
def test_prefix_table_suggests_the_same(spark, terms, prefix):
    long = literal_rows(spark, [("word", "x" * 45), ("pdf", "x" * 41)], ["doc_type", "term"])
    terms = terms.unionByName(long)
    table = suggest.prefix_table(terms)
    want = [tuple(r) for r in suggest.suggest(terms, prefix).collect()]
    assert [tuple(r) for r in suggest.suggest_by_table(table, terms, prefix).collect()] == want


def test_prefix_tables_merge_in_any_order_and_lose_terms(spark, terms):
    def as_dict(table):
        return {(r.doc_type, r.prefix): tuple(r.terms) for r in table.collect()}

    whole = as_dict(suggest.prefix_table(terms))
    parts = [suggest.prefix_table(terms.where(F.pmod(F.xxhash64("term"), F.lit(3)) == k)) for k in range(3)]
    assert as_dict(suggest.merged_prefixes([suggest.merged_prefixes(parts[:2]), parts[2]])) == whole
    assert as_dict(suggest.merged_prefixes([parts[2], suggest.merged_prefixes(parts[1::-1])])) == whole
    gone = terms.where(F.col("term").startswith("er"))
    left = terms.where(~F.col("term").startswith("er"))
    assert as_dict(suggest.without_terms(suggest.prefix_table(terms), gone, left)) == as_dict(suggest.prefix_table(left))


def test_only_prefixes_that_can_offer_a_term_are_made(spark):
    rows = [("word", f"abc{n:03d}") for n in range(60)] + [("word", "ab"), ("word", "ab"), ("pdf", "abc000"), ("pdf", "")]
    terms = literal_rows(spark, rows, ["doc_type", "term"])
    made = suggest.offering_prefixes(terms, 2)
    per_prefix = made.groupBy("doc_type", "prefix").count().agg(F.max("count")).first()[0]
    assert per_prefix <= 2 * 3  # groups: "", "ab" and "abc"; all 61 terms share the prefix "ab"
    want: dict = {}
    for kind, term in sorted(set(rows)):
        for n in range(len(term) + 1):
            want.setdefault((kind, term[:n]), []).append(term)
    found = {(r.doc_type, r.prefix): r.terms for r in suggest.prefix_table(terms, 2).collect()}
    assert found == {key: offered[:2] for key, offered in want.items()}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_move_documents_not_postings(index):
    from paperloom.operators.block_index import block_rows
    from paperloom.session import aggregation_in_order

    with aggregation_in_order(index.spark):
        plan = plan_of(block_rows(index.table("forward").drop("layer"), 4))
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc_type" in plan and plan.count("Sort [") == 1
    assert plan.index("Generate") < plan.index("Exchange ") and "ObjectHashAggregate" not in plan


def test_all_postings_are_those_of_the_blocks_after_changes(spark, corpus, tmp_path):
    changed = BlockIndex(spark, str(tmp_path)).build(corpus.where("doc_id % 4 != 1"))
    changed.apply(corpus.where("doc_id % 4 = 1 or doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" more"))), corpus.where("doc_id = -1").select("id"))
    changed.apply(corpus.where("doc_id = -1"), corpus.where("doc_id % 7 = 0").select("id"))

    def key(rows):
        return sorted((r.doc_type, r.id, r.field, r.term, r.tf, r.dl, tuple(r.positions)) for r in rows.collect())

    assert key(changed.all_postings()) == key(changed.postings())
    freq = changed.all_postings().groupBy("doc_type", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
    assert freq.exceptAll(changed.doc_freq()).count() == 0 == changed.doc_freq().exceptAll(freq).count()


def test_terms_of_a_pattern_are_named_or_joined(index, monkeypatch):
    named = bs.search(index, bs.Wildcard("er*at"))
    assert "LeftSemi" not in plan_of(named)
    found = ranking(named)
    monkeypatch.setattr(bs, "NAMED_TERMS", 0)
    assert found and ranking(bs.search(index, bs.Wildcard("er*at"))) == found


def test_terms_are_counted_where_the_text_is(spark):
    from paperloom.operators import index as ix

    rows = [(1, "a b a"), (2, "b"), (2, "b c"), (3, ""), (None, "a")]
    docs = literal_rows(spark, rows, ["doc_id", "text"])
    counts = ix.term_counts(docs, F.col("text"), "doc_id")
    plan = plan_of(counts)
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")
    assert sorted(map(tuple, counts.where("doc_id is not null").collect())) == [(1, 3, "a", 2), (1, 3, "b", 1), (2, 1, "b", 1), (2, 2, "b", 1), (2, 2, "c", 1)]
    assert counts.where("doc_id is null").count() == 1


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_shuffles_of_a_layer_go_when_it_is_written(spark, corpus, tmp_path):
    corpus.count()
    before = shuffle_files(spark)
    index = BlockIndex(spark, str(tmp_path)).build(corpus.where("doc_id % 4 != 1"))
    index.apply(corpus.where("doc_id % 4 = 1"), corpus.where("doc_id % 7 = 0").select("id"))
    for _ in range(50):  # removed in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_packed_rows_are_what_was_packed(spark):
    from paperloom.operators.block_index import forward_rows, packed, unpacked

    texts = [(1, "a1", "word", "B a b_1 ä a"), (2, "a2", None, "x"), (3, None, "pdf", "7 7 7"), (4, "a4", "pdf", " ,; "), (5, "a5", "pdf", None)]
    none = F.array().cast("array<struct<comment:string>>")
    forward = forward_rows(literal_rows(spark, texts, ["n", "id", "doc_type", "content"]).withColumn("comments", none), 2)
    keys = ("doc_type", "id", "field")
    plain = forward.select(*keys, "dl", F.inline("runs"))
    moved = unpacked(packed(forward, *keys), *keys)
    assert plain.columns == moved.columns and plain.dtypes == moved.dtypes
    found = sorted(map(repr, moved.collect()))
    assert found == sorted(map(repr, plain.collect())) and len(found) == 6


def test_narrow_rows_become_what_they_were(spark):
    from paperloom.operators.block_index import narrow, widen

    ids = ["0a" * 32, "0A" * 32, "abc", "no hash", "", None, "0", "ff"]
    rows = literal_rows(spark, [(n, i) for n, i in enumerate(ids)], ["n", "id"]).select(
        F.lit("word").alias("doc_type"), "id", F.lit("content").alias("field"), F.concat(F.lit("t"), F.col("n")).alias("term"),
        F.lit(2).alias("tf"), F.lit(9).alias("dl"), F.array(F.lit(0), F.col("n")).alias("positions"),
    )
    back = widen(narrow(rows)).select(*rows.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert {n: t for n, t in narrow(rows).dtypes}["_hash"] == "binary"


@pytest.mark.parametrize("limit", [0, 5, 100_000])
def test_only_rows_of_rarer_keys_move(spark, limit):
    from paperloom.plans.skew import frequent_first_join

    big = spark.range(4000).select("id", F.when(F.col("id") % 10 < 7, F.col("id") % 5).otherwise(F.col("id")).alias("k"))
    big = big.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("k")))
    keyed = big.groupBy("k").agg(F.count("*").alias("df")).where("k is not null and k != 3")
    found = frequent_first_join(big, keyed, ["k"], "df", limit, narrow=lambda df: df.withColumn("moved", F.lit(1)), widen=lambda df: df.drop("moved"))
    plain = big.join(keyed, "k").select(*found.columns)
    assert found.exceptAll(plain).count() == 0 == plain.exceptAll(found).count()
    moved = []
    frequent_first_join(big, keyed, ["k"], "df", limit, narrow=lambda df: moved.append(df) or df)
    # four keys have 2,400 rows, 1,200 keys one each; no key joins the row without one and the 400 rows of key 3
    assert moved[0].count() == {0: 4001, 5: 1601, 100_000: 401}[limit]


def test_sized_postings_equal_a_plain_join(spark, corpus, tmp_path, monkeypatch):
    from paperloom.operators import block_index
    from paperloom.plans import skew

    changed = BlockIndex(spark, str(tmp_path)).build(corpus.where("doc_id % 4 != 1"))
    changed.apply(corpus.where("doc_id % 4 = 1 or doc_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" more"))), corpus.where("doc_id % 7 = 0").select("id"))

    def rows(df):
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))

    sizes = changed.doc_freq().join(changed.field_stats(), ["doc_type", "field"])
    want = rows(changed.postings().join(sizes, ["doc_type", "field", "term"]))
    assert rows(changed.sized_postings()) == want
    # many ids are void: documents move packed; few terms are frequent
    monkeypatch.setattr(block_index, "broadcast_if_small", lambda df: (df, False))
    monkeypatch.setattr(block_index, "frequent_first_join", lambda *a, **b: skew.frequent_first_join(*a, limit=200, **b))
    found = changed.sized_postings()
    assert rows(found) == want and "packed" in plan_of(found)
