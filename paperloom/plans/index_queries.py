"""Registered queries on stored index tables: the index is written once, every search reads its part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import block_search as bs
from paperloom.operators import deep_page as deep
from paperloom.operators import search, suggest
from paperloom.operators.block_index import BlockIndex
from paperloom.plans import driver_tables as dt
from paperloom.plans.queries import Query, listed
from paperloom.plans.staging import scratch
from paperloom.session import configure

REGISTRY: dict[str, Query] = {}


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    REGISTRY[query.__name__] = run
    return run


@registered
def search_block_max(spark, sf_dir):
    """The 25 best hits over both fields, blocks that cannot reach them left out."""
    return bs.best(dt.block_index(spark, sf_dir), "la elle the", 25).select("id", "doc_type", "score", "rank")


@registered
def search_block_max_all(spark, sf_dir):
    """The 25 best hits that have every term."""
    return bs.best(dt.block_index(spark, sf_dir), "with the", 25, require_all=True).select("id", "doc_type", "score", "rank")


@registered
def search_index_everything(spark, sf_dir):
    """A blank phrase on the index: every document, also those without a term."""
    return bs.search(dt.block_index(spark, sf_dir), bs.phrase_clause(" "))


@registered
def search_index_postings(spark, sf_dir):
    """Ranked search from the postings of the query terms, in some kinds."""
    index = dt.block_index(spark, sf_dir)
    kinds = ["word", "pdf", "eml"]
    return search.search_index(index.postings(), index.doc_freq(), index.field_stats(), "elle the", kinds)


COMBINED = bs.All(
    (
        bs.AnyOf((bs.Term("elle"), bs.Phrase("of the"), bs.Wildcard("er*at"))),
        bs.Not(bs.All((bs.Term("queue"), bs.Prefix("thi")))),
    )
)


@registered
def search_combined(spark, sf_dir):
    """Terms, a phrase, a wildcard, a prefix and must-not in one search over both fields."""
    return bs.search(dt.block_index(spark, sf_dir), COMBINED)


@registered
def search_wildcard(spark, sf_dir):
    """Documents with a term that fits ``er*at``."""
    return bs.search(dt.block_index(spark, sf_dir), bs.Wildcard("er*at"))


@registered
def search_index_prefix(spark, sf_dir):
    """Documents with a term that starts with ``erth`` in either field, from postings."""
    return bs.search(dt.block_index(spark, sf_dir), bs.Prefix("erth"))


@registered
def wildcard_terms(spark, sf_dir):
    """Terms that fit a pattern without a fixed beginning, by their k-grams."""
    index = dt.block_index(spark, sf_dir)
    return bs.matching_terms(index.table("grams"), index.table("doc_freq"), "*th?t*")


@registered
def search_deep_page(spark, sf_dir):
    """Ten hits from rank 501 on, with the total."""
    hits = bs.search(dt.block_index(spark, sf_dir), bs.phrase_clause("the elle"))
    return deep.deep_page(hits, 500, 10).select("id", "doc_type", "score", "rank", "total")


@registered
def suggest_prefix_table(spark, sf_dir):
    """Suggestions looked up in a stored prefix table that is merged from contents and comments."""
    contents = dt.corpus_without_hash(spark, sf_dir).select("doc_type", "content")
    comments = dt.office_comments(spark, sf_dir).select(
        dt.kind_of(F.col("conv_id")).alias("doc_type"), F.col("text").alias("content")
    )
    parts, path = [], scratch(spark, "suggest")
    for name, rows in (("contents", contents), ("comments", comments)):
        suggest.write_terms(suggest.term_table(rows), f"{path}/{name}")
        parts.append(suggest.read_terms(spark, f"{path}/{name}"))
    suggest.write_prefixes(suggest.merged_prefixes([suggest.prefix_table(p) for p in parts]), f"{path}/prefixes")
    table = suggest.read_prefixes(spark, f"{path}/prefixes")
    found = suggest.suggest_by_table(table, parts[0].unionByName(parts[1]).distinct(), "Er")
    return found.select("label", listed(F.col("index_names")).alias("index_names"))


def _after_three_changes(spark, sf_dir) -> BlockIndex:
    """An index that saw new documents, changed ones and removed ones, each as a layer of its own."""
    rows, doc_id = dt.commented_corpus(spark, sf_dir), F.col("doc_id")
    none = rows.where(F.lit(False)).select("id")
    index = BlockIndex(spark, scratch(spark, "index")).build(rows.where(doc_id % 10 != 3))
    index.apply(rows.where(doc_id % 10 == 3), none)
    index.apply(rows.where(doc_id % 7 == 0).withColumn("content", F.concat("content", F.lit(" elle added"))), none)
    return index.apply(rows.where(F.lit(False)), rows.where(doc_id % 11 == 0).select("id"))


@registered
def index_delta(spark, sf_dir):
    """Postings with document frequencies and field sizes after three changes, none of them a rebuild."""
    return _after_three_changes(spark, sf_dir).sized_postings().select(
        "id", "doc_type", "field", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"),
        F.array_join(F.col("positions").cast("array<string>"), "|").alias("positions"), "df", "total_tf", "n_docs", "sum_dl",
    )


@registered
def index_delta_search(spark, sf_dir):
    """The best hits on the index after the same changes: blocks of several layers, void rows left out."""
    return bs.best(_after_three_changes(spark, sf_dir), "elle added the", 25).select("id", "doc_type", "score", "rank")
