"""Prefix suggestions over completion terms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import text as tx
from paperloom.functions.naming import index_name
from paperloom.schemas import INDEX_NAME, KIND_NAMES, MAIL_KINDS

SUGGESTIONS = 10


def completion_terms(content: Column, kind: Column) -> Column:
    """Completion terms of a text under the rule of its kind."""
    office = tx.suggest_terms(F.regexp_replace(content, tx.SUGGEST_OFFICE_JUNK, ""))
    return (
        F.when(kind.isin(*MAIL_KINDS), tx.suggest_terms_mail(content))
        .when(kind == "pdf", tx.suggest_terms_pdf(content))
        .otherwise(office)
    )


def term_table(texts: DataFrame) -> DataFrame:
    """Distinct (doc_type, term) of rows (doc_type, content).

    Contents and comments of a document may come as separate rows: the terms of joined texts
    are the terms of the parts. Distinct is partial before the shuffle.
    """
    terms = texts.select(
        "doc_type", F.explode_outer(completion_terms(F.col("content"), F.col("doc_type"))).alias("term")
    )
    return terms.where(F.col("term").isNotNull()).distinct()


def write_terms(terms: DataFrame, path: str) -> None:
    """Store a term table by kind and sorted by term, so that a prefix reads few row groups."""
    (
        terms.repartitionByRange("doc_type", "term")
        .sortWithinPartitions("doc_type", "term")
        .write.mode("overwrite")
        .partitionBy("doc_type")
        .parquet(path)
    )


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, doc_type string").parquet(path)


def kind_rank(kind: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KIND_NAMES])
    return F.array_position(names, kind)


def suggest(terms: DataFrame, prefix: str, kinds: Sequence[str] = KIND_NAMES,
            case_sensitive: bool = False, size: int = SUGGESTIONS, main: str = INDEX_NAME) -> DataFrame:
    """Up to ``size`` terms with the prefix and the indices they occur in.

    Every chosen index offers its first ``size`` terms, indices take turns in fixed order, equal
    terms are grouped and the first ``size`` groups stay. Terms are lower-case, so an upper-case
    prefix only finds something when it is lowered (the default).
    """
    wanted = prefix if case_sensitive else prefix.lower()
    matching = terms.where(F.col("doc_type").isin(*kinds) & F.col("term").startswith(wanted))
    per_index = Window.partitionBy("doc_type").orderBy("term")
    offered = matching.withColumn("_n", F.row_number().over(per_index)).where(F.col("_n") <= size)
    return grouped_suggestions(offered, size, main)


def grouped_suggestions(offered: DataFrame, size: int, main: str) -> DataFrame:
    """The first ``size`` terms of what the indices offer: rows (doc_type, term, _n)."""
    ranked = offered.withColumn("_rank", kind_rank(F.col("doc_type")))
    grouped = ranked.groupBy(F.col("term").alias("label")).agg(
        F.min(F.struct("_rank", "_n")).alias("_first"),
        F.sort_array(F.collect_set(F.struct("_rank", "doc_type"))).alias("_kinds"),
    )
    names = F.transform("_kinds", lambda k: index_name(main, k["doc_type"]))
    return grouped.orderBy("_first").limit(size).select("label", names.alias("index_names"))


# --- the prefix table -----------------------------------------------------------------------

# Longer prefixes have few terms and are looked up in the sorted term table.
LONGEST_PREFIX = 24
# Terms with so many first letters in common are ordered in one task.
GROUP_LETTERS = 3
PREFIX_SCHEMA = "prefix string, terms array<string>, doc_type string"


def offering_prefixes(terms: DataFrame, size: int = SUGGESTIONS) -> DataFrame:
    """(doc_type, term, prefix): every term with those of its prefixes that it may be among the first ``size`` terms of.

    The terms of a prefix follow each other in order, so a term is none of the first for prefixes it shares
    with the term ``size`` places before it. Terms are ordered within groups of the same first letters.
    """
    ends = F.sequence(F.lit(0), F.least(F.length("term"), F.lit(LONGEST_PREFIX)))
    group = Window.partitionBy("doc_type", F.substring("term", 1, GROUP_LETTERS)).orderBy("term")
    placed = terms.select("doc_type", "term").distinct().withColumn("_before", F.lag("term", size).over(group))

    def start(term: str, n: Column) -> Column:
        return F.substr(term, F.lit(1), n)

    offering = F.filter(ends, lambda n: F.col("_before").isNull() | (start("term", n) != start("_before", n)))
    return placed.select("doc_type", "term", F.explode(F.transform(offering, lambda n: start("term", n))).alias("prefix"))


def prefix_table(terms: DataFrame, size: int = SUGGESTIONS) -> DataFrame:
    """(doc_type, prefix, terms): the first ``size`` terms of every prefix of up to `LONGEST_PREFIX` letters.

    The empty prefix and single letters hold a large share of all terms; what several groups offer for
    them is ranked at last, and every task keeps its own first terms before the shuffle.
    """
    order = Window.partitionBy("doc_type", "prefix").orderBy("term")
    first = offering_prefixes(terms, size).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size)
    return first.groupBy("doc_type", "prefix").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def merged_prefixes(tables: Sequence[DataFrame], size: int = SUGGESTIONS) -> DataFrame:
    """One prefix table for several: the first ``size`` of the union are the first of their first ones.

    The order of merging does not matter, so parts of a corpus can be added as they come.
    """
    together = reduce(lambda a, b: a.unionByName(b), [t.select("doc_type", "prefix", "terms") for t in tables])
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))), 1, size)
    return together.groupBy("doc_type", "prefix").agg(best.alias("terms"))


def without_terms(table: DataFrame, gone: DataFrame, left: DataFrame, size: int = SUGGESTIONS) -> DataFrame:
    """The prefix table after terms (doc_type, term) have gone for good; ``left`` are the terms that are left.

    Only prefixes that offered a gone term are made anew.
    """
    ends = F.sequence(F.lit(0), F.least(F.length("term"), F.lit(LONGEST_PREFIX)))
    touched = gone.select("doc_type", F.explode(F.transform(ends, lambda n: F.substr("term", F.lit(1), n))).alias("prefix")).distinct()
    kept = table.join(touched, ["doc_type", "prefix"], "left_anti").select("doc_type", "prefix", "terms")
    anew = prefix_table(left, size).join(touched, ["doc_type", "prefix"], "left_semi")
    return kept.unionByName(anew.select("doc_type", "prefix", "terms"))


def write_prefixes(table: DataFrame, path: str) -> None:
    """Store a prefix table by kind and sorted by prefix, so that a lookup reads one row group per kind."""
    (
        table.select("prefix", "terms", "doc_type")
        .repartitionByRange("doc_type", "prefix")
        .sortWithinPartitions("doc_type", "prefix")
        .write.mode("overwrite")
        .partitionBy("doc_type")
        .parquet(path)
    )


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFIX_SCHEMA).parquet(path)


def suggest_by_table(table: DataFrame, terms: DataFrame, prefix: str, kinds: Sequence[str] = KIND_NAMES,
                     case_sensitive: bool = False, size: int = SUGGESTIONS, main: str = INDEX_NAME) -> DataFrame:
    """`suggest` by a lookup of one row per index; the table holds at least ``size`` terms per prefix."""
    wanted = prefix if case_sensitive else prefix.lower()
    if len(wanted) > LONGEST_PREFIX:
        return suggest(terms, prefix, kinds, case_sensitive, size, main)
    rows = table.where(F.col("doc_type").isin(*kinds) & (F.col("prefix") == wanted))
    offered = rows.select("doc_type", F.posexplode(F.slice("terms", 1, size)).alias("_n", "term"))
    return grouped_suggestions(offered.withColumn("_n", F.col("_n") + 1), size, main)
