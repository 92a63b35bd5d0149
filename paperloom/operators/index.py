"""Inverted-index tables: tokens, postings, document frequencies and field statistics.

A document is one row, so its postings are built inside the row and exploded: no shuffle, and
a term that occurs in a third of all documents is never gathered anywhere. The tables written by
`write_index` are range-partitioned by (term, id), so such a term is spread over many files while
row-group statistics still let a search read only the terms it asks for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as tx
from paperloom.plans.sizing import partitions_for

# What one task that counts terms gets, in stored bytes of its texts; its hash table is some fifty times as large.
TEXT_TASK_BYTES = 8 * 1024 * 1024
POSTINGS_SCHEMA = T.StructType(
    [
        T.StructField("doc_type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.IntegerType()),
        T.StructField("dl", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)


def token_rows(docs: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row per token: the keys, ``pos`` (from 0) and ``term``.

    The outer form of explode is used here and below because the inner one makes the optimizer
    add a size filter under the explode that computes the tokens a second time.
    """
    exploded = docs.select(*keys, F.posexplode_outer(tx.tokens(text)).alias("pos", "term"))
    return exploded.where(F.col("term").isNotNull())


def term_counts(docs: DataFrame, text: Column, *keys: str,
                vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per document and term: keys, ``dl``, ``term``, ``tf``.

    ``keys`` have to identify the document. Texts are dealt out by them: a text moves once instead of
    a row per term, its terms are counted where it is, and later aggregates by document need no
    shuffle. A ``vocabulary`` (column ``term``, small) drops all other tokens.
    """
    dealt = docs.repartition(partitions_for(docs, TEXT_TASK_BYTES), *keys)
    arrays = dealt.select(*keys, tx.tokens(text).alias("_tokens"))
    exploded = arrays.select(
        *keys, F.size("_tokens").alias("dl"), F.explode_outer("_tokens").alias("term")
    ).where(F.col("term").isNotNull())
    if vocabulary is not None:
        exploded = exploded.join(vocabulary, "term", "left_semi")
    return exploded.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def term_runs(docs: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row per document: keys, ``dl`` and ``runs``, an array of (term, tf, positions) sorted by term.

    Sorting the (term, position) pairs of a document puts equal terms side by side; each run of
    equal terms becomes one posting. All happens inside the row, so that the document's own
    arrays are not copied onto every posting.
    """
    pairs = docs.select(*keys, tx.tokens(text).alias("_tokens")).select(
        *keys,
        F.size("_tokens").alias("dl"),
        F.sort_array(
            F.transform("_tokens", lambda t, i: F.struct(t.alias("t"), i.alias("p")))
        ).alias("_pairs"),
    )
    starts = pairs.select(
        *keys,
        "dl",
        "_pairs",
        F.filter(
            F.when(F.col("dl") > 0, F.sequence(F.lit(1), F.col("dl"))),
            lambda i: (i == 1)
            | (F.get("_pairs", i - 1)["t"] != F.get("_pairs", i - 2)["t"]),
        ).alias("_starts"),
    )

    def run(start: Column, k: Column) -> Column:
        length = F.coalesce(F.get("_starts", k + 1), F.col("dl") + 1) - start
        return F.struct(
            F.get("_pairs", start - 1)["t"].alias("term"),
            length.alias("tf"),
            F.transform(F.slice("_pairs", start, length), lambda x: x["p"]).alias("positions"),
        )

    return starts.select(*keys, "dl", F.transform("_starts", run).alias("runs"))


def postings(docs: DataFrame, text: Column, *keys: str) -> DataFrame:
    """One row per document and term: keys, ``dl``, ``term``, ``tf``, ``positions``; no shuffle."""
    runs = term_runs(docs, text, *keys)
    return runs.select(*keys, "dl", F.inline_outer("runs")).where(F.col("term").isNotNull())


def doc_freq(counts: DataFrame, *by: str) -> DataFrame:
    """Documents per term (and whatever else is in ``by``), and occurrences altogether."""
    return counts.groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.col("tf").cast("long")).alias("total_tf")
    )


def field_stats(lengths: DataFrame, *by: str) -> DataFrame:
    """Documents that have the field and their mean length, from rows with a ``dl`` column."""
    present = lengths.where(F.col("dl") > 0)
    return present.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("dl").cast("long")).alias("sum_dl")
    )


def field_rows(corpus: DataFrame, *more: str) -> DataFrame:
    """(doc_type, id, ``more``, field, text): content and comments of every document, each document read once."""
    fields = F.array(
        F.struct(F.lit("content").alias("field"), F.col("content").alias("text")),
        F.struct(F.lit("comments").alias("field"), tx.comments_text(F.col("comments")).alias("text")),
    )
    return corpus.select("doc_type", "id", *more, F.inline(fields))


def corpus_postings(corpus: DataFrame) -> DataFrame:
    """Postings of content and comments of a corpus table, in `POSTINGS_SCHEMA` order."""
    return postings(field_rows(corpus), F.col("text"), "doc_type", "id", "field").select(
        *POSTINGS_SCHEMA.fieldNames()
    )


def write_index(corpus: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write postings, document frequencies and field statistics of a corpus below ``path``.

    Postings are stored as they come first, since finding the ranges reads its input a second
    time and texts should be tokenised once.
    """
    spark = corpus.sparkSession
    corpus_postings(corpus).write.mode("overwrite").parquet(f"{path}/unsorted")
    write_sorted_postings(spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/unsorted"), path, partitions)


def write_sorted_postings(postings_table: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the index tables of stored postings.

    Files are split by (field, term, id) ranges: hot terms spread over several files.
    """
    spark = postings_table.sparkSession
    n = partitions or partitions_for(postings_table)
    (
        postings_table.repartitionByRange(n, "field", "term", "id")
        .sortWithinPartitions("field", "term", "id")
        .write.mode("overwrite")
        .partitionBy("field")
        .parquet(f"{path}/postings")
    )
    stored = read_postings(spark, path)
    (
        doc_freq(stored.select("doc_type", "field", "term", "tf"), "doc_type", "field")
        .repartitionByRange("field", "term")
        .sortWithinPartitions("field", "term")
        .write.mode("overwrite")
        .parquet(f"{path}/doc_freq")
    )
    # dl repeats on every posting of a document; the row with its first position stands for it.
    lengths = stored.where(F.get("positions", F.lit(0)) == 0).select("doc_type", "field", "dl")
    field_stats(lengths, "doc_type", "field").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/field_stats"
    )


def updated_postings(stored: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Stored postings after a run: those of changed documents anew, those of removed ids gone.

    Only changed documents are tokenised. ``changed`` are corpus rows, ``removed`` has ``id``.
    """
    stale = changed.select("id").unionByName(removed.select("id")).distinct()
    kept = stored.join(stale, "id", "left_anti").select(*POSTINGS_SCHEMA.fieldNames())
    return kept.unionByName(corpus_postings(changed))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/postings")


def read_doc_freq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/doc_freq")


def read_field_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/field_stats")


def query_terms(phrase: str) -> list[str]:
    """Terms of a search phrase under the rule of `paperloom.functions.text.tokens`."""
    return [t for t in re.split(r"\W+", phrase.lower()) if t]


def distinct_terms(phrase: str | Sequence[str]) -> list[str]:
    terms = query_terms(phrase) if isinstance(phrase, str) else list(phrase)
    return list(dict.fromkeys(terms))
