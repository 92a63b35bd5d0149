"""Ranked search for many queries at once.

Joining queries with documents on a term that a third of both contain gives a share of all pairs.
Where that gets large, the exact pruning of Turtle and Flood (1995) is used: terms whose
contributions together cannot lift a document into the top k are left out of the join and only
looked up for the documents that still can get there. No query, term or document is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import scoring
from paperloom.functions import text as tx
from paperloom.operators.index import TEXT_TASK_BYTES, term_counts
from paperloom.operators.search import SCORE_DIGITS
from paperloom.plans.sizing import BROADCAST_ROW_LIMIT, broadcast_if_small, partitions_for
from paperloom.plans.skew import salted_join
from paperloom.plans.staging import stored
from paperloom.session import joined_where_dealt, shuffles_dropped

# Pairs of one (query, document) per core that are joined without pruning.
PAIRS_PER_CORE = 20_000_000
# Seed terms are the rarest of a query, until they have this many times k documents.
SEED_FACTOR = 4
# More than rounding and summation order can move a score.
MARGIN = 1e-5
# So many different query terms are named in the scan of the texts.
NAMED_TERMS = 10_000


def batch_counts(docs: DataFrame, text: Column, query_terms: DataFrame, key: str) -> DataFrame:
    """Term counts of the terms any query asks for; other tokens are dropped before the shuffle.

    Texts are read once: what queries ask for is written, a text of these tokens per document, and that
    is dealt out by document for each use. Of very many terms the whole texts are.
    """
    pairs, small = broadcast_if_small(query_terms)
    vocabulary = pairs.select("term").distinct()
    named = [r.term for r in vocabulary.limit(NAMED_TERMS + 1).collect()] if small else None
    if named is None or len(named) > NAMED_TERMS:
        return term_counts(docs, text, key, vocabulary=F.broadcast(vocabulary) if small else None)
    rows = docs.select(key, tx.tokens(text).alias("_tokens"))
    asked = F.array_join(F.filter("_tokens", lambda t: t.isin(named)), " ")
    kept = stored(rows.select(key, F.size("_tokens").alias("dl"), asked.alias("_asked")), "asked")
    dealt = kept.where(F.col("_asked") != "").repartition(partitions_for(docs, TEXT_TASK_BYTES), key)
    terms = dealt.select(key, "dl", F.explode(F.split("_asked", " ")).alias("term"))
    return terms.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def search_batch(counts: DataFrame, query_terms: DataFrame, doc_stats: DataFrame, k: int,
                 key: str = "id", pair_limit: int | None = None) -> DataFrame:
    """Top ``k`` documents of every query: query_id, key, score, rank.

    ``counts`` holds (key, dl, term, tf) per document and term, ``query_terms`` the distinct
    (query_id, term) pairs, ``doc_stats`` one row (n_docs, sum_dl).
    """
    spark = counts.sparkSession
    if pair_limit is None:
        pair_limit = PAIRS_PER_CORE * spark.sparkContext.defaultParallelism
    with shuffles_dropped(spark):
        stats = doc_stats.first()
    n_docs, average = stats["n_docs"], (stats["sum_dl"] or 0) / max(stats["n_docs"], 1)
    n_pairs = query_terms.limit(BROADCAST_ROW_LIMIT + 1).count()
    small = n_pairs <= BROADCAST_ROW_LIMIT
    weighted = stored(weighted_terms(counts, query_terms, n_docs, average, small), "weighted")
    if not (small and n_pairs * n_docs <= pair_limit):
        emitted = weighted.agg(F.sum("df")).first()[0] or 0
        if emitted > pair_limit:
            return pruned_top(counts, weighted, average, k, key, small)
    return top(scores(counts, weighted, average, key, small), k, key)


def weighted_terms(counts: DataFrame, query_terms: DataFrame, n_docs: int, average: float,
                   small: bool) -> DataFrame:
    """(query_id, term, df, idf, bound): bound is the most a term adds to any document."""
    vocabulary = query_terms.select("term").distinct()
    wanted = counts.join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi")
    per_term = wanted.groupBy("term").agg(
        F.count("tf").alias("df"),
        F.max(scoring.saturation(F.col("tf"), F.col("dl"), F.lit(average))).alias("_most"),
    )
    idf = scoring.idf(F.lit(n_docs), F.col("df"))
    return query_terms.join(per_term, "term").select(
        "query_id", "term", "df", idf.alias("idf"), (idf * F.col("_most")).alias("bound")
    )


def scores(counts: DataFrame, weighted: DataFrame, average: float, key: str, small: bool) -> DataFrame:
    """Sums (query_id, key, score) over the given terms, unrounded; partial sums leave a task."""
    terms = weighted.select("query_id", "term", "idf")
    if small:
        matched = counts.join(F.broadcast(terms), "term")
    else:
        matched = salted_join(counts, terms, "term", key)
    part = F.col("idf") * scoring.saturation(F.col("tf"), F.col("dl"), F.lit(average))
    return matched.groupBy("query_id", key).agg(F.sum(part).alias("score"))


def top(found: DataFrame, k: int, key: str) -> DataFrame:
    """Best ``k`` rows per query; before the shuffle every task keeps k rows per query."""
    rounded = found.select("query_id", key, F.round("score", SCORE_DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pruned_top(counts: DataFrame, weighted: DataFrame, average: float, k: int, key: str,
               small: bool) -> DataFrame:
    """The result of plain scoring and `top`, with hot terms looked up instead of joined.

    Where counts are dealt out by document, no row per query and document moves.
    """
    # 1. A score that the k-th best document certainly reaches, from the rarest terms.
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    seeds = weighted.withColumn("_upto", F.sum("df").over(rarest)).where(
        F.col("_upto") - F.col("df") < SEED_FACTOR * k
    )
    reached = stored(
        top(scores(counts, seeds, average, key, small), k, key)
        .groupBy("query_id")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("reached")),
        "reached",
    )
    # 2. Weak terms: together they stay below that score. The others decide who is a candidate.
    weakest = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = weighted.join(reached, "query_id", "left").withColumn("_sum", F.sum("bound").over(weakest))
    marked = stored(ranked.withColumn("weak", F.col("_sum") + MARGIN < F.coalesce("reached", F.lit(0.0))), "marked")
    with joined_where_dealt(counts.sparkSession):
        return stored(top(candidate_scores(counts, marked, average, key, small), k, key), "top")


def candidate_scores(counts: DataFrame, marked: DataFrame, average: float, key: str, small: bool) -> DataFrame:
    """Scores of the documents that the terms not ``weak`` leave as candidates, with what the weak ones add to them."""
    limits = marked.groupBy("query_id").agg(
        F.first("reached").alias("reached"),
        F.coalesce(F.sum(F.when(F.col("weak"), F.col("bound"))), F.lit(0.0)).alias("_weak_sum"),
    )
    weak = marked.where("weak").select("query_id", "term", "idf")
    if small:
        limits, weak = F.broadcast(limits), F.broadcast(weak)
    strong = scores(counts, marked.where(~F.col("weak")), average, key, small)
    candidates = strong.join(limits, "query_id").where(
        F.col("score") + F.col("_weak_sum") + MARGIN >= F.coalesce("reached", F.lit(0.0))
    ).select("query_id", key, "score")
    lookups = candidates.join(weak, "query_id", "left").join(counts, [key, "term"], "left")
    part = F.col("idf") * scoring.saturation(F.col("tf"), F.col("dl"), F.lit(average))
    return lookups.groupBy("query_id", key).agg((F.first("score") + F.coalesce(F.sum(part), F.lit(0.0))).alias("score"))
