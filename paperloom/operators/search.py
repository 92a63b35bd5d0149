"""Ranked search over documents: OR, AND, NOT, phrase and prefix.

Two forms share scoring and paging. The scan form (`match_counts`) counts the few query terms
inside each row, needs no index and shuffles nothing but one row of statistics. The index form
(`postings_match_counts`) reads only the postings of the query terms.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scoring
from paperloom.functions import text as tx
from paperloom.operators.index import distinct_terms, query_terms
from paperloom.plans.columns import computed_once
from paperloom.schemas import KIND_NAMES

SCORE_DIGITS = 6


# --- matching -----------------------------------------------------------------------------


def match_counts(docs: DataFrame, text: Column, terms: Sequence[str], keys: Sequence[str],
                 field: str = "content") -> DataFrame:
    """Per row of ``docs``: the keys, length ``dl_<field>`` and counts ``tf_<field>`` (array).

    A count is the length lost by removing the term from the token array. No shuffle.
    """
    rows = computed_once(docs, list(keys), _tokens=tx.tokens(text))
    tf = [F.size("_tokens") - F.size(F.array_remove("_tokens", t)) for t in terms]
    counts = F.array(*tf) if tf else F.array().cast("array<int>")
    return rows.select(*keys, F.size("_tokens").alias(f"dl_{field}"), counts.alias(f"tf_{field}"))


def summed_match_counts(rows: DataFrame, text: Column, terms: Sequence[str], keys: Sequence[str],
                        field: str = "comments") -> DataFrame:
    """As `match_counts` for a field that is spread over several rows per document.

    Only counts are aggregated, partially before the shuffle; texts are never gathered.
    """
    counts = match_counts(rows, text, terms, keys, field)
    sums = [F.sum(F.col(f"tf_{field}")[k]).cast("int").alias(f"_tf{k}") for k in range(len(terms))]
    summed = counts.groupBy(*keys).agg(F.sum(f"dl_{field}").cast("int").alias(f"dl_{field}"), *sums)
    tf = F.array(*[F.col(f"_tf{k}") for k in range(len(terms))])
    return summed.select(*keys, f"dl_{field}", tf.alias(f"tf_{field}"))


def combine_fields(first: DataFrame, second: DataFrame, keys: Sequence[str], field: str,
                   n_terms: int) -> DataFrame:
    """Join the counts of a second field to the documents; absent counts are zero."""
    zeros = F.array(*[F.lit(0)] * n_terms)
    joined = first.join(second, list(keys), "left")
    return joined.withColumns(
        {
            f"dl_{field}": F.coalesce(f"dl_{field}", F.lit(0)),
            f"tf_{field}": F.coalesce(f"tf_{field}", zeros),
        }
    )


def corpus_match_counts(corpus: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Counts of content and comments of a corpus table whose comments are nested."""
    both = computed_once(
        corpus,
        ["doc_type", "id"],
        _c=tx.tokens(F.col("content")),
        _n=tx.tokens(tx.comments_text(F.col("comments"))),
    )

    def tf(tokens: str) -> Column:
        return F.array(*[F.size(tokens) - F.size(F.array_remove(tokens, t)) for t in terms])

    return both.select(
        "doc_type",
        "id",
        F.size("_c").alias("dl_content"),
        tf("_c").alias("tf_content"),
        F.size("_n").alias("dl_comments"),
        tf("_n").alias("tf_comments"),
    )


def postings_match_counts(postings: DataFrame, terms: Sequence[str],
                          fields: Sequence[str] = ("content", "comments")) -> DataFrame:
    """Counts from stored postings; the term filter is pushed to the sorted files.

    Groups are (doc_type, id): at most one row per field and query term each.
    """
    wanted = postings.where(F.col("term").isin(*terms) & F.col("field").isin(*fields))
    aggregates = []
    for f in fields:
        here = F.col("field") == f
        aggregates.append(F.max(F.when(here, F.col("dl"))).alias(f"dl_{f}"))
        for k, t in enumerate(terms):
            hit = here & (F.col("term") == t)
            aggregates.append(F.max(F.when(hit, F.col("tf"))).alias(f"_{f}_{k}"))
    grouped = wanted.groupBy("doc_type", "id").agg(*aggregates)
    columns = []
    for f in fields:
        columns.append(F.coalesce(f"dl_{f}", F.lit(0)).alias(f"dl_{f}"))
        tf = [F.coalesce(f"_{f}_{k}", F.lit(0)) for k in range(len(terms))]
        columns.append(F.array(*tf).alias(f"tf_{f}"))
    return grouped.select("doc_type", "id", *columns)


# --- statistics and scores ----------------------------------------------------------------


def weights_struct(n: Column, average_length: Column, frequencies: Sequence[Column]) -> Column:
    """Mean length and the weight (idf) of every term in one field."""
    return F.struct(
        average_length.alias("avgdl"), F.array(*[scoring.idf(n, df) for df in frequencies]).alias("idf")
    )


def match_weights(counts: DataFrame, n_terms: int, fields: Sequence[str],
                  keys: Sequence[str] = ()) -> DataFrame:
    """One row: per field the mean length and term weights over the given documents.

    Rows whose keys are null do not count; naming the keys keeps them in the plan (see `ranked`).
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    parts = []
    for f in fields:
        dl = F.col(f"dl_{f}")
        present = (dl > 0) & known
        df = [F.count_if((F.col(f"tf_{f}")[k] > 0) & known) for k in range(n_terms)]
        parts.append(weights_struct(F.count_if(present), F.avg(F.when(present, dl)), df).alias(f))
    return counts.agg(F.struct(*parts).alias("weights"))


def index_weights(doc_freq: DataFrame, field_stats: DataFrame, terms: Sequence[str],
                  fields: Sequence[str]) -> DataFrame:
    """The row of `match_weights` from the stored index tables: point lookups.

    Both inputs may be filtered to the selected kinds first.
    """

    def total(value: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(value))), F.lit(0))

    sizes = field_stats.agg(
        F.struct(
            *[total("n_docs", F.col("field") == f).alias(f"n_{f}") for f in fields],
            *[total("sum_dl", F.col("field") == f).alias(f"l_{f}") for f in fields],
        ).alias("s")
    )
    found = doc_freq.where(F.col("term").isin(*terms)).agg(
        *[
            total("df", (F.col("field") == f) & (F.col("term") == t)).alias(f"d_{f}_{k}")
            for f in fields
            for k, t in enumerate(terms)
        ]
    )
    row = computed_once(found, found.columns, _s=sizes.scalar())
    parts = [
        weights_struct(
            F.col(f"_s.n_{f}"),
            F.try_divide(F.col(f"_s.l_{f}"), F.col(f"_s.n_{f}")),
            [F.col(f"d_{f}_{k}") for k in range(len(terms))],
        ).alias(f)
        for f in fields
    ]
    return row.select(F.struct(*parts).alias("weights"))


def has_term(k: int, fields: Sequence[str]) -> Column:
    """Does the row contain term number ``k`` in any field?"""
    result = F.lit(False)
    for f in fields:
        result = result | (F.col(f"tf_{f}")[k] > 0)
    return result


def any_term(n_terms: int, fields: Sequence[str]) -> Column:
    result = F.lit(False)
    for k in range(n_terms):
        result = result | has_term(k, fields)
    return result


def all_terms(n_terms: int, fields: Sequence[str]) -> Column:
    result = F.lit(True)
    for k in range(n_terms):
        result = result & has_term(k, fields)
    return result


def bm25_score(weights: Column, n_terms: int, fields: Sequence[str]) -> Column:
    """BM25 summed over terms and fields; ``weights`` is the struct of `match_weights`."""
    score = F.lit(0.0)
    for f in fields:
        for k in range(n_terms):
            part = weights[f]["idf"][k] * scoring.saturation(
                F.col(f"tf_{f}")[k], F.col(f"dl_{f}"), weights[f]["avgdl"]
            )
            score = score + F.coalesce(part, F.lit(0.0))
    return score


def ranked(counts: DataFrame, n_terms: int, fields: Sequence[str], where: Column | None = None,
           weights: DataFrame | None = None) -> DataFrame:
    """Score the rows that match; the weights enter as one row by one scalar subquery.

    Without given weights the counts are needed twice, for the weights and for the scores. They
    are a few numbers per document, so they pass one shuffle that both sides read, and texts are
    read and tokenised once. The match is decided after the shuffle for the same reason.
    """
    payload = [f"{p}_{f}" for f in fields for p in ("dl", "tf")]
    keys = [c for c in counts.columns if c not in payload]
    if weights is None:
        counts = counts.repartition(*keys)
        weights = match_weights(counts, n_terms, fields, keys)
    condition = any_term(n_terms, fields) if where is None else where
    weighted = computed_once(counts, keys + payload, _w=weights.scalar(), _hit=condition).where("_hit")
    score = bm25_score(F.col("_w"), n_terms, fields)
    return weighted.select(*keys, F.round(score, SCORE_DIGITS).alias("score"))


def rank_texts(docs: DataFrame, text: Column, terms: Sequence[str], keys: Sequence[str],
               excluded: Sequence[str] = (), require_all: bool = False) -> DataFrame:
    """Rank rows by one text column; (keys, score)."""
    everything, n = [*terms, *excluded], len(terms)
    condition = all_terms(n, ["content"]) if require_all else any_term(n, ["content"])
    for k in range(n, len(everything)):
        condition = condition & ~has_term(k, ["content"])
    return ranked(match_counts(docs, text, everything, keys), n, ["content"], condition)


# --- searches on a corpus table -----------------------------------------------------------


def selected_kinds(corpus_kinds: Sequence[str] = KIND_NAMES, flags: dict[str, bool] | None = None,
                   existing: Sequence[str] | None = None) -> list[str]:
    """Kinds that are configured, whose index exists and whose flag is set."""
    flags = dict.fromkeys(KIND_NAMES, True) if flags is None else flags
    existing = KIND_NAMES if existing is None else existing
    return [k for k in KIND_NAMES if k in corpus_kinds and k in existing and flags.get(k, False)]


def select_kinds(corpus: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    """Keep the chosen kinds: a partition filter, left out altogether when all are chosen."""
    if kinds is None or set(kinds) == set(KIND_NAMES):
        return corpus
    if not kinds:
        return corpus.where(F.lit(False))
    return corpus.where(F.col("doc_type").isin(*kinds))


def matches_all(phrase: str) -> bool:
    """Whether a phrase asks for all documents."""
    return phrase.strip() in ("", "*")


def search(corpus: DataFrame, phrase: str, kinds: Sequence[str] | None = None,
           require_all: bool = False, must_not: Sequence[str] = ()) -> DataFrame:
    """Ranked hits (doc_type, id, score) of a phrase over content and comments.

    A blank phrase or ``*`` matches everything with score 1. ``must_not`` terms exclude documents.
    """
    chosen = select_kinds(corpus, kinds)
    if matches_all(phrase):
        return chosen.select("doc_type", "id", F.lit(1.0).alias("score"))
    terms = distinct_terms(phrase)
    if not terms:
        return chosen.where(F.lit(False)).select("doc_type", "id", F.lit(1.0).alias("score"))
    excluded = [t for t in must_not if t not in terms]
    fields = ("content", "comments")
    counts = corpus_match_counts(chosen, terms + excluded)
    n = len(terms)
    condition = all_terms(n, fields) if require_all else any_term(n, fields)
    for k in range(n, n + len(excluded)):
        condition = condition & ~has_term(k, fields)
    return ranked(counts, n, fields, condition)


def search_index(postings: DataFrame, doc_freq: DataFrame, field_stats: DataFrame, phrase: str,
                 kinds: Sequence[str] | None = None, require_all: bool = False,
                 must_not: Sequence[str] = ()) -> DataFrame:
    """`search` on stored index tables: reads the postings of the query terms only.

    A blank phrase or ``*`` gives every document that has a posting.
    """
    terms = distinct_terms(phrase)
    fields = ("content", "comments")
    if matches_all(phrase):
        everything = select_kinds(postings, kinds).select("doc_type", "id").distinct()
        return everything.withColumn("score", F.lit(1.0))
    if not terms:
        return postings.where(F.lit(False)).select("doc_type", "id", F.lit(1.0).alias("score"))
    excluded = [t for t in must_not if t not in terms]
    counts = postings_match_counts(select_kinds(postings, kinds), terms + excluded, fields)
    weights = index_weights(
        select_kinds(doc_freq, kinds), select_kinds(field_stats, kinds), terms, fields
    )
    n = len(terms)
    condition = all_terms(n, fields) if require_all else any_term(n, fields)
    for k in range(n, n + len(excluded)):
        condition = condition & ~has_term(k, fields)
    return ranked(counts, n, fields, condition, weights)


def page(hits: DataFrame, start: int, size: int, tie: str = "id") -> DataFrame:
    """Rows ``start`` .. ``start + size`` of the ranking; ties break on the id."""
    return hits.orderBy(F.desc("score"), F.asc(tie)).offset(start).limit(size)


def fetch_page(hits: DataFrame, start: int, size: int, tie: str = "id") -> dict:
    """A page as a mapping from id to score on the driver, in rank order.

    For pages that a person looks at; ``hits.joined`` fetches pages of any size without the driver.
    """
    return {r[tie]: r["score"] for r in page(hits, start, size, tie).select(tie, "score").collect()}


def timed_page(hits: DataFrame, phrase: str, start: int, size: int, tie: str = "id") -> tuple[dict, dict]:
    """A page (id -> score) and its information: offset, size, total, phrase, milliseconds."""
    began = time.perf_counter()
    found = fetch_page(hits, start, size, tie)
    info = search_totals(hits, phrase, start, size).first().asDict()
    return found, info | {"millis": int((time.perf_counter() - began) * 1000)}


def search_totals(hits: DataFrame, phrase: str, start: int, size: int) -> DataFrame:
    """Page information: offset, size, exact number of hits and the phrase (blank is ``*``)."""
    return hits.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(start).alias("from"),
        F.lit(size).alias("size"),
        "total",
        F.lit(phrase if phrase.strip() else "*").alias("search_phrase"),
    )


# --- phrase and prefix --------------------------------------------------------------------


def phrase_starts(tokens: Column, terms: Sequence[str]) -> Column:
    """Positions in a token array where the terms follow each other."""

    def at(token: Column, i: Column) -> Column:
        match = token == terms[0]
        for k, term in enumerate(terms[1:], start=1):
            match = match & (F.get(tokens, i + k) == term)
        return F.when(match, i)

    return F.filter(F.transform(tokens, at), lambda i: i.isNotNull())


def search_phrase(docs: DataFrame, text: Column, phrase: str, keys: Sequence[str]) -> DataFrame:
    """Rows that contain the terms of the phrase in sequence, with the number of times.

    Rows that do not even contain all terms as text are dropped before they are tokenised.
    """
    terms = query_terms(phrase)
    if not terms:
        return docs.where(F.lit(False)).select(*keys, F.lit(0).alias("phrase_freq"))
    candidates = docs
    for t in dict.fromkeys(terms):
        candidates = candidates.where(F.lower(text).contains(t))
    rows = computed_once(candidates, list(keys), _tokens=tx.tokens(text))
    found = computed_once(rows, list(keys), phrase_freq=F.size(phrase_starts(F.col("_tokens"), terms)))
    return found.where(F.col("phrase_freq") > 0)


def phrase_from_postings(postings: DataFrame, phrase: str, keys: Sequence[str]) -> DataFrame:
    """Phrase search on positions: a start counts when every slot of the phrase votes for it.

    Each posting votes for position minus slot, once per slot; votes are counted with partial
    aggregation, so neither a self-join nor a gathered position list is needed, and a phrase may
    have any number of terms. A phrase without terms matches nothing.
    """
    terms = query_terms(phrase)
    if not terms:
        return postings.where(F.lit(False)).select(*keys, F.lit(0).alias("phrase_freq"))
    slots = [F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(terms)]
    wanted = postings.where(F.col("term").isin(*dict.fromkeys(terms)))
    matching = F.filter(F.array(*slots), lambda s: s["t"] == F.col("term"))
    votes = (
        wanted.select(*keys, "positions", F.explode(matching).alias("slot"))
        .select(*keys, F.col("slot.k").alias("k"), F.explode("positions").alias("pos"))
        .select(*keys, (F.col("pos") - F.col("k")).alias("start"))
    )
    starts = votes.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("votes"))
    full = starts.where(F.col("votes") == len(terms))
    return full.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("phrase_freq"))


def search_prefix(docs: DataFrame, text: Column, prefix: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a term that starts with the prefix; every hit scores 1.

    The tokens are joined with blanks so that one native substring test decides.
    """
    candidates = docs.where(F.lower(text).contains(prefix.lower()))
    joined = F.concat(F.lit(" "), F.array_join(tx.tokens(text), " "))
    rows = computed_once(candidates, list(keys), _joined=joined)
    hits = rows.where(F.col("_joined").contains(" " + prefix.lower()))
    return hits.select(*keys, F.lit(1.0).alias("score"))
