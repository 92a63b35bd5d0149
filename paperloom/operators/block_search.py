"""Searches on the block index: the best k by block bounds, and boolean searches in one pass.

`best` skips blocks (Ding and Suel 2011; Chakrabarti, Chaudhuri and Ganti 2011): the heads of the
query terms' blocks add up to a bound per interval; the intervals of the highest bounds are scored
first, and only intervals whose bound reaches the k-th score found there are read besides.

`search` evaluates nested clauses. Every leaf of the clause has one bit; a posting sets the bits of
the leaves it satisfies, one aggregate per document joins them, and the clause is decided on the
bits. Texts are not read, and documents without a posting of any leaf do not take part, unless the
clause also holds for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import scoring
from paperloom.operators.block_index import GRAM, TERM_END, TERM_START, BlockIndex
from paperloom.operators.index import distinct_terms, query_terms
from paperloom.operators.search import SCORE_DIGITS, index_weights, matches_all, select_kinds
from paperloom.plans.columns import computed_once
from paperloom.plans.sizing import for_hash_join
from paperloom.plans.staging import stored

FIELDS = ("content", "comments")
# Intervals that are scored first, per wanted document; each has one matching document at least.
SEEDS_PER_HIT = 4
# Up to so many intervals are named in the scan's filter, where they skip row groups; more are joined.
NAMED_INTERVALS = 1_000
# The same for the terms that fit a pattern.
NAMED_TERMS = 1_000
# More than rounding and summation order can move a score.
MARGIN = 1e-5
# Leaves per word of the bit set.
WORD_BITS = 62


# --- the best k ----------------------------------------------------------------------------


def best(index: BlockIndex, phrase: str, k: int, kinds: Sequence[str] | None = None, require_all: bool = False) -> DataFrame:
    """The ``k`` best hits of a phrase: doc_type, id, score, rank; as plain scoring gives them.

    Ties break on the id. With ``require_all`` an interval needs a block of every term. A phrase
    without terms has no hits; blank phrases, which match everything alike, are for `search`.
    """
    terms = distinct_terms(phrase)
    blocks = select_kinds(index.table("blocks"), kinds).where(F.col("term").isin(*terms) & F.col("field").isin(*FIELDS))
    impact = impacts(index, terms, kinds)

    def scored(chosen: DataFrame) -> DataFrame:
        parts = index.postings(chosen).select("doc_type", "id", "term", impact("tf", "dl").alias("part"))
        sums = parts.groupBy("doc_type", "id").agg(F.sum("part").alias("s"), F.size(F.collect_set("term")).alias("n"))
        matching = sums.where(F.col("n") == len(terms)) if require_all else sums
        ranked = matching.select("doc_type", "id", F.round("s", SCORE_DIGITS).alias("score"))
        return ranked.orderBy(F.desc("score"), F.asc("id")).limit(k)

    bounds = interval_bounds(blocks, impact, len(terms) if require_all else 1)
    seeds = SEEDS_PER_HIT * k
    high = bounds.orderBy(F.desc("bound")).limit(max(seeds, NAMED_INTERVALS) + 1).collect()
    first = scored(in_named(blocks, high[:seeds])).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    reached = first["least"] - MARGIN if first["n"] == k else 0.0
    named = [r for r in high if r["bound"] >= reached]
    if len(named) <= NAMED_INTERVALS:
        chosen = in_named(blocks, named)
    else:
        wanted = bounds.where(F.col("bound") >= reached).select("doc_type", "interval")
        chosen = blocks.join(wanted, ["doc_type", "interval"], "left_semi")
    order = Window.orderBy(F.desc("score"), F.asc("id"))  # over k rows
    return scored(chosen).select("doc_type", "id", "score", F.row_number().over(order).alias("rank"))


def _weights(index: BlockIndex, terms: Sequence[str], kinds: Sequence[str] | None) -> DataFrame:
    """Mean lengths and term weights. The signed counts of all layers are summed with the lookup."""
    return index_weights(select_kinds(index.table("doc_freq"), kinds), select_kinds(index.table("field_stats"), kinds), terms, FIELDS)


def impacts(index: BlockIndex, terms: Sequence[str], kinds: Sequence[str] | None = None) -> Callable[[str, str], Column]:
    """What a posting adds to a score, from its columns of frequency and length.

    Weights and mean lengths are a few numbers, looked up once for all steps of a search.
    """
    counts = select_kinds(index.table("doc_freq"), kinds).where(F.col("term").isin(*terms)).select("field", "term", F.col("df").alias("n"), F.lit(0).cast("long").alias("dl"))
    sizes = select_kinds(index.table("field_stats"), kinds).select("field", F.lit("").alias("term"), F.col("n_docs").alias("n"), F.col("sum_dl").alias("dl"))
    found = counts.unionByName(sizes).groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()
    size = {r["field"]: r for r in found if not r["term"] and r["n"]}
    idf = {
        r["field"] + " " + r["term"]: log1p((size[r["field"]]["n"] - r["n"] + 0.5) / (r["n"] + 0.5))
        for r in found if r["term"] and r["n"] and r["field"] in size
    }
    mean = {f: r["dl"] / r["n"] for f, r in size.items()}
    if not idf:
        return lambda tf, dl: F.lit(0.0)
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    average = F.create_map(*[F.lit(x) for pair in mean.items() for x in pair])

    def impact(tf: str, dl: str) -> Column:
        part = F.try_element_at(weight, F.concat_ws(" ", "field", "term")) * scoring.saturation(
            F.col(tf), F.col(dl), F.try_element_at(average, F.col("field"))
        )
        return F.coalesce(part, F.lit(0.0))

    return impact


def interval_bounds(blocks: DataFrame, impact: Callable[[str, str], Column], least_terms: int = 1) -> DataFrame:
    """(doc_type, interval, bound): no document of the interval scores higher; from the heads alone.

    Layers may each have a block of a term in an interval; the higher bound stands for both.
    """
    keys = ["doc_type", "interval"]
    per_term = blocks.groupBy(*keys, "field", "term").agg(F.max(impact("max_tf", "min_dl")).alias("b"))
    sums = per_term.groupBy(*keys).agg(F.sum("b").alias("bound"), F.size(F.collect_set("term")).alias("terms"))
    return sums.where(F.col("terms") >= least_terms).select(*keys, "bound")


def in_named(blocks: DataFrame, named: Sequence) -> DataFrame:
    """The blocks of a few intervals, named in a filter that lets the scan skip row groups."""
    by_kind: dict[str, list[int]] = {}
    for r in named:
        by_kind.setdefault(r["doc_type"], []).append(r["interval"])
    tests = [(F.col("doc_type") == k) & F.col("interval").isin(*v) for k, v in sorted(by_kind.items())]
    return blocks.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


# --- clauses -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """Documents with a term; scored by BM25 in both fields. A text of several terms needs all of them."""

    text: str


@dataclass(frozen=True)
class Phrase:
    """Documents with the terms of a text in sequence, within one field."""

    text: str


@dataclass(frozen=True)
class Prefix:
    """Documents with a term that starts with a text; scores 1."""

    text: str


@dataclass(frozen=True)
class Wildcard:
    """Documents with a term that fits a pattern: ``*`` any characters, ``?`` one; scores 1."""

    pattern: str


@dataclass(frozen=True)
class Everything:
    """All documents; scores 1."""


@dataclass(frozen=True)
class All:
    """Documents of every clause."""

    clauses: tuple


@dataclass(frozen=True)
class AnyOf:
    """Documents of at least one clause."""

    clauses: tuple


@dataclass(frozen=True)
class Not:
    """Documents outside a clause; adds nothing to the score."""

    clause: object


def phrase_clause(phrase: str) -> object:
    """A search phrase: any of its terms; blank or ``*`` is everything."""
    return Everything() if matches_all(phrase) else AnyOf(tuple(Term(t) for t in distinct_terms(phrase)))


def search(index: BlockIndex, clause: object, kinds: Sequence[str] | None = None) -> DataFrame:
    """Hits (doc_type, id, score) of a clause over content and comments.

    The score adds up over all leaves that are not below a `Not` and that the document satisfies.
    A text without any term satisfies nothing.
    """
    leaves = _Leaves(clause)
    postings = _wanted(index, leaves, kinds)
    words = [
        F.bit_or(F.when(F.col("_word") == w, F.col("_bits")).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}")
        for w in range(leaves.words)
    ]
    met = postings.groupBy("doc_type", "id").agg(*words, *leaves.aggregates())
    if leaves.holds_for_nothing(clause):
        met = select_kinds(index.documents(), kinds).join(met, ["doc_type", "id"], "left")
    found = computed_once(met, ["doc_type", "id"], hit=leaves.condition(clause), **leaves.carried()).where("hit")
    weighted = found.withColumn("_w", _weights(index, leaves.scored_terms or ["-"], kinds).scalar())
    return weighted.select("doc_type", "id", F.round(leaves.score(F.col("_w")), SCORE_DIGITS).alias("score"))


def _wanted(index: BlockIndex, leaves: _Leaves, kinds: Sequence[str] | None) -> DataFrame:
    """Posting rows of all leaves with (word, bits); a posting has one row per word of leaves it satisfies."""
    blocks = select_kinds(index.table("blocks"), kinds).where(F.col("field").isin(*FIELDS))
    term = F.col("term")
    simple = [(i, test) for i, test in leaves.tests(term)]
    read = blocks.where(reduce(lambda a, b: a | b, [t for _, t in simple], F.lit(False)))
    tagged = [read.withColumn("_set", _bit_rows(simple, leaves.words))]
    for i, pattern in leaves.patterns():
        # Few matching terms are named in the scan's filter, where they skip row groups; more are joined.
        terms = stored(matching_terms(index.table("grams"), index.table("doc_freq"), pattern), "terms")
        named = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
        if len(named) <= NAMED_TERMS:
            chosen = blocks.where(term.isin(*named))
        else:
            chosen = blocks.join(for_hash_join(terms), "term", "left_semi").select(*blocks.columns)
        bit = F.array(F.struct(F.lit(i // WORD_BITS).alias("w"), F.lit(1 << i % WORD_BITS).cast("long").alias("b")))
        tagged.append(chosen.withColumn("_set", bit))
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    each = rows.select("doc_type", "field", "term", "layer", "_set", F.inline("docs"))
    live = index.live(each)
    return live.select("doc_type", "id", "field", "term", "tf", "dl", "positions", F.explode("_set").alias("s")).select(
        "doc_type", "id", "field", "term", "tf", "dl", "positions", F.col("s.w").alias("_word"), F.col("s.b").alias("_bits")
    )


def _bit_rows(simple: list[tuple[int, Column]], words: int) -> Column:
    """The words of the bit set that a term's leaves fill; phrases set no bit but are read, so no word is left out."""
    sums = []
    for w in range(words):
        bits = F.lit(0).cast("long")
        for i, test in simple:
            if i // WORD_BITS == w:
                bits = bits + F.when(test, F.lit(1 << i % WORD_BITS).cast("long")).otherwise(F.lit(0).cast("long"))
        sums.append(F.struct(F.lit(w).alias("w"), bits.alias("b")))
    return F.filter(F.array(*sums), lambda s: (s["b"] != 0) | (s["w"] == 0))


def _starts(slot: int) -> Column:
    """Where a phrase would start whose term in this slot stands at the posting's positions."""
    return F.transform("positions", lambda p: p - F.lit(slot))


class _Leaves:
    """The leaves of a clause in order, with what each needs from the postings."""

    def __init__(self, clause: object):
        self.leaves: list = []
        self.scored: set[int] = set()
        self._collect(clause, True)
        self.words = max(1, -(-len(self.leaves) // WORD_BITS))
        slots = [t for i in sorted(self.scored) for t in self.terms(i)]
        self.scored_terms = list(dict.fromkeys(slots))

    def _collect(self, clause: object, counts: bool) -> None:
        if isinstance(clause, All | AnyOf):
            for c in clause.clauses:
                self._collect(c, counts)
        elif isinstance(clause, Not):
            self._collect(clause.clause, False)
        else:
            if isinstance(clause, Term) and len(query_terms(clause.text)) > 1:
                for t in distinct_terms(clause.text):
                    self._collect(Term(t), counts)
                return
            if clause not in self.leaves:
                self.leaves.append(clause)
            if counts:
                self.scored.add(self.leaves.index(clause))

    def terms(self, i: int) -> list[str]:
        leaf = self.leaves[i]
        return query_terms(leaf.text) if isinstance(leaf, Term | Phrase) else []

    def tests(self, term: Column) -> list[tuple[int, Column]]:
        """Per leaf of terms, phrases and prefixes whether it wants a posting's term."""
        found = []
        for i, leaf in enumerate(self.leaves):
            if isinstance(leaf, Prefix):
                found.append((i, term.startswith(leaf.text.lower()) if leaf.text else F.lit(True)))
            elif isinstance(leaf, Term | Phrase) and self.terms(i):
                found.append((i, term.isin(*dict.fromkeys(self.terms(i)))))
        return found

    def patterns(self) -> list[tuple[int, str]]:
        return [(i, leaf.pattern) for i, leaf in enumerate(self.leaves) if isinstance(leaf, Wildcard)]

    def aggregates(self) -> list[Column]:
        """Lengths and frequencies of scored terms, and the votes for the starts of phrases, per field."""
        found = []
        for f in FIELDS:
            here = F.col("field") == f
            found.append(F.max(F.when(here, F.col("dl"))).alias(f"_dl_{f}"))
            for k, t in enumerate(self.scored_terms):
                found.append(F.max(F.when(here & (F.col("term") == t), F.col("tf"))).alias(f"_tf_{f}_{k}"))
            for i, leaf in enumerate(self.leaves):
                if isinstance(leaf, Phrase):
                    starts = F.array().cast("array<int>")
                    for slot, t in enumerate(self.terms(i)):
                        starts = F.when(F.col("term") == t, F.concat(starts, _starts(slot))).otherwise(starts)
                    voting = F.when(here & (F.col("_word") == 0) & (F.size(starts) > 0), F.struct("term", starts.alias("v")))
                    found.append(F.sort_array(F.flatten(F.collect_set(voting)["v"])).alias(f"_v_{f}_{i}"))
        return found

    def carried(self) -> dict[str, Column]:
        """What the score needs from the aggregates."""
        kept = {f"_dl_{f}": F.col(f"_dl_{f}") for f in FIELDS}
        for f in FIELDS:
            kept |= {f"_tf_{f}_{k}": F.col(f"_tf_{f}_{k}") for k in range(len(self.scored_terms))}
            kept |= {f"_pf_{f}_{i}": self._phrase_freq(f, i) for i, x in enumerate(self.leaves) if isinstance(x, Phrase)}
        return kept | {f"_m_{i}": self._met(i) for i in sorted(self.scored)}

    def _phrase_freq(self, field: str, i: int) -> Column:
        """Full matches in a field: starts that every slot voted for. Each slot votes once for a start."""
        votes, slots = F.col(f"_v_{field}_{i}"), len(self.terms(i))
        if not slots:
            return F.lit(0)
        full = F.size(F.filter(votes, lambda v, k: F.get(votes, k + (slots - 1)) == v))
        return F.coalesce(F.greatest(full, F.lit(0)), F.lit(0))

    def _met(self, i: int) -> Column:
        leaf = self.leaves[i]
        if isinstance(leaf, Everything):
            return F.lit(True)
        if isinstance(leaf, Phrase):
            return reduce(lambda a, b: a | b, [self._phrase_freq(f, i) > 0 for f in FIELDS])
        bits = F.coalesce(F.col(f"_b{i // WORD_BITS}"), F.lit(0).cast("long"))
        return bits.bitwiseAND(F.lit(1 << i % WORD_BITS).cast("long")) != 0

    def condition(self, clause: object) -> Column:
        return self._decide(clause, self._met, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a, F.lit(True), F.lit(False))

    def holds_for_nothing(self, clause: object) -> bool:
        """Whether the clause holds for a document without any of the leaves."""
        met = lambda i: isinstance(self.leaves[i], Everything)
        return self._decide(clause, met, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a, True, False)

    def _decide(self, clause: object, met: Callable, both: Callable, either: Callable, other: Callable, yes, no):
        def decide(c: object):
            if isinstance(c, All):
                return reduce(both, map(decide, c.clauses), yes)
            if isinstance(c, AnyOf):
                return reduce(either, map(decide, c.clauses), no)
            if isinstance(c, Not):
                return other(decide(c.clause))
            if isinstance(c, Term) and len(query_terms(c.text)) > 1:
                return decide(All(tuple(Term(t) for t in distinct_terms(c.text))))
            return met(self.leaves.index(c))

        return decide(clause)

    def score(self, weights: Column) -> Column:
        """BM25 of terms and phrases (a phrase has the weight of its terms together), 1 for the other leaves."""
        total = F.lit(0.0)
        place = {t: k for k, t in enumerate(self.scored_terms)}
        for i in sorted(self.scored):
            leaf = self.leaves[i]
            if not isinstance(leaf, Term | Phrase):
                total = total + F.when(F.col(f"_m_{i}"), 1.0).otherwise(0.0)
                continue
            for f in FIELDS if self.terms(i) else ():
                idf = reduce(lambda a, b: a + b, [weights[f]["idf"][place[t]] for t in self.terms(i)])
                tf = F.col(f"_pf_{f}_{i}") if isinstance(leaf, Phrase) else F.col(f"_tf_{f}_{place[self.terms(i)[0]]}")
                part = idf * scoring.saturation(tf, F.col(f"_dl_{f}"), weights[f]["avgdl"])
                total = total + F.coalesce(part, F.lit(0.0))
        return total


# --- wildcards -----------------------------------------------------------------------------


def pattern_regex(pattern: str) -> str:
    """A wildcard pattern as a regular expression for a whole term."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower()) + r"\z"


def pattern_grams(pattern: str, size: int = GRAM) -> list[str]:
    """The k-grams that every matching term has, edge marks included."""
    pieces = re.split(r"[*?]", TERM_START + pattern.lower() + TERM_END)
    return sorted({p[i : i + size] for p in pieces for i in range(len(p) - size + 1)})


def matching_terms(grams: DataFrame, terms: DataFrame, pattern: str) -> DataFrame:
    """(term): the distinct terms that fit a pattern.

    Terms that have all grams of the pattern are found in the gram table, then tested. A pattern
    too short for any gram is tested on all terms; postings are read in neither case.
    """
    needed = pattern_grams(pattern)
    if needed:
        having = grams.where(F.col("gram").isin(*needed)).groupBy("term").agg(F.count_distinct("gram").alias("n"))
        candidates = having.where(F.col("n") == len(needed)).select("term")
    else:
        candidates = terms.select("term").distinct()
    return candidates.where(F.col("term").rlike(pattern_regex(pattern)))
