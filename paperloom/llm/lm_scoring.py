"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, broadcast in shards.

Counting: each task tokenises its texts, counts the hashes of its words and n-grams in arrays and sends each
shard of the hash space one sorted run per group of texts, so a frequent word arrives once per group, however
often it occurs. A shard's task merges the runs. Its words keep exact counts, for the base score. Its n-grams
go into a Bloom filter (Talbot and Osborne 2007): an n-gram of count c is stored as ``1 + floor(log2 c)``
entries (n-gram, 1), (n-gram, 2), ..., so common n-grams cost few bits and a count can only be read too high, with a
chance that halves ``HASHES`` times per step.

Scoring: the number of shards follows the input, so a shard is of bounded size; each is broadcast on its own,
and a task probes one shard after the other for the distinct n-grams of a group of texts: level 1, 2, ... until one is
missing. The last level gives the expected count, and probabilities are smoothed down the orders,
``p_n = (c_n + M p_(n-1)) / (c_context + M)``, ending in the base model. Memory does not grow with the corpus; what
a group of texts reads does (all shards once).

Defined cases: a null or empty text is its end token alone; a null id is never held out; repeated rows are scored
(and, unless held out, learnt) each; with no training rows all scores are those of the smoothing alone; an empty
table gives an empty result; very long texts are handled in overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import (
    WordHashes, broadcast_blocks, gram_hashes, mixed, released, slices, stored, texts,
)

ORDER = 2
# Weight of the lower order against the counts of an n-gram's context.
WEIGHT = 300.0
HASHES = 6
# Text bytes per shard; a shard then holds at most so many word and n-gram entries, by far fewer as a rule.
SHARD_BYTES = 32 << 20
# Tokens of the texts that are counted or scored together.
GROUP_TOKENS = 2_000_000

_END = b"\n"
MODEL = "shard int, words binary, counts binary, bits binary, n_tokens long, n_words long"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash; grows with the hash, so sorted hashes fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log2 c)."""
    return np.frexp(counts.astype(float))[1]


def expected_count(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    high = np.exp2(level)
    return np.where(level > 0, (high / 2 + high - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    a = mixed(keys + np.uint64(level))
    b = mixed(a) | np.uint64(1)
    for _ in range(HASHES):
        yield a % np.uint64(bits)
        a = a + b


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The packed filter of n-gram hashes with their counts."""
    level = levels(counts)
    entries = int(level.sum())
    bits = -(-max(64, int(entries * HASHES / np.log(2))) // 8) * 8
    flags = np.zeros(bits, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        for place in _places(keys[level >= k], k, bits):
            flags[place] = True
    return np.packbits(flags)


def probe(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The stored level of each key, by probing level after level until one is missing."""
    level = np.zeros(len(keys), np.int64)
    live, k = np.arange(len(keys)), 0
    while len(live):
        k += 1
        there = np.ones(len(live), bool)
        for place in _places(keys[live], k, len(packed) * 8):
            there &= (packed[place >> np.uint64(3)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1
        live = live[there]
        level[live] = k
    return level


def _groups(stream, order: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, token hashes, row of each token, tokens already seen as history) in groups of bounded size."""
    hashes = WordHashes()
    for batch in slices(stream, column):
        parts, rows, old, size = [], [], [], 0
        for row, text in enumerate(texts(batch.column(column))):
            tokens = hashes.of([*text.lower().split(), _END])
            for at in range(0, len(tokens), GROUP_TOKENS):
                before = min(at, order - 1)
                part = tokens[at - before : at + GROUP_TOKENS]
                parts.append(part)
                rows.append(np.full(len(part), row))
                old.append(np.arange(len(part)) < before)
                size += len(part)
                if size >= GROUP_TOKENS:
                    yield batch, *map(np.concatenate, (parts, rows, old))
                    parts, rows, old, size = [], [], [], 0
        if parts:
            yield batch, *map(np.concatenate, (parts, rows, old))


def _grams(tokens: np.ndarray, rows: np.ndarray, old: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside one text, and the place of each one's last token."""
    last = np.arange(n - 1, len(tokens))
    inside = (rows[last] == rows[last - n + 1]) & ~old[last]
    return mixed(gram_hashes(tokens, n)[inside] + np.uint64(n)), last[inside]


def _count(order: int, shards: int):
    def run(stream):
        held: list[tuple[list, list, int]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for words in (True, False):
                keys = np.concatenate([k for w, k, _ in held if w is words])
                counts = np.concatenate([c for w, _, c in held if w is words])
                yield _runs_of(words, *summed(keys, counts), shards)

        size = 0
        for _, tokens, rows, old in _groups(stream, order, 0):
            held.append((True, *np.unique(tokens[~old], return_counts=True)))
            for n in range(2, order + 1):
                held.append((False, *np.unique(_grams(tokens, rows, old, n)[0], return_counts=True)))
            size += len(tokens)
            if size >= GROUP_TOKENS:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    return run


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _runs_of(words: bool, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row per shard: its sorted keys and their counts."""
    edges = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1).astype(np.uint64))
    wide = counts.astype("<i4") if counts.max(initial=0) < 1 << 31 else counts.astype("<i8")
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array(np.full(len(full), words)),
            pa.array([keys[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary()),
            pa.array([wide[edges[s] : edges[s + 1]].tobytes() for s in full], pa.binary()),
            pa.array(np.full(len(full), wide.itemsize, np.int32)),
        ],
        ["shard", "word", "keys", "counts", "width"],
    )


RUNS = "shard int, word boolean, keys binary, counts binary, width int"


def _merge(stream):
    """A shard's runs become its exact word counts and its filter; runs are merged as they come."""
    shard, held = None, {}

    def made() -> pa.RecordBatch:
        merged = {w: summed(*map(np.concatenate, zip(*held.get(w, [_NONE]), strict=True))) for w in (True, False)}
        words, counts = merged[True]
        bits = build_filter(*merged[False])
        values = (shard, words.tobytes(), counts.astype("<i8").tobytes(), bits.tobytes(), int(counts.sum()), len(words))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in MODEL.split(", ")]
        )

    for batch in stream:
        for row in zip(*batch.columns, strict=True):
            if row[0].as_py() != shard:
                if shard is not None:
                    yield made()
                shard, held = row[0].as_py(), {}
            keys = np.frombuffer(row[2].as_buffer(), np.uint64)
            counts = np.frombuffer(row[3].as_buffer(), f"<i{row[4].as_py()}").astype(np.int64)
            own = held.setdefault(row[1].as_py(), [])
            own.append((keys, counts))
            if len(own) >= 32:
                own[:] = [summed(*map(np.concatenate, zip(*own, strict=True)))]
    if shard is not None:
        yield made()


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class NgramModel:
    """A trained model: one broadcast per shard, the number of tokens and of distinct words."""

    def __init__(self, shards: int, order: int, blocks: list, n_tokens: int, n_words: int):
        self.shards, self.order, self.blocks = shards, order, blocks
        self.n_tokens, self.n_words = n_tokens, n_words


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> NgramModel:
    """Count all texts and broadcast the model."""
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1
    runs = source.mapInArrow(_count(order, shards), RUNS)
    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard")
    model = stored(dealt.mapInArrow(_merge, MODEL), "lm")
    n_tokens, n_words = model.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    rows = model.select("shard", "words", "counts", "bits").toLocalIterator()
    blocks = broadcast_blocks(spark.sparkContext, ((r[0], bytes(r[1]), bytes(r[2]), bytes(r[3])) for r in rows))
    return NgramModel(shards, order, blocks, n_tokens or 0, n_words or 0)


def _look_up(model: NgramModel, blocks: list, words: np.ndarray, grams: list[np.ndarray]) -> tuple:
    """Exact counts of sorted distinct words and expected counts of sorted distinct n-grams."""
    counts = np.zeros(len(words), np.int64)
    found = [np.zeros(len(g)) for g in grams]
    edge = np.arange(model.shards + 1).astype(np.uint64)
    cut = np.searchsorted(shard_of(words, model.shards), edge)
    cuts = [np.searchsorted(shard_of(g, model.shards), edge) for g in grams]
    for block in blocks:
        for shard, own, n, bits in released(block):
            own, n = np.frombuffer(own, np.uint64), np.frombuffer(n, "<i8")
            mine = words[cut[shard] : cut[shard + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                counts[cut[shard] : cut[shard + 1]] = np.where(own[at] == mine, n[at], 0)
            packed = np.frombuffer(bits, np.uint8)
            for g, c, out in zip(grams, cuts, found, strict=True):
                level = probe(packed, g[c[shard] : c[shard + 1]])
                out[c[shard] : c[shard + 1]] = expected_count(level)
    return counts, found


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score and score (log10 of the text's probability)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks, order = model.blocks, model.order
    small = NgramModel(model.shards, order, [], model.n_tokens, model.n_words)

    def run(stream):
        scale = small.n_tokens + 0.5 * (small.n_words + 1)
        last, sums = None, None

        def made(batch, sums) -> pa.RecordBatch:
            n, known = (pa.array(s.astype(np.int64)) for s in sums[:2])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), n, known, pa.array(sums[2]), pa.array(sums[3])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch, tokens, rows, old in _groups(stream, order, 1):
            if batch is not last:
                if last is not None:
                    yield made(last, sums)
                last, sums = batch, np.zeros((4, batch.num_rows))
            words, word = np.unique(tokens, return_inverse=True)
            grams = [_grams(tokens, rows, old, n) for n in range(2, order + 1)]
            distinct = [np.unique(g, return_inverse=True) for g, _ in grams]
            counts, found = _look_up(small, blocks, words, [d for d, _ in distinct])
            own = counts[word].astype(float)
            base = (own + 0.5) / scale
            p, context = base.copy(), np.concatenate([[0.0], own[:-1]])
            for (_, place), (_, inverse), expected in zip(grams, distinct, found, strict=True):
                seen = np.zeros(len(tokens))
                seen[place] = np.minimum(expected[inverse], context[place])
                p[place] = (seen[place] + WEIGHT * p[place]) / (context[place] + WEIGHT)
                context = np.concatenate([[0.0], seen[:-1]])
            new = ~old
            for k, values in enumerate((np.ones(len(tokens)), own > 0, np.log10(base), np.log10(p))):
                sums[k] += np.bincount(rows[new], values[new], batch.num_rows)
        if last is not None:
            yield made(last, sums)

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and score all."""
    model = train(docs.filter(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def brute_force(docs: list[tuple], order: int = ORDER) -> dict:
    """The contract's exact columns, and the smoothed score from exact counts, for tests."""
    import zlib
    from collections import Counter
    from math import log10

    out, held, tokens = {}, {}, {}
    words: Counter = Counter()
    grams: Counter = Counter()
    for d, t in docs:
        held[d] = d is not None and zlib.crc32(str(d).encode()) % 5 == 1
        tokens[d] = [*(t or "").encode().lower().split(), _END]
        if not held[d]:
            words.update(tokens[d])
            for n in range(2, order + 1):
                grams.update(tuple(tokens[d][k : k + n]) for k in range(len(tokens[d]) - n + 1))
    total, scale = sum(words.values()), sum(words.values()) + 0.5 * (len(words) + 1)
    for d, own in tokens.items():
        base, smooth = 0.0, 0.0
        for k, w in enumerate(own):
            p = (words[w] + 0.5) / scale
            base += log10(p)
            for n in range(2, min(order, k + 1) + 1):
                context = words[own[k - 1]] if n == 2 else grams[tuple(own[k - n + 1 : k])]
                p = (grams[tuple(own[k - n + 1 : k + 1])] + WEIGHT * p) / (context + WEIGHT)
            smooth += log10(p)
        out[d] = (held[d], len(own), sum(words[w] > 0 for w in own), total, base, smooth)
    return out
