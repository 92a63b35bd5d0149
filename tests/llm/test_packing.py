"""Packing: every id once, windows full, neighbours alike."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from paperloom.llm import packing as op
from paperloom.llm.tokens import tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
PLAIN.encode_special_tokens = True


def checked(rows, pairs) -> dict:
    """Assert the contract; gives the sequences' lengths."""
    want = defaultdict(list)
    for d, t in pairs:
        want[d].append(PLAIN.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids.tolist()))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, texts in want.items():
        if len(texts) == 1:
            at = 0
            for start, n, ids in sorted(by_doc[d]):
                assert (start, n) == (at, len(texts[0])) and ids == texts[0][at : at + len(ids)]
                at += len(ids)
            assert at == len(texts[0])
        assert sum(len(p[2]) for p in by_doc[d]) == sum(map(len, texts))
    lengths = {}
    for s, parts in by_sequence.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= op.WINDOW
        lengths[s] = at
    return lengths


def test_awkward_rows(awkward, nothing, pairs):
    got = op.pack(awkward.withColumnRenamed("lang", "ids").withColumnRenamed("source", "start"))
    lengths = checked(got.collect(), pairs)
    assert sum(n not in (32, 64, 128, 256, 512, 1024) for n in lengths.values()) <= 1
    assert op.pack(nothing).count() == 0
    assert [r.length for r in op.pack(awkward.filter("doc_id = 4")).collect()] == [1]


def test_many_documents_in_small_shards(spark, monkeypatch):
    rng = random.Random(4)
    topics = [[f"topic{k}w{j}" for j in range(30)] for k in range(5)]
    docs = [(k, " ".join(rng.choices(topics[k % 5], k=rng.randint(1, 150)))) for k in range(200)]
    statistics = op.Statistics({-1: 200, -2: 60_000} | {k: 1 + k % 90 for k in range(50_000)})
    for shard in (7, 64, 2048):
        packer, rows = op.Packer(statistics, 3), []
        tails = [((d, 0), 0, np.array(PLAIN.encode(t).ids[:1000] + [0], "<u4")) for d, t in docs]
        for k in range(0, len(tails), shard):
            rows += packer.shard(tails[k : k + shard])
        rows += packer.rest()
        by_sequence = defaultdict(int)
        for r in rows:
            by_sequence[r[5]] += r[2]
        assert sum(by_sequence.values()) == sum(len(t[2]) for t in tails)
        assert sum(n < 1024 for n in by_sequence.values()) <= 6
    whole = op.pack(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = whole.collect()
    checked(rows, docs)
    topic = defaultdict(set)
    for r in rows:
        topic[r.sequence_id].add(r.doc_id % 5)
    assert np.mean([len(t) for t in topic.values()]) < 3


def test_index_scores_by_bm25():
    statistics = op.Statistics({-1: 3, -2: 9, 1: 2, 2: 1, 3: 3})
    tails = [np.array(t, "<u4") for t in ([1, 1, 3], [2, 3, 3], [1, 3, 3, 3])]
    got = op.Index(tails, statistics).scores(np.array([1, 2]))
    for k, t in enumerate(tails):
        want = 0.0
        for term in (1, 2):
            tf = (t == term).sum()
            want += statistics.idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / 3))
        assert abs(got[k] - want) < 1e-9


def test_keys_of_tails_are_those_of_each_alone():
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 60, n).astype("<u2") for n in (1, 2, 3, 40, 500, 1000)]
    idf = rng.random(60).round(1)
    tail, ids, tf = op._pairs([t.tobytes() for t in tails], "<u2")
    top = op._most_telling(tail, ids, idf[ids] * tf / (tf + op.K1), len(tails))
    for k, t in enumerate(tails):
        own, n = np.unique(t, return_counts=True)
        assert ids[tail == k].tolist() == own.tolist() and tf[tail == k].tolist() == n.tolist()
        want = own[np.argsort(-idf[own] * n / (n + op.K1), kind="stable")[:3]].tolist()
        assert [int(c[k]) for c in top] == (want + [-1, -1])[:3]


def test_keys_of_tails_are_made_once(spark, monkeypatch):
    made, plain = spark.sparkContext.accumulator(0), op._keyed_tails

    def counting(*given):
        def run(stream):
            for batch in plain(*given)(stream):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(op, "_keyed_tails", counting)
    monkeypatch.setattr(op, "PART_BYTES", 1 << 10)
    docs = spark.createDataFrame([(k, f"words of text {k} " * 20) for k in range(100)], "doc_id long, text string")
    assert op.pack(docs).count() >= 100 and made.value == 100
