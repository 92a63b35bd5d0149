"""LM scoring: exact columns against counting, the filter against its counts."""

from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm import lm_scoring as op


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.zipf(1.5, 20_000).clip(1, 10**6)
    packed = op.build_filter(keys, counts)
    level = op.probe(packed, keys)
    assert (level >= op.levels(counts)).all()
    assert (level > op.levels(counts)).mean() < 0.03
    absent = op.probe(packed, rng.integers(1 << 63, 1 << 64, 20_000, dtype=np.uint64))
    assert (absent > 0).mean() < 0.03
    assert op.levels(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert op.expected_count(np.array([0, 1, 2])).tolist() == [0, 1, 2.5]


@pytest.mark.parametrize(("order", "shard_bytes", "group"), [(2, op.SHARD_BYTES, op.GROUP_TOKENS), (2, 300, 50), (3, 1000, 7)])
def test_equals_counting(spark, awkward, pairs, order, shard_bytes, group, monkeypatch):
    monkeypatch.setattr(op, "GROUP_TOKENS", group)
    one_each = {d: (d, t) for d, t in pairs}
    docs = spark.createDataFrame([*one_each.values()], "doc_id long, text string")
    if group < 100:
        docs = docs.filter("doc_id is null or doc_id <> 9")
        one_each.pop(9)
    model = op.train(docs.filter(~op.held_out()), order=order, shard_bytes=shard_bytes)
    want = op.brute_force([*one_each.values()], order)
    for r in op.score(docs, model).collect():
        _, n, known, total, base, smooth = want[r.doc_id]
        assert (r.n_tokens, r.n_known, model.n_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(smooth, rel=0.05, abs=0.6)  # counts are quantised, a few read too high


def test_contract_and_awkward_rows(awkward, nothing):
    got = op.query(awkward.withColumnRenamed("lang", "score").withColumnRenamed("source", "n_tokens"))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.count() == awkward.count()
    assert got.filter("doc_id = 3").first().n_tokens == 1
    assert op.query(nothing).count() == 0
    assert op.query(awkward.filter("doc_id = 3")).count() == 1
