"""Jaccard groups against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import jaccard_join as op
from paperloom.llm.components import components


@pytest.fixture(scope="module")
def copies() -> list[tuple]:
    """Chains of edits around the threshold, shared passages, large and small groups."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(30)]
    docs, k = [], 0
    for n in (6, 12, 40, 80, 120):
        base = [word() for _ in range(n)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                words[rng.randrange(n)] = word()
            if rng.random() < 0.2:
                base = words
            docs.append((k * 13 % 997, " ".join(words)))
            k += 1
    for _ in range(40):
        docs.append((k * 13 % 997, " ".join([word() for _ in range(20)] + passage)))
        k += 1
    return docs


@pytest.mark.parametrize(("short", "common", "block"), [(8, 0.001, 1024), (2, 1.0, 4)])
def test_equals_all_pairs(spark, copies, short, common, block, monkeypatch):
    monkeypatch.setattr(op, "SHORT", short)
    monkeypatch.setattr(op, "COMMON", common)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "BROADCAST_ROWS", block)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.digest(op.group_documents(docs)).collect()}
    want = op.brute_force(copies)
    assert len({v[1] for v in want.values()}) > 20
    assert got == want


def test_awkward_rows(awkward, nothing, pairs):
    clash = awkward.withColumnRenamed("lang", "name").withColumnRenamed("source", "id").withColumnRenamed("n_chars", "_key")
    rows = op.digest(op.group_documents(clash)).collect()
    assert len(rows) == awkward.count()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 116, 1), (2, 116, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 1, 8), (None, 1, None)} <= got
    left = op.one_of_each(clash)
    assert left.columns == clash.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(
        ["1", "3", "4", "5", "6", "8", "8", "8", "None", "9", "-5"]  # 2 and 7 go with 1
    )
    assert op.group_documents(nothing).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (8, 9), (7, 7), (-6, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 1: 1, 9: -6, 8: -6, -6: -6}


def test_open_lists_name_few_pairs(monkeypatch):
    rng = random.Random(5)
    base = rng.sample(range(1 << 62), 200)
    rows = []
    for k in range(300):
        own = np.unique(np.array(base[: 200 - k % 7] + rng.sample(range(1 << 62), 12), np.uint64))
        rows.append((k, 0, len(own), k, op.sketch_of(own).tolist()))
    kinds = ["name", "block", "n", "part", "sketch"]
    batch = pa.RecordBatch.from_pylist([{"shingle": 5, "i": 0, "j": 0, **dict(zip(kinds, r, strict=True))} for r in rows])
    counts = {}
    for tries in (1, 8, 512):
        made = [r for b in op._across([batch], op.PERCENT, tries) for r in b.to_pylist()]
        pairs = [r for r in made if r["a"] is not None]
        assert len({(r["a"], r["b"]) for r in pairs}) == len(pairs) <= tries * len(rows)
        assert [r["shingle"] for r in made if r["a"] is None] == ([5] if tries < 512 else [])
        counts[tries] = len(pairs)
    assert counts[1] == 299 and counts[512] == 300 * 299 // 2
