"""Hard negatives against scores of Python's own integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from paperloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows, every=100, moved=7, positives=5, negatives=10) -> list[tuple]:
    by_id = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % moved == 0 else label, [math.floor(256 * x) for x in v])
        by_id[i] = min(by_id.get(i, one), one)
    out = []
    for a, (label, q) in by_id.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, lab == label) for i, (lab, w) in by_id.items() if i != a)
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            fit = [(n, j) for n, j, alike in scored if not alike and -30 * p <= -100 * n <= -90 * p]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def got(frame) -> list[tuple]:
    return sorted(tuple(r[c] for c in COLUMNS) for r in hn.query(frame).collect())


def vectors(n, dims, seed, size=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(10, dims))
    return [(k, (size * (base[k % 10] * 0.7 + rng.normal(size=dims))).tolist(), int(rng.integers(0, 4))) for k in range(n)]


@pytest.mark.parametrize(("dims", "size"), [(3, 1.0), (64, 0.1), (300, 50_000.0)])
def test_exact_scores_of_any_size(spark, dims, size):
    rows = vectors(450, dims, dims, size)
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found and found == expected(rows)


def test_common_vector_ties_nulls_and_repeats(spark):
    rows = vectors(300, 8, 1)
    rows += [(k, rows[5][1], k % 3) for k in range(300, 900)]
    rows += [(1000, None, 1), (1001, [1.0] * 8, None), (None, [1.0] * 8, 1), (1002, [1.0, None], 1), (1003, [math.nan] * 8, 1)]
    rows += [(1100, [math.inf] * 8, 1), (1200, [], 1), (1300, [1.0] * 3, 1), (1301, [1.0] * 9, 1), (100, rows[100][1], 9), (-200, rows[7][1], 2)]
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found and found == expected(rows)


def test_blocks_of_anchors_give_the_same(spark, monkeypatch):
    rows = vectors(700, 4, 2)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(hn, "CELLS", 50)
    assert got(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_empty_tables(spark):
    empty = hn.query(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and set(empty.columns) == set(COLUMNS)
    assert got(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []
    assert got(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []


def test_too_large_for_a_long(spark):
    with pytest.raises(ValueError, match="do not fit"):
        hn.query(spark.createDataFrame([(100, [1e30], 1)], SCHEMA))


@pytest.mark.parametrize("bound", [1, 100, 2**23, 2**40, 2**61])
def test_products_in_residues(bound):
    rng = np.random.default_rng(bound % 97)
    dims = 1500
    most = max(1, math.isqrt(bound // dims))
    a, b = (rng.integers(-most, most + 1, size=(7, dims)) for _ in range(2))
    a[0], b[0] = most, -most
    primes = hn.needed_primes(2 * dims * most**2 + 1)
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a])
    assert (hn.products(hn.residues(a, primes), hn.residues(b, primes), primes) == want).all()
