"""Both substring operators against counting every window."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import anchors, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def copies() -> list[tuple]:
    """Documents made of shared passages, edits and copies; some periodic, some short."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    passage = [" ".join(word() for _ in range(90)) for _ in range(4)]
    docs = []
    for k in range(60):
        own = [" ".join(word() for _ in range(rng.randint(5, 90))) for _ in range(2)]
        text = f"{own[0]} {rng.choice(passage)} {own[1]}"
        if k % 3 == 0:
            words = passage[0].split() + passage[1].split()
            words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        docs.append((k * 7 % 101, text))
    docs += [(200, docs[3][1]), (201, docs[3][1]), (202, "ab " * 700), (203, "ab " * 700 + "c"), (204, None), (205, "")]
    return docs


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
def test_bytes_equal_brute_force(spark, copies, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    got = suffix_dedup.digest(suffix_dedup.find_repeats(spark.createDataFrame(copies, SCHEMA), hot=hot))
    assert sorted(map(tuple, got.collect())) == sorted(suffix_dedup.brute_force(copies))


@pytest.mark.parametrize("hot", [anchors.HOT, 1])
def test_words_equal_brute_force(spark, copies, hot):
    got = substring_dedup.digest(substring_dedup.find_duplicates(spark.createDataFrame(copies, SCHEMA), hot=hot))
    assert sorted(map(tuple, got.collect())) == sorted(substring_dedup.brute_force(copies))


def test_awkward_rows(awkward, nothing):
    for df, op in ((suffix_dedup.find_repeats, suffix_dedup), (substring_dedup.find_duplicates, substring_dedup)):
        got = op.digest(df(awkward.withColumnRenamed("lang", "key").withColumnRenamed("source", "id")))
        assert got.count() == awkward.count()
        assert df(nothing).count() == 0
        assert got.filter("doc_id = 3").first().n_removed == 0


def test_cut_texts_keep_other_columns(awkward, nothing):
    got = suffix_dedup.remove_repeats(awkward)
    assert got.columns == awkward.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "" and rows[2].text == "" and rows[3].text is None
    assert " tail of its own " in rows[7].text
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_a_passage_in_many_documents_with_unlike_surroundings(spark):
    """The stretches at the passage's edges differ in every document, those inside are equal in all."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(110)
    docs = [(k, f"{words(4)} {passage} {words(4)}") for k in range(1500)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(16)
    for op, found in ((suffix_dedup, suffix_dedup.find_repeats), (substring_dedup, substring_dedup.find_duplicates)):
        got = op.digest(found(frame, hot=50))
        assert sorted(map(tuple, got.collect())) == sorted(op.brute_force(docs))


def test_equal_contents_are_not_held():
    block = substring_dedup.ReferenceBlock()
    units = np.arange(40, dtype=np.uint64)
    windows = substring_dedup.gram_hashes(units, substring_dedup.WINDOW).tolist()
    assert block.factor(units.tobytes(), windows) == []
    block.add(units.tobytes(), windows)
    assert block.factor(units.tobytes(), windows) == [(0, len(windows))]
    kinds = [("anchor", "int64"), ("slice", "int32"), ("core", "int64"), ("id", "int64"), ("key", "int32"), ("start", "int64"),
             ("lead", "int32"), ("copied", "bool_"), ("units", "binary")]
    rows = [(1, 0, 0, k, 0, 5, 3, False, b"x" * 450) for k in range(50)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, getattr(pa, t)()) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds]
    )
    spans = pa.Table.from_batches(suffix_dedup._compare(iter([batch]))).to_pylist()
    assert sorted((s["id"], s["start"], s["n"]) for s in spans) == [(k, 5, 51) for k in range(50)]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 99, 500).astype(np.uint64)
    for m in (1, 2, 7, 499, 500):
        assert anchors.sliding_min(x, m).tolist() == [min(x[k : k + m]) for k in range(len(x) - m + 1)]


def test_block_repeats_need_all_bytes():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 123, 900).astype(np.uint8)
    contents = [base.tobytes()]
    for place in (0, 5, 255, 399, 400, 650, 899):
        other = base.copy()
        other[place] = 65
        contents.append(other.tobytes())
    for lead in (0, 3, 300):
        got = suffix_dedup.block_repeats(contents, [lead] * len(contents))
        for c, hit in zip(contents, got, strict=True):
            for k, h in enumerate(hit):
                assert h == (sum(o[k : k + 400] == c[k : k + 400] for o in contents) > 1)


def test_first_pass_holds_little_at_a_time():
    """One array of units in the first pass: peak memory well below a hundred megabytes."""
    import tracemalloc

    rng = random.Random(4)
    text = "".join(rng.choices("abcdefgh ", k=2500)) + " "
    rows = [(k, 0, f"{k} {text[k % 2000:]}{text}") for k in range(4000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([r[2] for r in rows])], ["id", "key", "text"]
    )
    tracemalloc.start()
    for _ in anchors._runs(suffix_dedup.KIND)([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140e6
