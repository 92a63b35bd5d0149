"""Benchmark decontamination against plain comparison of all windows."""

from __future__ import annotations

from paperloom.llm import decontamination as op

ITEMS = [
    (0, "word3x3 word4x4 WORD5X5, word6x6 word7x7 word8x8 word9x9 word10x10 word11x11 word12x12 word13x13"),
    (1, "one two three"),
    (2, None),
    (3, ""),
    (None, "four five"),
    (1, "größer"),
    (5, "absent words only"),
]


def rows(df):
    return sorted(tuple(r) for r in df.collect() if r.doc_id is not None)


def test_equals_brute_force(spark, awkward, pairs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (op.BLOCK_BYTES, 40):
        got = op.digest(op.find_contamination(awkward, bench, block_bytes=size))
        assert got.count() == len(pairs)
        for row in got.collect():
            options = [op.brute_force([p], ITEMS)[p[0]] for p in pairs if p[0] == row.doc_id]
            assert tuple(row)[1:] in options


def test_spans_point_into_the_original(spark, awkward):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = op.find_contamination(awkward, bench).filter("doc_id = -5").first()
    text = b"ONE Two\x00three \x1c\xe2\x80\x83x"
    assert [text[s.start : s.end] for s in row.spans] == [b"ONE Two\x00three"]
    assert row.items == ["1"]


def test_dropped_documents_and_extra_columns(spark, awkward, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clash = awkward.withColumnRenamed("lang", "n_hit").withColumnRenamed("source", "items")
    kept = op.drop_contaminated(clash, bench)
    assert kept.columns == clash.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 9}| {None}
    assert op.drop_contaminated(nothing, bench).count() == 0
    assert op.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert op.digest(op.find_contamination(clash, bench.limit(0))).filter("contaminated").count() == 0
