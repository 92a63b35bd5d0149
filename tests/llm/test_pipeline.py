"""The pipeline, stage by stage, against brute force on a part of the small tables' rows."""

from __future__ import annotations

import corpus_pipeline
from paperloom.llm import decontamination, jaccard_join, quality_rules, suffix_dedup
from paperloom.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, given = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        given.append(docs)
        docs = stored(stage(spark, docs, SMALL), "stage")
        if len(given) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    given.append(docs)
    rows = [{r[0]: r.asDict() for r in g.collect()} for g in given[:5]]
    judged = {r.doc_id for r in quality_rules.judge(given[0]).filter("kept").collect()}
    assert set(rows[1]) == judged
    groups = jaccard_join.brute_force([(k, r["text"]) for k, r in rows[1].items()])
    assert set(rows[2]) == {d for d, (_, c) in groups.items() if c == d}
    assert set(rows[3]) == set(rows[2])
    cut = {r[0]: r[3] for r in suffix_dedup.brute_force([(k, r["text"]) for k, r in rows[2].items()])}
    for k, r in rows[3].items():
        assert (r["text"] == rows[2][k]["text"]) == (cut[k] == 0)
        assert r["source"] == rows[2][k]["source"]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = decontamination.brute_force([(k, r["text"]) for k, r in rows[3].items()], items)
    assert set(rows[4]) == {k for k, v in hit.items() if not v[4]}
    tokens = given[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in tokens} == set(rows[4]) and all(r[1] == r[2] for r in tokens)


def test_run_is_all_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0
