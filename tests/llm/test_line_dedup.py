"""Line dedup against a plain count."""

from __future__ import annotations

import hashlib
import string
from collections import Counter

from pyspark.sql import functions as F

from paperloom.llm import line_dedup as ld

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def expected(pairs, least=ld.MIN_DOCUMENTS) -> list[tuple]:
    texts = [(i, (t or "").split("\n")) for i, t in pairs]
    held = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    out = []
    for i, lines in texts:
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame, **options) -> list[tuple]:
    rows = ld.digest(ld.drop_frequent_lines(frame, **options)).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = got(docs)
    assert found == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in found) > 100


def test_awkward_rows(awkward, pairs):
    for least in (1, 2, 10):
        assert got(awkward, min_documents=least) == expected(pairs, least)


def test_lines_at_the_limit_white_space_and_capitals(spark):
    pairs = [(k, f"\n Shared LINE {k} \t\nnine\x0b\n\x1cnine\nÄ{'' if k % 2 else ' '}\n\n\r\nown {k}\n") for k in range(9)]
    pairs += [(9, "shared line 3\nNINE\nä"), (9, None), (None, ""), (10, "nine"), (11, "Ä\nÄ\nÄ"), (12, "nine\nNine\nnine")]
    docs = spark.createDataFrame(pairs, SCHEMA)
    found = got(docs)
    assert found == expected(pairs)
    assert {r[0]: r[2] for r in found}[12] == 3


def test_a_line_in_a_third_of_all_rows_is_split(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("hot\n"), "id")).otherwise(F.concat(F.lit("x"), F.col("id") % 700)).alias("text")
    )
    assert got(docs, min_documents=5) == expected([(r.doc_id, r.text) for r in docs.collect()], 5)


def test_a_long_text_of_many_dropped_lines(spark):
    text = "\n".join(f"line {k % 50_000}" for k in range(100_000))
    docs = spark.createDataFrame([(k, text + f"\n{k}") for k in range(3)], SCHEMA)
    assert got(docs, min_documents=3) == expected([(k, text + f"\n{k}") for k in range(3)], 3)


def test_empty_table_clashing_columns_and_no_python(spark, nothing, awkward):
    assert got(nothing) == []
    extra = awkward.withColumns({c: F.lit(7) for c in ("n_lines", "n_dropped", "r1", "h1", "pos", "part", "row", "drops", "lines", "key")})
    found = ld.drop_frequent_lines(extra, min_documents=2)
    assert set(found.columns) == set(extra.columns)
    assert {r.drops for r in found.select("drops").distinct().collect()} == {7}
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
