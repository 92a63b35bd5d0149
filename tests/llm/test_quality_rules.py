"""Quality rules: base columns by plain Python, line frequency on planted lines."""

from __future__ import annotations

import random
import re

import duckdb

from paperloom.llm import quality_rules as op
from paperloom.llm.oracle import quality_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    """The base columns, straight from their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n")]
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_base_columns(spark, awkward, nothing, pairs):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é#<\n\t\x1c\u2003", k=rng.randint(0, 80))) for _ in range(60)]
    docs = [(k, t, None, "s", None) for k, t in enumerate(texts)]
    got = {r.doc_id: tuple(r)[1:6] for r in op.judge(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {k: plain(t) for k, t, *_ in docs}
    small = op.judge(awkward.withColumnRenamed("lang", "key").withColumnRenamed("n_chars", "n_words"))
    assert small.count() == awkward.count()
    assert {r.doc_id for r in small.filter("base_failed").collect()} == {3, 4, 5, 6, 7, 8, 9, -5, None}
    assert op.judge(nothing).count() == 0 and op.cleaned(nothing).count() == 0


def planted(spark):
    """Documents with a line on every page of host a, copies, and plain ones."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    own = lambda: "\n".join(line(15) for _ in range(4))
    docs = [(k, own() + "\nSUBSCRIBE to   page 7", None, "a", None) for k in range(60)]
    docs += [(100 + k, own() + "\nsubscribe to page 1", None, "b", None) for k in range(10)]
    copy = own()
    docs += [(200 + k, copy, None, "a", None) for k in range(40)]
    docs += [(300 + k, copy.replace(copy.split()[k], "edited"), None, "a", None) for k in range(40)]
    common = [line(20) for _ in range(4)]
    docs += [(400 + k, "\n".join([*common, line(10)]), None, "c", None) for k in range(30)]
    docs += [(500 + k, own() + "\n" + common[k % 4], None, "c", None) for k in range(200)]
    return spark.createDataFrame(docs, SCHEMA)


def test_lines_above_the_limits(spark):
    docs = planted(spark)
    rows = {r.doc_id: r for r in op.judge(docs).collect()}
    assert all(rows[k].n_frequent_words == 4 and rows[k].kept for k in range(60))
    assert all(rows[100 + k].n_frequent_words == 0 and rows[100 + k].kept for k in range(10))
    assert all(rows[200 + k].kept for k in range(40)) and all(rows[300 + k].kept for k in range(40))
    assert all(rows[400 + k].n_frequent_words == 80 and not rows[400 + k].kept for k in range(30))


def test_cleaned_agrees_with_the_verdict(spark, awkward):
    for docs in (planted(spark), awkward):
        left = op.cleaned(docs)
        assert left.columns == docs.columns
        kept = sorted(str(r.doc_id) for r in op.judge(docs).filter("kept").collect())
        assert sorted(str(r.doc_id) for r in left.collect()) == kept
    texts = {r.doc_id: r.text for r in op.cleaned(planted(spark)).collect()}
    assert "SUBSCRIBE" not in texts[0] and "subscribe" in texts[100]


def test_boilerplate_heavy_documents_count_each(spark):
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    docs = []
    for host in range(5):
        common = [line(20) for _ in range(4)]
        docs += [(100 * host + k, "\n".join([*common, line(10)]), None, f"h{host}", None) for k in range(30)]
    rows = op.judge(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {(r.n_frequent_words, r.kept) for r in rows} == {(80, False)}
    assert op.cleaned(spark.createDataFrame(docs, SCHEMA)).count() == 0


def test_equals_sql_where_lines_are_above_the_limits(spark):
    db = duckdb.connect()
    db.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cursor = db.execute(quality_sql(3, 0.02))
    names = [d[0] for d in cursor.description]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(tuple(r[c] for c in names) for r in op.judge(docs, min_documents=3, host_share=0.02).collect())
    assert got == sorted(cursor.fetchall())
    gone = names.index("n_frequent_words")
    assert sum(r[gone] > 0 for r in got) > 100


def test_a_large_group_of_near_copies_is_not_boilerplate(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    lines = [line(12) for _ in range(12)]
    docs = []
    for k in range(300):
        words = [x.split() for x in lines]
        words[k % 12][k % 11] = f"edit{k}"
        docs.append((k, "\n".join(map(" ".join, words)), None, "h", None))
    docs += [(1000 + k, "\n".join(line(12) for _ in range(6)) + "\nshared line", None, "h", None) for k in range(100)]
    rows = {r.doc_id: r for r in op.judge(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert all(r.kept for r in rows.values())
    assert {rows[k].n_frequent_words for k in range(300)} == {0}
    assert {rows[1000 + k].n_frequent_words for k in range(100)} == {2}
