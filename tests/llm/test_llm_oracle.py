"""Queries with SQL give the rows of their SQL."""

from __future__ import annotations

import duckdb
import pytest

from paperloom.llm.oracle import ORACLE
from paperloom.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cursor = db.execute(ORACLE[name])
    columns = sorted(d[0] for d in cursor.description)
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted((tuple(r[k] for k in places) for r in cursor.fetchall()), key=str)
    frame = REGISTRY[name](spark, SMALL)
    assert sorted(frame.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str) == want


def test_all_operators():
    assert [n.split("_")[0] for n in REGISTRY] == [f"op{k}" for k in range(1, 14)]
