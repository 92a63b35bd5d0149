"""The Merkle manifest against a tree built in one place."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import merkle_manifest as mm

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SMALL = "/root/testdata/sf0.001"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: dict, text) -> str:
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list]]:
    """The top of a tree and each leaf's siblings (left, right), level by level."""
    proofs, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for j in run:
                for k in below[j]:
                    proofs[k].append(([nodes[i] for i in run if i < j], [nodes[i] for i in run if i > j]))
        below = [[k for j in run for k in below[j]] for run in runs]
        nodes = [sha(*(nodes[j] for j in run)) for run in runs]
    return nodes[0], proofs


def expected(rows: list[dict]) -> list[tuple]:
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [tree([leaf(r, r["text"]) for r in groups[s]]) for s in order]
    root, tops = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for s, (subroot, proofs), top in zip(order, trees, tops, strict=True):
        for r, proof in zip(groups[s], proofs, strict=True):
            text = r["text"]
            if text and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for left, right in proof + top:
                fold = sha(*left, fold, *right)
            seen = "".join("".join(a) + "".join(b) for a, b in proof + top)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha(seen), fold, fold == root))
    return sorted(out, key=str)


def check(frame):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in mm.digest(frame).collect()), key=str)
    assert got == expected([r.asDict() for r in frame.collect()])
    return got


def test_given_documents(spark):
    rows = check(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert len({r[-1] for r in rows}) == 2


@pytest.mark.parametrize("sources", ["null", "one each", "many"])
def test_shapes_of_the_two_trees(spark, sources):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"),
        F.length(F.col("id").cast("string")).cast("long").alias("n_chars"),
    )
    named = {"null": F.lit(None).cast("string"), "one each": F.col("doc_id").cast("string"), "many": F.concat(F.lit("s"), F.col("doc_id") % 18)}
    check(docs.withColumn("source", named[sources]))


def test_awkward_rows(awkward):
    check(awkward.withColumn("leaf", F.lit("own")).withColumn("tree", F.lit(1)))


def test_empty_table(nothing):
    assert mm.digest(nothing).collect() == []


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    proofs = mm.manifest(mm.leaves(docs))
    folded = proofs.select("root", mm.folded(F.col("leaf"), F.col("proof")).alias("own"), mm.folded(F.sha2("leaf", 256), F.col("proof")).alias("other"))
    assert folded.where("own <> root or other = root").count() == 0
