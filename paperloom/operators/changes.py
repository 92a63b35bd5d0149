"""Change detection of documents against the saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


def with_labels(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents with their label: absent from the state is new, another hash is changed.

    All columns travel through the join; give narrow rows, or use `changed_documents`.
    """
    known = state.select(F.col("path_hash").alias("id"), F.col("content_hash").alias("_stored"))
    label = (
        F.when(F.col("_stored").isNull(), NEW)
        .when(F.col("_stored") != F.col("content_hash"), CHANGED)
        .otherwise(UNCHANGED)
    )
    return docs.join(known, "id", "left").withColumn("label", label).drop("_stored")


def change_labels(docs: DataFrame, state: DataFrame) -> DataFrame:
    """(id, content_hash, label) for every document; joins these narrow columns only."""
    return with_labels(docs.select("id", "content_hash"), state)


def changed_documents(docs: DataFrame, state: DataFrame) -> DataFrame:
    """New and changed documents, texts included, with their label.

    The labels are joined back by id, so that texts of unchanged documents are never shuffled
    when the changed ids are few enough for the optimizer to send them to the documents.
    """
    labels = change_labels(docs, state).where(F.col("label") != UNCHANGED)
    return docs.join(labels.select("id", "label").distinct(), "id")


def next_state(state: DataFrame, docs: DataFrame) -> DataFrame:
    """State after a run over ``docs``: their hashes where they are known, else the old rows."""
    now = docs.select(
        F.col("id").alias("path_hash"),
        F.struct("content_hash", F.col("original_file_path").alias("original_path"), "doc_type").alias("_now"),
    )
    merged = state.join(now, "path_hash", "full")
    return merged.select(
        "path_hash",
        *[F.coalesce(F.col(f"_now.{c}"), F.col(c)).alias(c) for c in ("content_hash", "original_path", "doc_type")],
    )


def run_counters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: all documents seen, failed ones too, those indexed and those failed."""
    seen = docs.agg(
        F.count(F.lit(1)).alias("entire_doc_count"),
        F.count_if(F.col("error").isNotNull()).alias("processing_error"),
    )
    indexed = labels.agg(F.count_if(F.col("label") != UNCHANGED).alias("indexed_doc_count"))
    return seen.select("entire_doc_count", indexed.scalar().alias("indexed_doc_count"), "processing_error")
