"""Upsert, delete and index selection on corpus tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.naming import index_name
from paperloom.schemas import CORPUS_SCHEMA, INDEX_NAME


def last_write_per_id(batch: DataFrame, *order: Column) -> DataFrame:
    """The latest row of every id, by process time unless another order is given.

    The ranking keeps one row per id and task before the shuffle, so copies of one id do not
    travel.
    """
    by = order or (F.desc("process_time"), F.asc("content_hash"))
    ranked = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*by)))
    return ranked.where(F.col("_n") == 1).drop("_n")


def upsert(corpus: DataFrame, batch: DataFrame, *order: Column) -> DataFrame:
    """Corpus with the rows of the batch in place of rows of the same id."""
    latest = last_write_per_id(batch, *order)
    return corpus.join(latest.select("id"), "id", "left_anti").unionByName(latest, allowMissingColumns=True)


def delete_by_id(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Corpus without the given ids (column ``id``)."""
    return corpus.join(ids.select("id"), "id", "left_anti")


def replace_kind(corpus: DataFrame, kind: str, batch: DataFrame) -> DataFrame:
    """Corpus with one kind dropped as a whole and rebuilt from the batch."""
    fresh = batch.where(F.col("doc_type") == kind)
    return corpus.where(F.col("doc_type") != kind).unionByName(fresh, allowMissingColumns=True)


def list_indices(corpus: DataFrame, pattern: str = "", main: str = INDEX_NAME) -> DataFrame:
    """Names of existing indices that match a ``*`` pattern; an empty pattern is all."""
    names = corpus.select("doc_type").distinct().select(
        index_name(main, F.col("doc_type")).alias("index_name")
    )
    if not pattern:
        return names
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return names.where(F.col("index_name").like(like))


def empty_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORPUS_SCHEMA)
