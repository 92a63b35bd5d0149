"""Assembly of documents from ordered parts (pages of a PDF, comments of a document)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_SIZE = 4096


def assemble_parts(pages: DataFrame, key: str, order: str, text: str, separator: str = " ",
                   part_size: int = PART_SIZE) -> DataFrame:
    """Join pages in order to parts of at most ``part_size`` order numbers each.

    A document of many pages becomes many rows (key, part, content, page_count), so no task
    gathers more than a part, however large a document is.
    """
    part = F.floor(F.col(order) / part_size).alias("part")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_text"))))
    return pages.groupBy(key, part).agg(
        F.array_join(F.transform(ordered, lambda p: p["_text"]), separator).alias("content"),
        F.count(F.lit(1)).alias("page_count"),
    )


def assemble_pages(pages: DataFrame, key: str, order: str, text: str, separator: str = " ",
                   part_size: int = PART_SIZE) -> DataFrame:
    """One row (key, content, page_count) per document; parts are assembled first.

    The content of a document is one string here and so bound to what one row can hold;
    `assemble_parts` is the form without that bound.
    """
    parts = assemble_parts(pages, key, order, text, separator, part_size)
    ordered = F.sort_array(F.collect_list(F.struct("part", "content")))
    return parts.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["content"]), separator).alias("content"),
        F.sum("page_count").alias("page_count"),
    )


def first_appearance_words(comments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Distinct words per key in order of first appearance, as one array ``words``.

    Words are made distinct by a partial aggregate before anything is gathered: what one group
    collects is a vocabulary, not the comments.
    """
    words = comments.select(
        key,
        F.col(order).cast("long").alias("_order"),
        F.posexplode_outer(F.array_distinct(F.split(text, " "))).alias("_pos", "word"),
    ).where(F.col("word").isNotNull())
    first = words.groupBy(key, "word").agg(
        F.min(F.col("_order") * F.lit(2**32) + F.col("_pos")).alias("_first")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_first", "word")))
    return first.groupBy(key).agg(F.transform(ordered, lambda w: w["word"]).alias("words"))
