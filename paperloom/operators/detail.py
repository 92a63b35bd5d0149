"""Document details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.naming import file_name, text_or_default, time_or_default
from paperloom.schemas import OFFICE_KINDS

DETAIL_TEXTS = ("creator", "last_modified_by", "title", "subject", "version", "revision", "file_name")
DETAIL_TIMES = ("created", "modified", "last_printed", "process_time")


def detail_columns(corpus: DataFrame) -> DataFrame:
    """The detail fields of every document; kinds other than office lack most of them."""
    office = F.col("doc_type").isin(*OFFICE_KINDS)

    def office_only(name: str, default) -> Column:
        value = F.col(name) if name in corpus.columns else F.lit(None)
        return default(F.when(office, value))

    return corpus.select(
        "id",
        text_or_default(F.col("creator")).alias("creator"),
        office_only("created", time_or_default).alias("created"),
        office_only("last_modified_by", text_or_default).alias("last_modified_by"),
        office_only("modified", time_or_default).alias("modified"),
        text_or_default(F.col("title")).alias("title"),
        text_or_default(F.col("subject")).alias("subject"),
        office_only("version", text_or_default).alias("version"),
        office_only("revision", text_or_default).alias("revision"),
        office_only("last_printed", time_or_default).alias("last_printed"),
        file_name(F.col("uri_file_path")).alias("file_name"),
        F.col("process_time"),
    )


def document_detail(corpus: DataFrame, doc_id: str, kind: str) -> DataFrame:
    """Always one row: the details of the document, or defaults when there is none.

    A global aggregate has one row even over nothing, which is where the defaults come from.
    """
    hit = corpus.where((F.col("doc_type") == kind) & (F.col("id") == doc_id))
    detail = detail_columns(hit)
    first = detail.agg(F.first(F.struct(*detail.columns)).alias("d"))
    texts = {n: text_or_default(F.col(f"d.{n}")) for n in DETAIL_TEXTS}
    times = {n: time_or_default(F.col(f"d.{n}")) for n in DETAIL_TIMES}
    columns = [text_or_default(F.col("d.id")).alias("id")]
    columns += [{**texts, **times}[n].alias(n) for n in detail.columns if n != "id"]
    return first.select(*columns)
