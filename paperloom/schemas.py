"""Schemas, the document kinds and other fixed values of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

COMMENT_TYPE = T.StructType(
    [
        T.StructField("comment", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.TimestampType()),
        T.StructField("id", T.StringType()),
        T.StructField("initials", T.StringType()),
    ]
)

# One wide table for all kinds; columns a kind does not have are null.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("original_file_path", T.StringType()),
        T.StructField("uri_file_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("completion_content", T.ArrayType(T.StringType())),
        T.StructField("creator", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("process_time", T.TimestampType()),
        T.StructField("comments", T.ArrayType(COMMENT_TYPE)),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("revision", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("content_status", T.StringType()),
        T.StructField("last_modified_by", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("last_printed", T.TimestampType()),
        T.StructField("slide_count", T.IntegerType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("receiver", T.ArrayType(T.StringType())),
    ]
)

STATE_SCHEMA = T.StructType(
    [
        T.StructField("path_hash", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("original_path", T.StringType()),
        T.StructField("doc_type", T.StringType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("entire_doc_count", T.LongType()),
        T.StructField("indexed_doc_count", T.LongType()),
        T.StructField("processing_error", T.LongType()),
        T.StructField("start_job", T.TimestampType()),
        T.StructField("end_job", T.TimestampType()),
        T.StructField("elapsed_time_millis", T.LongType()),
    ]
)

# What a file reader delivers before hashing and naming.
EXTRACT_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("last_printed", T.TimestampType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("revision", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("content_status", T.StringType()),
        T.StructField("last_modified_by", T.StringType()),
        T.StructField("slide_count", T.IntegerType()),
        T.StructField("comments", T.ArrayType(COMMENT_TYPE)),
        T.StructField("error", T.StringType()),
    ]
)

MAIL_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("receiver", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Kind:
    """One document kind: its index suffix, file glob, exclude filter and icon."""

    suffix: str
    content_type: str
    glob: str
    exclude: str
    icon: str
    mime: str | None = None
    active: bool = True


# Kinds in result order, with suffix, extension, glob, exclude filter, icon and
# MIME type as the search front end and the download expect them.
KINDS = (
    Kind("word", "docx", "*.docx", "~$", "./images/word.svg",
         "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    Kind("excel", "xlsx", "*.xlsx", "~$", "./images/excel.svg",
         "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    Kind("powerpoint", "pptx", "*.pptx", "~$", "./images/powerpoint.svg",
         "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    Kind("pdf", "pdf", "*.pdf", "", "./images/pdf.svg", "application/pdf"),
    Kind("eml", "eml", "*.eml", "", "./images/eml.svg"),
    Kind("msg", "msg", "*.msg", "", "./images/outlook.svg"),
)
UNKNOWN_ICON = "./images/unknown.svg"
INDEX_NAME = "officedocuments"
OFFICE_KINDS = ("word", "excel", "powerpoint")
MAIL_KINDS = ("eml", "msg")
KIND_NAMES = tuple(k.suffix for k in KINDS)
KIND_BY_NAME = {k.suffix: k for k in KINDS}

# What stands in for absent text and absent dates.
DEFAULT_TEXT = ""
DEFAULT_TIME = "1970-01-01 00:00:00"

# The fields of the office content hash, in hashing order.
HASH_FIELDS = (
    "category",
    "created",
    "content",
    "creator",
    "description",
    "identifier",
    "keywords",
    "language",
    "modified",
    "revision",
    "subject",
    "title",
    "version",
    "content_status",
    "content_type",
    "last_printed",
    "last_modified_by",
)
