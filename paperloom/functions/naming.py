"""Paths, URIs, index names, icons, MIME types and default values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.schemas import DEFAULT_TEXT, DEFAULT_TIME, KINDS, UNKNOWN_ICON


def text_or_default(value: Column) -> Column:
    return F.coalesce(value, F.lit(DEFAULT_TEXT))


def time_or_default(value: Column) -> Column:
    return F.coalesce(value, F.lit(DEFAULT_TIME).cast("timestamp"))


def uri_rewrite(path: Column, scan_path: str, uri_base: str) -> Column:
    """Replace the scan path by the URI base, then backslashes by slashes (both literally)."""
    moved = F.replace(path, F.lit(scan_path), F.lit(uri_base)) if scan_path else path
    return F.replace(moved, F.lit("\\"), F.lit("/"))


def file_name(uri: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(uri, "/", -1)


def download_name(path: Column) -> Column:
    """File name encoded for a download link, a blank becoming ``+``."""
    return F.url_encode(file_name(path))


def mime_type(content_type: Column) -> Column:
    """MIME type of a document type; unknown types pass through."""
    result = content_type
    for kind in KINDS:
        if kind.mime:
            result = F.when(content_type == kind.content_type, kind.mime).otherwise(result)
    return result


def program_icon(content_type: Column) -> Column:
    """Icon path of a document type, or the unknown icon."""
    result = F.lit(UNKNOWN_ICON)
    for kind in KINDS:
        result = F.when(content_type == kind.content_type, kind.icon).otherwise(result)
    return result


def index_name(main: str | Column, suffix: Column) -> Column:
    return F.concat_ws("-", F.lit(main) if isinstance(main, str) else main, suffix)
