"""Path ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.naming import text_or_default, time_or_default
from paperloom.schemas import HASH_FIELDS

# Date fields of the office hash and the text form they are hashed in.
HASH_DATE_FIELDS = ("created", "modified", "last_printed")
HASH_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def path_hash(path: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 path; the id of a document."""
    return F.sha2(path, 256)


def content_hash_office(fields: dict[str, Column], words: Column, separator: str = "") -> Column:
    """Hash of the seventeen metadata and content fields and the distinct comment words.

    Absent fields are hashed as their defaults (empty text, 1970).
    ``words`` is an array. Plain concatenation cannot tell ("ab","c") from ("a","bc"); pass a
    separator that does not occur in the data where that matters.
    """
    parts = []
    for name in HASH_FIELDS:
        if name in HASH_DATE_FIELDS:
            stamp = time_or_default(fields.get(name, F.lit(None)))
            parts.append(F.date_format(stamp, HASH_DATE_FORMAT))
        else:
            parts.append(text_or_default(fields.get(name, F.lit(None))))
    parts.append(F.coalesce(F.array_join(words, separator), F.lit("")))
    return F.sha2(F.concat_ws(separator, *parts), 256)


def content_hash_pdf(content: Column, creator: Column, keywords: Column, title: Column,
                     subject: Column) -> Column:
    """Hash of content, creator, keywords (array), title, subject and the type."""
    return F.sha2(
        F.concat_ws("", content, creator, F.array_join(keywords, ""), title, subject, F.lit("pdf")), 256
    )


def content_hash_mail(content: Column, sender: Column, title: Column) -> Column:
    """Hash of the clean content, sender, title and the type."""
    return F.sha2(F.concat_ws("", content, sender, title, F.lit("msg")), 256)
