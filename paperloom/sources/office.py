"""Text, metadata and comments of Office Open XML files.

The only Python that runs per row besides the mail parser: Spark scans, splits and joins, one
task opens one file at a time with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from paperloom.schemas import EXTRACT_SCHEMA

# XML namespaces and content types of the Office Open XML standard.
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SLIDE_NS = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING_NS = "http://schemas.openxmlformats.org/drawingml/2006/main"
MAIN_PARTS = {
    "word": "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml",
    "excel": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml",
    "powerpoint": "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml",
}
TEXT_PARTS = {
    "word": MAIN_PARTS["word"],
    "excel": "application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml",
    "powerpoint": "application/vnd.openxmlformats-officedocument.presentationml.slide+xml",
}
COMMENT_PARTS = {
    "word": "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml",
    "excel": "application/vnd.openxmlformats-officedocument.spreadsheetml.comments+xml",
    "powerpoint": "application/vnd.openxmlformats-officedocument.presentationml.comments+xml",
}
# Element names that carry text, pad it, or stand for a blank.
TEXT_TAGS = {f"{{{WORD_NS}}}t", f"{{{SHEET_NS}}}t", f"{{{DRAWING_NS}}}t", f"{{{SLIDE_NS}}}text"}
PARAGRAPH_TAGS = {f"{{{WORD_NS}}}p", f"{{{DRAWING_NS}}}p"}
BREAK_TAG = f"{{{WORD_NS}}}br"
FIELD_TAG = f"{{{WORD_NS}}}fldChar"
# Core property -> column.
CORE_PROPERTIES = {
    "category": "category",
    "contentStatus": "content_status",
    "created": "created",
    "creator": "creator",
    "description": "description",
    "identifier": "identifier",
    "keywords": "keywords",
    "language": "language",
    "lastModifiedBy": "last_modified_by",
    "lastPrinted": "last_printed",
    "modified": "modified",
    "revision": "revision",
    "subject": "subject",
    "title": "title",
    "version": "version",
}
TIME_COLUMNS = {"created", "modified", "last_printed"}


def extract_ooxml(files: DataFrame, kind: str) -> DataFrame:
    """Extract rows of (path, content bytes) files of one kind.

    A file without a main part gives no row; an unreadable one gives a row with ``error`` set.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_package(p, c, kind) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame([f for f in found if f is not None], columns=EXTRACT_SCHEMA.fieldNames())

    return files.select("path", "content").mapInPandas(rows, EXTRACT_SCHEMA)


def read_package(path: str, data: bytes, kind: str) -> dict | None:
    row = dict.fromkeys(EXTRACT_SCHEMA.fieldNames())
    row["path"] = path
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            by_type = part_names(package)
            if not by_type.get(MAIN_PARTS[kind]):
                return None
            texts = [parse(package, n) for n in by_type.get(TEXT_PARTS[kind], [])]
            row["content"] = document_text(texts, kind)
            row["comments"] = [
                c for n in by_type.get(COMMENT_PARTS[kind], []) for c in comments(parse(package, n), kind)
            ]
            row["slide_count"] = len(texts) if kind == "powerpoint" else None
            row.update(core_properties(package))
    except Exception as exc:  # noqa: BLE001 - a bad file is a counted row, not a failed job
        row["error"] = f"{type(exc).__name__}: {exc}"
    return row


def parse(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(package.read(name))


def part_names(package: zipfile.ZipFile) -> dict[str, list[str]]:
    """Names of the parts of a package by content type, in numerical order."""
    result: dict[str, list[str]] = {}
    present = set(package.namelist())
    for item in parse(package, "[Content_Types].xml"):
        name = item.get("PartName", "").lstrip("/")
        if name in present:
            result.setdefault(item.get("ContentType", ""), []).append(name)
    for names in result.values():
        names.sort(key=lambda n: [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", n)])
    return result


def document_text(roots: list[ElementTree.Element], kind: str) -> str:
    """Text below the top-level elements of a document, these joined by a blank."""
    tops: list[ElementTree.Element] = []
    for root in roots:
        if kind == "word":
            body = root.find(f"{{{WORD_NS}}}body")
            tops += list(body) if body is not None else []
        elif kind == "excel":
            tops += list(root)
        else:
            tops.append(root)
    return " ".join(children_text(t) for t in tops)


def children_text(element: ElementTree.Element) -> str:
    return " ".join(element_text(child) for child in element)


def element_text(element: ElementTree.Element) -> str:
    """Text of an element: runs as they are, paragraphs padded, breaks as a blank."""
    tag = element.tag
    if tag in TEXT_TAGS:
        return element.text or ""
    if tag == BREAK_TAG or (tag == FIELD_TAG and element.get(f"{{{WORD_NS}}}fldCharType") == "separate"):
        return " "
    if not any(element.itertext()):
        return ""
    inner = children_text(element)
    return f" {inner} " if tag in PARAGRAPH_TAGS else inner


def comments(root: ElementTree.Element, kind: str) -> list[dict]:
    """Comments of one comment part; what a kind does not record stays at its default."""
    if kind == "word":
        return [
            comment(
                "".join(c.itertext()),
                author=c.get(f"{{{WORD_NS}}}author"),
                date=c.get(f"{{{WORD_NS}}}date"),
                cid=c.get(f"{{{WORD_NS}}}id"),
                initials=c.get(f"{{{WORD_NS}}}initials"),
            )
            for c in root
        ]
    if kind == "excel":
        found = root.findall(f"{{{SHEET_NS}}}commentList/{{{SHEET_NS}}}comment")
        return [
            {**comment("".join("".join(t.itertext()) for t in c.findall(f"{{{SHEET_NS}}}text"))),
             "author": None, "date": None, "id": None, "initials": None}
            for c in found
        ]
    return [
        {**comment(c.findtext(f"{{{SLIDE_NS}}}text") or "", date=c.get("dt")),
         "author": None, "id": None, "initials": None}
        for c in root.findall(f"{{{SLIDE_NS}}}cm")
    ]


def comment(text: str, author: str | None = None, date: str | None = None, cid: str | None = None,
            initials: str | None = None) -> dict:
    return {
        "comment": text,
        "author": author or "",
        "date": parse_time(date) or datetime(1970, 1, 1),
        "id": cid or "",
        "initials": initials or "",
    }


def core_properties(package: zipfile.ZipFile) -> dict:
    """Core properties that are present, by column."""
    names = [n for n in package.namelist() if n.lower() == "docprops/core.xml"]
    if not names:
        return {}
    result = {}
    for item in parse(package, names[0]):
        column = CORE_PROPERTIES.get(item.tag.rsplit("}", 1)[-1])
        if column and item.text is not None:
            result[column] = parse_time(item.text) if column in TIME_COLUMNS else item.text
    return result


def parse_time(text: str | None) -> datetime | None:
    """A W3C date-time as naive UTC."""
    if not text:
        return None
    value = datetime.fromisoformat(text.strip())
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
