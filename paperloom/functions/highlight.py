"""Highlighting and snippets; meant for the rows of one result page."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Highlight tags and sizes of the result page.
START_TAG = '<span class="hilightText"><strong>'
END_TAG = "</strong></span>"
FRAGMENT_SIZE = 500
FRAGMENT_COUNT = 5
SNIPPET_SIZE = 512
SNIPPET_TAIL = " ..."

# Control characters that stand for word edges and tags until the text is escaped.
_WORD_OPEN, _WORD_CLOSE, _HIT_OPEN, _HIT_CLOSE = "\x01", "\x02", "\x03", "\x04"


def mark_hits(text: Column, terms: Sequence[str]) -> Column:
    """Put hit marks around every whole word that is one of the terms, ignoring case.

    Word edges are marked first, since ``\\b`` means different things in different engines.
    """
    text = F.translate(text, _WORD_OPEN + _WORD_CLOSE + _HIT_OPEN + _HIT_CLOSE, "")
    alternatives = "|".join(re.escape(t) for t in terms)
    words = F.regexp_replace(text, r"([\p{L}\p{N}_]+)", f"{_WORD_OPEN}$1{_WORD_CLOSE}")
    hits = F.regexp_replace(
        words, f"(?iu){_WORD_OPEN}({alternatives}){_WORD_CLOSE}", f"{_HIT_OPEN}$1{_HIT_CLOSE}"
    )
    return F.translate(hits, _WORD_OPEN + _WORD_CLOSE, "")


# Characters an HTML-encoding highlighter escapes, the ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
    ("/", "&#x2F;"),
)


def escape_html(text: Column) -> Column:
    for raw, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def hits_to_tags(text: Column) -> Column:
    opened = F.replace(text, F.lit(_HIT_OPEN), F.lit(START_TAG))
    return F.replace(opened, F.lit(_HIT_CLOSE), F.lit(END_TAG))


def strip_tags(fragment: Column) -> Column:
    """The plain text of a highlighted fragment, as it stands in the escaped original."""
    return F.replace(F.replace(fragment, F.lit(START_TAG), F.lit("")), F.lit(END_TAG), F.lit(""))


def pieces(text: Column, size: int) -> Column:
    """The text in pieces of up to ``size`` characters, cut at white space; a longer word stays whole."""
    ends, inside = r"[^\x09-\x0D\x20]", rf".{{0,{max(0, size - 2)}}}"
    pattern = rf"(?s){ends}(?:{inside}{ends})?(?:[\x09-\x0D\x20]|\z)|{ends}+"
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p: F.regexp_replace(p, r"[\x09-\x0D\x20]+\z", ""),
    )


def fragments(text: Column, terms: Sequence[str], size: int = FRAGMENT_SIZE,
              count: int = FRAGMENT_COUNT) -> Column:
    """Highlighted fragments: the text in pieces of up to ``size``, the first ``count`` with a hit.

    Escaping comes after marking, else the ``amp`` of ``&amp;`` would be a hit.
    """
    if not terms:
        return F.array().cast("array<string>")
    marked = F.transform(pieces(text, size), lambda p: mark_hits(p, terms))
    with_hit = F.filter(marked, lambda b: b.contains(_HIT_OPEN))
    return F.transform(F.slice(with_hit, 1, count), lambda b: hits_to_tags(escape_html(b)))


def fallback_snippet(content: Column) -> Column:
    """The beginning of the content, for hits without a highlighted fragment."""
    return F.when(
        F.length(content) > SNIPPET_SIZE,
        F.concat(F.substring(content, 1, SNIPPET_SIZE), F.lit(SNIPPET_TAIL)),
    ).otherwise(content)
