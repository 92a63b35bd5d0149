"""Text normalisation as native column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns the corpus has to be cleaned with for equal results.
OFFICE_RULES = ((r"\r\n?|\n", ""), (r"[ ]{2,}", " "))
MAIL_RULES = (
    ("&nbsp;", " "),
    (r"[^a-zA-ZäöüßÄÜÖ@.0-9]", " "),
    (r"\n", " "),
    (r"[ ]{2,}", " "),
)
SUGGEST_OFFICE_JUNK = r"[^a-zA-Z äöüÄÖÜß]"
SUGGEST_PDF_JUNK = r"[^a-zA-Zäöüß]"
SUGGEST_MAIL_JUNK = r"[^a-zäöüß@. ]"
MIN_TERM_LENGTH = 3

# Our analyzer: a term is a run of letters, digits and underscores, lower-cased.
NON_WORD = r"[^\p{L}\p{N}_]+"


def regex_chain(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply regex replacements one after the other."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_office(text: Column, join_lines_with: str = "") -> Column:
    """Remove line breaks and squeeze blanks.

    The default glues the words around a line break together, as the original data does;
    pass ``join_lines_with=" "`` to keep them apart.
    """
    (line_break, _), squeeze = OFFICE_RULES
    return regex_chain(text, ((line_break, join_lines_with), squeeze))


def clean_mail(text: Column) -> Column:
    """Reduce a mail body to letters, digits, ``@`` and ``.`` with single blanks."""
    return regex_chain(text, MAIL_RULES)


def html_to_text(html: Column, drop_script_style: bool = False) -> Column:
    """Text between tags, one piece per line, comments left out; entities stay as written.

    A ``>`` inside an attribute value ends its tag early.
    """
    rules = [(r"(?s)<!--.*?-->", "")]
    if drop_script_style:
        rules += [(r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", "")]
    return regex_chain(html, [*rules, (r"<[^>]+>", "\n")])


def comments_text(comments: Column) -> Column:
    """Texts of an array of comment structs joined with a blank."""
    return F.array_join(F.transform(comments, lambda c: c["comment"]), " ")


def comment_words(comments: Column) -> Column:
    """Distinct words of all comments of a row, in order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(comments, lambda c: F.split(c["comment"], " "))))


def suggest_text(comments: Column, content: Column) -> Column:
    """Comment text, a blank and the content, reduced to letters and blanks."""
    joined = F.concat(F.coalesce(comments, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    return F.regexp_replace(joined, SUGGEST_OFFICE_JUNK, "")


def suggest_terms(text: Column) -> Column:
    """Distinct lower-case words longer than two letters, in order of first appearance."""
    words = F.array_distinct(F.split(F.lower(text), " "))
    return F.filter(words, lambda w: F.length(w) >= MIN_TERM_LENGTH)


def suggest_terms_pdf(content: Column) -> Column:
    """As `suggest_terms`, where every other character (capital umlauts too) is a separator."""
    return suggest_terms(F.regexp_replace(content, SUGGEST_PDF_JUNK, " "))


def suggest_terms_mail(content: Column) -> Column:
    """As `suggest_terms`, keeping ``@`` and ``.`` so that addresses survive.

    Stripping the lower-cased text as a whole, blanks kept, equals stripping word by word.
    """
    return suggest_terms(F.regexp_replace(F.lower(content), SUGGEST_MAIL_JUNK, ""))


def tokens(text: Column) -> Column:
    """The terms of a text in order; the array index is the position."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def keywords_office(keywords: Column) -> Column:
    """Empty text is no keyword at all, otherwise split on commas without trimming."""
    none = F.array().cast("array<string>")
    return F.when(F.length(keywords) == 0, none).otherwise(F.split(keywords, ","))


def keywords_pdf(keywords: Column) -> Column:
    """Null and empty text are no keyword at all, otherwise split on blanks."""
    none = F.array().cast("array<string>")
    absent = keywords.isNull() | (F.length(keywords) == 0)
    return F.when(absent, none).otherwise(F.split(keywords, " "))
