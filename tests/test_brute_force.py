"""Native expressions and plans against plain Python on small random inputs."""

from __future__ import annotations

import hashlib
import html
import re
import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from paperloom.functions import hashing
from paperloom.functions import highlight as hl
from paperloom.functions import text as tx
from paperloom.operators import search
from paperloom.schemas import HASH_FIELDS

ALPHABET = list("abcABCäöüÄÖÜßéø019_@.,-<>&\"'/ \n\r\t") + ["  ", "the", " the ", "elle", "\r\n", "&nbsp;"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    return [*made, "", " ", "x" * 1200 + " the " + "y" * 700, "the " * 900]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").cache()


def column(frame, expression):
    return [r.v for r in frame.select("doc_id", expression.alias("v")).orderBy("doc_id").collect()]


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}_]+", text.lower()) if w]


def office(text):
    return regex.sub("[ ]{2,}", " ", regex.sub(r"\r\n?|\n", "", text))


def long_words(parts):
    return [w for w in dict.fromkeys(parts) if len(w) > 2]


def test_cleaning(frame, texts):
    assert column(frame, tx.clean_office(F.col("text"))) == [office(t) for t in texts]
    spaced = tx.clean_office(F.col("text"), join_lines_with=" ")
    assert column(frame, spaced) == [regex.sub("[ ]{2,}", " ", regex.sub(r"\r\n?|\n", " ", t)) for t in texts]

    def mail(t):
        t = regex.sub(r"[^a-zA-ZäöüßÄÜÖ@.0-9]", " ", t.replace("&nbsp;", " "))
        return regex.sub("[ ]{2,}", " ", t)

    assert column(frame, tx.clean_mail(F.col("text"))) == [mail(t) for t in texts]


def test_tokens(frame, texts):
    assert column(frame, tx.tokens(F.col("text"))) == [words(t) for t in texts]


def test_suggest_terms(frame, texts):
    assert column(frame, tx.suggest_terms(F.col("text"))) == [long_words(t.lower().split(" ")) for t in texts]

    def mail(t):
        return long_words([regex.sub("[^a-zäöüß@.]", "", w) for w in t.lower().split(" ")])

    assert column(frame, tx.suggest_terms_mail(F.col("text"))) == [mail(t) for t in texts]


def test_office_hash(frame, texts):
    fields = {"content": F.col("text"), "title": F.lit("T"), "created": F.lit("2024-01-02 03:04:05").cast("timestamp")}
    found = column(frame, hashing.content_hash_office(fields, F.split("text", " ")))
    values = {"title": "T", "created": "2024-01-02 03:04:05"}
    values |= dict.fromkeys(("modified", "last_printed"), "1970-01-01 00:00:00")

    def expected(t):
        joined = "".join(values.get(n, t if n == "content" else "") for n in HASH_FIELDS)
        return hashlib.sha256((joined + t.replace(" ", "")).encode()).hexdigest()

    assert found == [expected(t) for t in texts]


def test_fragments(frame, texts):
    def mark(block):
        def tag(match):
            word = match.group()
            return f"\x03{word}\x04" if word.lower() in ("the", "elle") else word

        return regex.sub(r"[\p{L}\p{N}_]+", tag, block)

    def expected(t):
        blocks, start, end = [], None, None
        for word in re.finditer(r"[^\x09-\x0D\x20]+", t):
            if start is not None and word.end() - start > 500:
                blocks.append(mark(t[start:end]))
                start = None
            start, end = word.start() if start is None else start, word.end()
        blocks += [mark(t[start:end])] if start is not None else []
        kept = [b for b in blocks if "\x03" in b][:5]
        escaped = [html.escape(b).replace("/", "&#x2F;") for b in kept]
        return [e.replace("\x03", hl.START_TAG).replace("\x04", hl.END_TAG) for e in escaped]

    assert column(frame, hl.fragments(F.col("text"), ["the", "elle"])) == [expected(t) for t in texts]


def test_bm25(frame, texts):
    terms = ["the", "elle"]
    tokens = [words(t) for t in texts]
    lengths = [len(t) for t in tokens if t]
    n, average = len(lengths), sum(lengths) / len(lengths)
    df = {t: sum(t in ws for ws in tokens) for t in terms}
    expected = {}
    for i, ws in enumerate(tokens):
        score = 0.0
        for t in terms:
            tf = ws.count(t)
            if tf:
                weight = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / average))
        if score:
            expected[i] = score
    found = {r.doc_id: r.score for r in search.rank_texts(frame, F.col("text"), terms, ["doc_id"]).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[i] - expected[i]) < 1e-5 for i in expected)


def test_phrase(frame, texts):
    def count(ws):
        return sum(ws[i:i + 2] == ["the", "the"] for i in range(len(ws)))

    expected = {i: count(words(t)) for i, t in enumerate(texts) if count(words(t))}
    found = search.search_phrase(frame, F.col("text"), "the the", ["doc_id"]).collect()
    assert {r.doc_id: r.phrase_freq for r in found} == expected
