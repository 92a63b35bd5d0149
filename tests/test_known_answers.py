"""Known answers of single expressions and operators."""

from __future__ import annotations

from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from paperloom.functions import hashing, naming
from paperloom.functions import highlight as hl
from paperloom.functions import text as tx
from paperloom.operators import availability, hits, search, stats
from paperloom.operators import index as ix
from paperloom.sources import files, office, runs, state
from paperloom.sources.office import WORD_NS

FOX = "The quick brown fox jumps over the lazy dog"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hash(spark):
    text = F.lit("the quick brown fox jumps over the lazy dog")
    assert value(spark, hashing.path_hash(text)) == (
        "05c6e08f1d9fdafa03147fcb8f82f124c76d2f70e3d989dc8aadb5e7d7450bec"
    )


def test_suggest_text_keeps_umlauts(spark):
    comment = "Fritz jagt im total verwahrlosten Taxi quer durch München"
    content = "Fritz jagt im total verwahrlosten Taxi quer durch Berlin"
    assert value(spark, tx.suggest_text(F.lit(comment), F.lit(content))) == f"{comment} {content}"


def test_suggest_text_drops_junk(spark):
    junk = "T§h$e &q+u/i?ck \\b[r=o<wn fo>x jump´s ove'r the l@a{z€y do!§g}"
    assert value(spark, tx.suggest_text(F.lit(junk), F.lit(junk))) == f"{FOX} {FOX}"


def test_suggest_terms(spark):
    terms = value(spark, tx.suggest_terms(F.lit("The quick brown fo jumps over the lazy do")))
    assert terms == ["the", "quick", "brown", "jumps", "over", "lazy"]


def test_suggest_terms_pdf_cuts_capital_umlauts(spark):
    assert value(spark, tx.suggest_terms_pdf(F.lit("Übung über Maß"))) == ["bung", "über", "maß"]


def test_suggest_terms_mail_keeps_addresses(spark):
    assert value(spark, tx.suggest_terms_mail(F.lit("Ann@Example.org 12 a-b-c"))) == ["ann@example.org", "abc"]


def test_element_text():
    body = ElementTree.fromstring(
        f'<w:document xmlns:w="{WORD_NS}"><w:body><w:p><w:t>Text List A</w:t></w:p>'
        "<w:p><w:t>Text List B</w:t></w:p></w:body></w:document>"
    )
    assert office.document_text([body], "word") == "Text List A Text List B"


def test_element_text_breaks_and_fields():
    body = ElementTree.fromstring(
        f'<w:document xmlns:w="{WORD_NS}"><w:body><w:p><w:r><w:t>a</w:t><w:br/><w:t>b</w:t></w:r>'
        '<w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r>'
        "</w:p></w:body></w:document>"
    )
    assert office.document_text([body], "word").split() == ["a", "b"]


def test_regex_chain(spark):
    chained = tx.regex_chain(F.lit(FOX), [("o", ""), ("u", "")])
    assert value(spark, chained) == "The qick brwn fx jmps ver the lazy dg"


@pytest.mark.parametrize(
    ("paths", "excluded", "kept"),
    [
        (["file1.txt", "file2.tyt", "file3.tzt"], ".txt", ["file2.tyt", "file3.tzt"]),
        (["file1.txt", "file2.txt", "file3.txt"], "", ["file1.txt", "file2.txt", "file3.txt"]),
        (["a.docx", "~$a.docx"], "~$", ["a.docx"]),
    ],
)
def test_exclude_filter(spark, paths, excluded, kept):
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in files.exclude_paths(rows, excluded).collect()] == kept


def test_comment_json(spark):
    none = F.lit(None).cast("string")
    short = runs.comment_to_json(F.lit("CommentText"), none, F.lit(None).cast("timestamp"), none, none)
    assert value(spark, short) == '{"commentText":"CommentText"}'
    date = F.lit("1986-12-05 10:31:22").cast("timestamp")
    full = runs.comment_to_json(F.lit("CommentText"), F.lit("Author"), date, F.lit("1"), F.lit("Initials"))
    assert value(spark, full) == (
        '{"commentText":"CommentText","author":"Author","date":"1986-12-05T10:31:22","id":"1",'
        '"initials":"Initials"}'
    )


def test_request_from_json_and_response_to_json(spark):
    flags = ["filterEml", "filterWord", "filterPowerpoint", "filterPdf", "filterMsg", "filterExcel"]
    text = "{" + ",".join(f'"{f}":true' for f in flags) + ',"itemsPerPage":45}'
    schema = ", ".join(f"{f} boolean" for f in flags) + ", itemsPerPage int"
    parsed = value(spark, F.from_json(F.lit(text), schema))
    assert all(parsed[f] for f in flags) and parsed["itemsPerPage"] == 45
    members = F.struct(F.lit(False).alias("filterExcel"), F.lit(True).alias("filterWord"), F.lit(2).alias("itemsPerPage"))
    assert value(spark, F.to_json(members)) == '{"filterExcel":false,"filterWord":true,"itemsPerPage":2}'


def test_availability(spark):
    config = availability.type_config(spark, {"eml": "eml"})
    names = [("officedocuments-eml",), ("officedocuments-word",), ("officedocuments-excel",)]
    indices = spark.createDataFrame(names, "index_name string")
    asked = {"eml": True, "msg": False, "excel": False, "word": True, "powerpoint": False, "pdf": True}
    found = {r.kind: (r.active, r["filter"]) for r in
             availability.type_availability(config, indices, asked).collect()}
    assert found["eml"] == (True, True)
    assert {found[k] for k in found if k != "eml"} == {(False, False)}


def test_option_filter(spark):
    rows = spark.createDataFrame([(8,), (None,), (5,), (1,), (None,)], "v int").where(F.col("v").isNotNull())
    assert [r.v for r in rows.collect()] == [8, 5, 1]


def test_keywords(spark):
    assert value(spark, tx.keywords_office(F.lit(""))) == []
    assert value(spark, tx.keywords_office(F.lit("a, b"))) == ["a", " b"]
    assert value(spark, tx.keywords_pdf(F.lit(None).cast("string"))) == []
    assert value(spark, tx.keywords_pdf(F.lit("a b"))) == ["a", "b"]


def test_names(spark):
    assert value(spark, naming.uri_rewrite(F.lit("d:\\temp\\x\\y.docx"), "d:\\temp", "https://r/")) == "https://r//x/y.docx"
    assert value(spark, naming.mime_type(F.lit("pdf"))) == "application/pdf"
    assert value(spark, naming.mime_type(F.lit("zip"))) == "zip"
    assert value(spark, naming.program_icon(F.lit("zip"))) == "./images/unknown.svg"
    assert value(spark, naming.download_name(F.lit("/a/b c.docx"))) == "b+c.docx"


def test_state_lines(spark):
    lines = spark.createDataFrame([("h;p;/x",), ("h;p",), ("h;p;/x;y",)], "value string")
    assert [tuple(r) for r in state.parse_state_lines(lines).collect()] == [("p", "h", "/x")]


def test_unreadable_run_gives_nothing(spark):
    lines = spark.createDataFrame([("",), ("{oops",), ('{"id":"1","entire_doc_count":3}',)], "json string")
    assert [(r.id, r.entire_doc_count) for r in runs.runs_from_json(lines).collect()] == [("1", 3)]


def test_highlight_escapes_after_marking(spark):
    found = value(spark, hl.fragments(F.lit("a < b & amp AMPère"), ["amp"]))
    assert found == [f"a &lt; b &amp; {hl.START_TAG}amp{hl.END_TAG} AMPère"]
    assert value(spark, hl.fragments(F.lit(""), ["x"])) == []


def test_fallback_snippet(spark):
    assert value(spark, hl.fallback_snippet(F.lit("x" * 600))) == "x" * 512 + " ..."
    assert value(spark, hl.fallback_snippet(F.lit("x" * 512))) == "x" * 512


def test_html_without_script(spark):
    html = F.lit("<p>a</p><!-- c --><script>var t=1;</script>b")
    assert value(spark, tx.html_to_text(html)).split() == ["a", "var", "t=1;", "b"]
    assert value(spark, tx.html_to_text(html, drop_script_style=True)).split() == ["a", "b"]


def test_selected_kinds():
    assert search.selected_kinds(existing=["word", "msg"], flags={"word": True, "pdf": True}) == ["word"]
    assert search.selected_kinds() == ["word", "excel", "powerpoint", "pdf", "eml", "msg"]


def test_latest_run_and_state_default(spark):
    rows = [("word", "1", datetime(2024, 1, 1)), ("word", "2", datetime(2024, 1, 2)), ("pdf", "3", datetime(2023, 1, 1))]
    latest = stats.latest_run(spark.createDataFrame(rows, "model string, id string, end_job timestamp"))
    assert {(r.model, r.id) for r in latest.collect()} == {("word", "2"), ("pdf", "3")}
    jobs = spark.createDataFrame([("processing", "word"), ("processing", "pdf")], "group_name string, model string")
    known = spark.createDataFrame([("word", "Running")], "model string, job_state string")
    report = {r.model: r.job_state for r in stats.job_state_report(jobs, known).collect()}
    assert report == {"word": "Running", "pdf": "Undefined"}


def test_highlight_keeps_words_whole_and_marks_clean(spark):
    text = "x" * 496 + " therapy"
    assert value(spark, hl.fragments(F.lit(text), ["the"])) == []
    assert value(spark, hl.fragments(F.lit(text), ["therapy"])) == [f"{hl.START_TAG}therapy{hl.END_TAG}"]
    assert value(spark, hl.fragments(F.lit("abc \x03 def"), ["zzz"])) == []
    long = value(spark, hl.fragments(F.lit("y" * 1200 + " hit"), ["hit"]))
    assert long == [f"{hl.START_TAG}hit{hl.END_TAG}"]


def test_comment_origin_survives_escaping(spark):
    comment = F.struct(*[F.lit(v).alias(n) for n, v in (
        ("comment", "don't touch the file"), ("author", "ann"), ("date", None), ("id", "4"), ("initials", "a"))])
    found = value(spark, hits.comment_details(F.array(comment), ["touch"]))
    assert [(d["author"], d["id"]) for d in found] == [("ann", "4")]


def test_empty_pages_and_phrases(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert hits.fetched(docs, {}, "doc_id").columns == ["doc_id", "text", "score"]
    assert hits.fetched(docs, {}, "doc_id").count() == 0
    posted = ix.postings(docs, F.col("text"), "doc_id")
    assert search.phrase_from_postings(posted, "?!", ["doc_id"]).count() == 0
    assert search.search_phrase(docs, F.col("text"), " ", ["doc_id"]).count() == 0
    words = " ".join(f"w{k}" for k in range(70))
    rows = spark.createDataFrame([(1, f"x {words} y"), (2, words.replace("w69", "w0"))], "doc_id long, text string")
    found = search.phrase_from_postings(ix.postings(rows, F.col("text"), "doc_id"), words, ["doc_id"]).collect()
    assert [(r.doc_id, r.phrase_freq) for r in found] == [(1, 1)]
