"""File scans, extraction and whole runs over a small folder."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from office_files import write_docx, write_scan
from pyspark.sql import functions as F

from paperloom.operators import search
from paperloom.plans import ingest
from paperloom.sources import files, mail, office, runs
from paperloom.sources.store import CorpusStore

NOW = datetime(2024, 7, 1)
BASE = "https://repo.example/"


@pytest.fixture
def scan(folder):
    return write_scan(folder / "scan")


def names(df):
    return sorted(r.path.rsplit("/", 1)[-1] for r in df.select("path").collect())


def test_scan(spark, scan):
    assert names(files.list_files(spark, str(scan), "*.docx", "~$")) == ["a.docx", "b.docx", "bad.docx"]
    on_disk = sorted(p.name for p in scan.rglob("*") if p.is_file())
    assert names(files.list_files(spark, str(scan), "*")) == on_disk


def test_listing_reads_no_content(spark, scan):
    plan = files.list_files(spark, str(scan))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_word(spark, scan):
    found = office.extract_ooxml(files.scan_files(spark, str(scan), "*.docx", "~$"), "word")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in found.collect()}
    a = rows["a.docx"]
    assert a.content.split() == "First line second line".split()
    assert (a.title, a.creator, a.keywords, a.created) == ("T", "Ann", "a,b", datetime(2024, 1, 2, 3, 4, 5))
    c = a.comments[0]
    assert (c.comment, c.author, c.id, c.initials) == ("A remark", "Bob", "7", "B")
    assert c.date == datetime(2024, 5, 6, 7, 8, 9)
    assert "BadZipFile" in rows["bad.docx"].error and rows["bad.docx"].content is None


def test_excel_and_powerpoint(spark, scan):
    sheet = office.extract_ooxml(files.scan_files(spark, str(scan), "*.xlsx"), "excel").first()
    assert (sheet.content, sheet.comments[0].comment) == ("Alpha Beta", "cell remark")
    slides = office.extract_ooxml(files.scan_files(spark, str(scan), "*.pptx"), "powerpoint").first()
    assert slides.content.split() == "Slide one Slide two".split()
    assert slides.slide_count == 2
    assert (slides.comments[0].comment, slides.comments[0].date) == ("slide remark", datetime(2024, 2, 3, 4, 5, 6))


def test_wrong_main_part_gives_no_row(spark, scan):
    found = office.extract_ooxml(files.scan_files(spark, str(scan), "*.xlsx"), "word")
    assert found.count() == 0


def test_eml(spark, scan):
    messages = mail.extract_eml(files.scan_files(spark, str(scan), "*.eml"))
    row = mail.mail_to_document(messages, "eml", str(scan) + "/", BASE).first()
    assert row.content.strip() == "Dear Bob Bye"
    assert (row.title, row.creator, row.uri_file_path) == ("Hello", "ann@example.org", BASE + "m.eml")
    assert row.receiver == ["bob@example.org", "cid@example.org", "dan@example.org"]


def run(spark, store, scan, folder, number, kind="word", **kwargs):
    row = ingest.ingest(
        store, str(scan), kind, BASE, f"r{number}", NOW, str(folder / "staging"), **kwargs
    ).first()
    return row.entire_doc_count, row.indexed_doc_count, row.processing_error


def test_ingest_runs(spark, scan, folder):
    store = CorpusStore(spark, str(folder / "store"))
    assert run(spark, store, scan, folder, 1) == (3, 2, 1)
    assert run(spark, store, scan, folder, 2) == (3, 0, 1)
    original = (scan / "a.docx").read_bytes()
    write_docx(scan / "a.docx", ["Changed text"])
    assert run(spark, store, scan, folder, 3) == (3, 1, 1)
    (scan / "a.docx").write_bytes(original)
    assert run(spark, store, scan, folder, 4) == (3, 1, 1)
    (row,) = store.current(["word"]).where(F.col("uri_file_path").contains("a.docx")).collect()
    assert row.content.split()[0] == "First" and row.keywords == ["a", "b"]
    assert row.completion_content == ["remark", "first", "line", "second"]
    assert search.search(store.current(), "remark").count() == 1


def test_cleanup_and_refresh(spark, scan, folder):
    store = CorpusStore(spark, str(folder / "store"))
    run(spark, store, scan, folder, 1)
    listing = files.list_files(spark, str(scan), "*.docx", "~$")
    assert ingest.cleanup_run(store, "word", listing, NOW) == (2, 0)
    kept = listing.where(~F.col("path").contains("b.docx"))
    assert ingest.cleanup_run(store, "word", kept, NOW) == (2, 1)
    assert names(store.current().withColumnRenamed("original_file_path", "path")) == ["a.docx"]
    assert store.state("word").count() == 1
    assert run(spark, store, scan, folder, 2) == (3, 1, 1)
    assert run(spark, store, scan, folder, 3, full_refresh=True) == (3, 2, 1)
    assert store.layers("word") == ["layer=000004-base"]


def test_all_file_kinds(spark, scan, folder):
    store = CorpusStore(spark, str(folder / "store"))
    for kind in ("word", "excel", "powerpoint", "eml"):
        run(spark, store, scan, folder, 1, kind)
    assert store.existing() == ["word", "excel", "powerpoint", "eml"]
    assert store.current().count() == 5


def test_run_records(spark, scan, folder):
    store = CorpusStore(spark, str(folder / "store"))
    row = ingest.ingest(store, str(scan), "word", BASE, "r1", NOW, str(folder / "staging"))
    ingest.record_run(row, str(folder / "runs"))
    ingest.record_run(row, str(folder / "runs"))
    back = runs.read_runs(spark, str(folder / "runs"))
    assert {(r.model, r.id, r.indexed_doc_count) for r in back.collect()} == {("word", "r1", 2)}
    assert back.count() == 2


def test_pdf_pages(spark):
    meta = spark.createDataFrame([("/s/a.pdf", "c", "x y", "s", "t")],
                                 "path string, creator string, keywords string, subject string, title string")
    texts = spark.createDataFrame([("/s/a.pdf", 2, "two"), ("/s/a.pdf", 1, "one")], "path string, page int, text string")
    row = ingest.pages_to_document(meta, texts, "/s/", BASE, NOW).first()
    assert (row.content, row.page_count, row.keywords) == ("one two", 2, ["x", "y"])


def test_a_second_run_opens_only_what_was_written_since(spark, folder):
    """Files of an earlier time are not listed; ones that are too large are counted as failed and not read."""
    scan, store = folder / "scan", CorpusStore(spark, str(folder / "store"))
    for i in range(3):
        write_docx(scan / f"{i}.docx", [f"Text {i}"])
        os.utime(scan / f"{i}.docx", (1_700_000_000 + i, 1_700_000_000 + i))
    ingest.ingest(store, str(scan), "word", BASE, "r1", NOW)
    write_docx(scan / "1.docx", ["Text 1 anew"])
    write_docx(scan / "3.docx", ["word " * 9000 + str(k) for k in range(40)])
    since = datetime(2024, 1, 1)
    found = files.scan_files(spark, str(scan), "*.docx", modified_after=since)
    assert names(found) == ["1.docx", "3.docx"]
    limit = (scan / "1.docx").stat().st_size
    run = ingest.ingest(store, str(scan), "word", BASE, "r2", NOW, modified_after=since, largest=limit).first()
    assert (run.entire_doc_count, run.indexed_doc_count, run.processing_error) == (2, 1, 1)
    assert sorted(r.content.strip() for r in store.current().collect()) == ["Text 0", "Text 1 anew", "Text 2"]
    assert "too large" in ingest.extract_files(spark, str(scan), "word", since, limit).where("error is not null").first().error
    with pytest.raises(ValueError, match="all files"):
        ingest.ingest(store, str(scan), "word", BASE, "r3", NOW, full_refresh=True, modified_after=since)
