"""Ingest and cleanup runs over files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import hashing, naming
from paperloom.functions import text as tx
from paperloom.operators import changes, cleanup
from paperloom.operators.corpus import last_write_per_id
from paperloom.plans.columns import computed_once
from paperloom.schemas import KIND_BY_NAME, MAIL_KINDS, OFFICE_KINDS, RUN_SCHEMA
from paperloom.session import arrow_batch, shared_folder
from paperloom.sources import files, mail, office, runs
from paperloom.sources.store import CorpusStore

TEXT_FIELDS = (
    "category", "creator", "description", "identifier", "language", "revision", "subject", "title",
    "version", "content_status", "last_modified_by",
)
TIME_FIELDS = ("created", "modified", "last_printed")
# Arrow batches of file contents: few files per batch, since one file may be large.
FILES_PER_BATCH = 16


def office_to_document(extracted: DataFrame, kind: str, scan_path: str, uri_base: str,
                       process_time: datetime, join_lines_with: str = "") -> DataFrame:
    """Corpus rows of extracted office files, with the ``error`` of files that could not be read."""
    defaults = {n: naming.text_or_default(F.col(n)) for n in (*TEXT_FIELDS, "keywords")}
    defaults |= {n: naming.time_or_default(F.col(n)) for n in TIME_FIELDS}
    keep = ["path", "slide_count", "comments", "error", *defaults]
    cleaned = computed_once(
        extracted.withColumns(defaults), keep, content=tx.clean_office(F.col("content"), join_lines_with)
    )
    content_type = KIND_BY_NAME[kind].content_type
    fields = {n: F.col(n) for n in (*defaults, "content")} | {"content_type": F.lit(content_type)}
    return cleaned.select(
        hashing.path_hash(F.col("path")).alias("id"),
        F.lit(kind).alias("doc_type"),
        hashing.content_hash_office(fields, tx.comment_words(F.col("comments"))).alias("content_hash"),
        F.col("path").alias("original_file_path"),
        naming.uri_rewrite(F.col("path"), scan_path, uri_base).alias("uri_file_path"),
        "content",
        tx.suggest_terms(
            tx.suggest_text(tx.comments_text(F.col("comments")), F.col("content"))
        ).alias("completion_content"),
        F.lit(content_type).alias("content_type"),
        tx.keywords_office(F.col("keywords")).alias("keywords"),
        F.lit(process_time).cast("timestamp").alias("process_time"),
        "comments",
        *TEXT_FIELDS,
        *TIME_FIELDS,
        "slide_count",
        "error",
    )


def pages_to_document(metadata: DataFrame, page_texts: DataFrame, scan_path: str, uri_base: str,
                      process_time: datetime) -> DataFrame:
    """Corpus rows of PDF metadata (path, creator, keywords, subject, title) and page texts."""
    from paperloom.sources.pages import assemble_pages

    joined = metadata.join(assemble_pages(page_texts, "path", "page", "text"), "path", "left")
    rows = joined.withColumns(
        {n: naming.text_or_default(F.col(n)) for n in ("content", "creator", "subject", "title")}
    ).withColumn("keywords", tx.keywords_pdf(F.col("keywords")))
    content_hash = hashing.content_hash_pdf(
        F.col("content"), F.col("creator"), F.col("keywords"), F.col("title"), F.col("subject")
    )
    return rows.select(
        hashing.path_hash(F.col("path")).alias("id"),
        F.lit("pdf").alias("doc_type"),
        content_hash.alias("content_hash"),
        F.col("path").alias("original_file_path"),
        naming.uri_rewrite(F.col("path"), scan_path, uri_base).alias("uri_file_path"),
        "content",
        tx.suggest_terms_pdf(F.col("content")).alias("completion_content"),
        "creator", "subject", "title",
        F.lit("pdf").alias("content_type"),
        "keywords",
        F.lit(process_time).cast("timestamp").alias("process_time"),
        F.coalesce(F.col("page_count").cast("int"), F.lit(0)).alias("page_count"),
    )


def extract_files(spark: SparkSession, scan_path: str, kind: str, modified_after: datetime | None = None,
                  largest: int = files.LARGEST_FILE) -> DataFrame:
    """Scan and extract the files of one kind (office or eml); bad and oversized files carry ``error``."""
    entry = KIND_BY_NAME[kind]
    found = files.scan_files(spark, scan_path, entry.glob, entry.exclude, modified_after)
    readable_files = files.fitting(found, largest)
    if kind in OFFICE_KINDS:
        extracted = office.extract_ooxml(readable_files, kind)
    elif kind == "eml":
        extracted = mail.extract_eml(readable_files)
    else:
        raise ValueError(f"no file reader for {kind}: give its texts as a table")
    return extracted.unionByName(files.oversized(found, largest), allowMissingColumns=True)


def to_documents(extracted: DataFrame, kind: str, scan_path: str, uri_base: str,
                 process_time: datetime) -> DataFrame:
    """Corpus rows of extracted files plus ``error``."""
    if kind in MAIL_KINDS:
        rows = mail.mail_to_document(extracted, kind, scan_path, uri_base)
        return rows.withColumn("process_time", F.lit(process_time).cast("timestamp"))
    return office_to_document(extracted, kind, scan_path, uri_base, process_time)


def readable(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("error").isNull()).drop("error")


def ingest_documents(store: CorpusStore, kind: str, docs: DataFrame, full_refresh: bool = False,
                     tag: str = "") -> tuple[int, int]:
    """Bring documents of one kind into the store; returns how many were seen and indexed.

    ``docs`` should come from a stored table, since it is read for the labels and for the
    changed rows. Only ids and hashes are joined with the state. The first run and a full
    refresh write a new base and compare nothing. Of rows with one id the latest is taken.
    """
    docs = last_write_per_id(docs)
    if full_refresh or not store.layers(kind):
        store.replace(kind, docs)
        n = docs.count()
        return n, n
    labels = changes.change_labels(docs, store.state(kind))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    indexed = sum(n for label, n in counts.items() if label != changes.UNCHANGED)
    if indexed:
        changed = changes.changed_documents(docs, store.state(kind)).drop("label")
        store.append(kind, changed, tag, filled=True)
    return sum(counts.values()), indexed


def ingest(store: CorpusStore, scan_path: str, kind: str, uri_base: str, run_id: str, now: datetime,
           staging: str | None = None, full_refresh: bool = False,
           modified_after: datetime | None = None, largest: int = files.LARGEST_FILE) -> DataFrame:
    """One run over files: scan, extract, stage, compare, write; returns the run's row.

    With ``modified_after``, the start of the last run, only files written since are opened; give
    a full refresh none, as it drops what the scan does not find.

    Extraction and cleaning are the costly part, so their result is written once to ``staging``,
    by default below the folder the cluster shares.
    What follows reads that table, and an executor lost later costs no second extraction.
    """
    spark = store.spark
    started = datetime.now()
    path = f"{staging or shared_folder(spark)}/documents-{kind}-{run_id}"
    if full_refresh and modified_after is not None:
        raise ValueError("a full refresh has to see all files")
    extracted = extract_files(spark, scan_path, kind, modified_after, largest)
    with arrow_batch(spark, FILES_PER_BATCH):
        to_documents(extracted, kind, scan_path, uri_base, now).write.mode("overwrite").parquet(path)
    staged = spark.read.parquet(path)
    failed = staged.where(F.col("error").isNotNull()).count()
    seen, indexed = ingest_documents(store, kind, readable(staged), full_refresh)
    elapsed = int((datetime.now() - started).total_seconds() * 1000)
    row = (run_id, seen + failed, indexed, failed, now, now + (datetime.now() - started), elapsed)
    return spark.createDataFrame([row], RUN_SCHEMA).withColumn("model", F.lit(kind))


def record_run(run: DataFrame, path: str) -> None:
    runs.write_run(run, path)


def cleanup_run(store: CorpusStore, kind: str, listing: DataFrame, now: datetime) -> tuple[int, int]:
    """Remove documents whose file is gone (listing: column ``path``); returns seen and removed."""
    state = store.state(kind)
    listed = listing.select(hashing.path_hash(F.col("path")).alias("path_hash"))
    counters = cleanup.cleanup_counters(state, listed).first()
    if counters["removed_files"]:
        gone = cleanup.orphans(state, listed)
        store.delete(kind, gone.select(F.col("path_hash").alias("id")), now)
    return counters["all_files"], counters["removed_files"]
