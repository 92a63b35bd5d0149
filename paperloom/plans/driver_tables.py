"""The given tables in the roles of the data model.

documents play the corpus, conversations the comments and page texts, pages the HTML mail
bodies, events the job runs and the activity log, labels sparse metadata.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import hashing, naming
from paperloom.functions import text as tx
from paperloom.operators.block_index import BlockIndex
from paperloom.plans.columns import computed_once
from paperloom.plans.sizing import spread_small
from paperloom.schemas import KINDS, MAIL_KINDS, OFFICE_KINDS
from paperloom.session import shared_folder
from paperloom.sources.pages import first_appearance_words

SCAN_PATH = "/scan/"
URI_BASE = "https://repo.example/"
PROCESS_TIME = "2024-06-01 00:00:00"

# doc_id % 6 -> kind, in this order.
KIND_CYCLE = ("word", "excel", "powerpoint", "pdf", "eml", "msg")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out to all cores where the file is small."""
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def kind_of(doc_id: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KIND_CYCLE])
    return F.get(names, (doc_id % 6).cast("int"))


def extension_of(doc_id: Column) -> Column:
    by_name = {k.suffix: k.content_type for k in KINDS}
    names = F.array(*[F.lit(by_name[k]) for k in KIND_CYCLE])
    return F.get(names, (doc_id % 6).cast("int"))


def path_of() -> Column:
    doc_id = F.col("doc_id")
    return F.concat(
        F.lit(SCAN_PATH), F.col("source"), F.lit("/"), doc_id.cast("string"), F.lit("."),
        extension_of(doc_id),
    )


def raw_keywords() -> Column:
    doc_id = F.col("doc_id")
    return F.when(doc_id % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit("k"), (doc_id % 5).cast("string"), F.lit(","), F.col("lang"))
    )


def created_of() -> Column:
    doc_id = F.col("doc_id")
    minutes = F.make_dt_interval(mins=(doc_id).cast("int"))
    stamp = F.when(doc_id % 7 != 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + minutes)
    return naming.time_or_default(stamp)


def corpus_without_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus columns that come from one document row alone."""
    rows = computed_once(
        documents(spark, sf_dir),
        ["doc_id", "lang", "source"],
        content=tx.clean_office(F.col("text")),
    )
    path = path_of()
    raw = raw_keywords()
    return rows.select(
        "doc_id",
        hashing.path_hash(path).alias("id"),
        kind_of(F.col("doc_id")).alias("doc_type"),
        path.alias("original_file_path"),
        naming.uri_rewrite(path, SCAN_PATH, URI_BASE).alias("uri_file_path"),
        "content",
        F.col("lang").alias("creator"),
        F.col("source").alias("subject"),
        F.col("content").alias("title"),
        extension_of(F.col("doc_id")).alias("content_type"),
        raw.alias("keywords_raw"),
        tx.keywords_office(raw).alias("keywords"),
        created_of().alias("created"),
        F.lit(PROCESS_TIME).cast("timestamp").alias("process_time"),
    )


def office_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of the kinds that can have comments."""
    return conversations(spark, sf_dir).where(F.col("conv_id") % 6 < len(OFFICE_KINDS))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its content hash; comment words come pre-aggregated."""
    words = first_appearance_words(office_comments(spark, sf_dir), "conv_id", "turn", "text")
    docs = corpus_without_hash(spark, sf_dir)
    joined = docs.join(words.withColumnRenamed("conv_id", "doc_id"), "doc_id", "left")
    kind = F.col("doc_type")
    office = hashing.content_hash_office(
        {
            "created": F.col("created"),
            "content": F.col("content"),
            "creator": F.col("creator"),
            "keywords": F.col("keywords_raw"),
            "subject": F.col("subject"),
            "title": F.col("title"),
            "content_type": F.col("content_type"),
        },
        F.col("words"),
    )
    pdf = hashing.content_hash_pdf(
        F.col("content"), F.col("creator"), F.col("keywords"), F.col("title"), F.col("subject")
    )
    mail = hashing.content_hash_mail(F.col("content"), F.col("creator"), F.col("title"))
    content_hash = F.when(kind.isin(*MAIL_KINDS), mail).when(kind == "pdf", pdf).otherwise(office)
    return joined.withColumn("content_hash", content_hash).drop("words")


def comment_rows(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """Flat comments: doc_id, turn and the fields of a nested comment.

    ``only`` restricts them to the documents of a result page; the ids filter the scan.
    """
    rows = conversations(spark, sf_dir)
    if only is not None:
        rows = rows.where(F.col("conv_id").isin(*only))
    return rows.select(
        F.col("conv_id").alias("doc_id"),
        "turn",
        F.col("text").alias("comment"),
        F.col("role").alias("author"),
        naming.time_or_default(F.lit(None)).alias("date"),
        F.col("turn").cast("string").alias("id"),
        F.upper(F.substring("role", 1, 1)).alias("initials"),
    )


def nested_comments(spark: SparkSession, sf_dir: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, comments) with all comments of a document as one array in turn order."""
    comment = F.struct("comment", "author", "date", "id", "initials")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn"), comment.alias("c"))))
    rows = comment_rows(spark, sf_dir, only)
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["c"]).alias("comments"))


def commented_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows with their comments nested."""
    comments = nested_comments(spark, sf_dir)
    none = F.array().cast(comments.schema["comments"].dataType)
    rows = corpus_without_hash(spark, sf_dir).join(comments, "doc_id", "left")
    return rows.withColumn("comments", F.coalesce("comments", none))


_INDICES: dict[tuple, BlockIndex] = {}


def block_index(spark: SparkSession, sf_dir: str) -> BlockIndex:
    """The block index of the corpus: written once per application and folder of tables, read by every search after."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDICES:
        _INDICES[key] = BlockIndex(spark, f"{shared_folder(spark)}/index-{uuid4().hex}").build(commented_corpus(spark, sf_dir))
    return _INDICES[key]


def previous_state(corpus_rows: DataFrame) -> DataFrame:
    """The state a previous run left: tenth part missing, tenth part changed, some files gone."""
    doc_id = F.col("doc_id")
    known = corpus_rows.where(doc_id % 10 != 0).select(
        F.col("id").alias("path_hash"),
        F.when(doc_id % 10 == 1, F.concat(F.lit("old"), F.col("content_hash")))
        .otherwise(F.col("content_hash"))
        .alias("content_hash"),
        F.col("original_file_path").alias("original_path"),
        "doc_type",
    )
    gone_path = F.concat(F.lit(SCAN_PATH + "gone/"), doc_id.cast("string"), F.lit(".docx"))
    gone = corpus_rows.where(doc_id % 20 == 0).select(
        hashing.path_hash(gone_path).alias("path_hash"),
        F.lit("gone").alias("content_hash"),
        gone_path.alias("original_path"),
        F.lit("word").alias("doc_type"),
    )
    return known.unionByName(gone)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths a scan finds now; reads three narrow columns, no text."""
    docs = table(spark, sf_dir, "documents")
    path = path_of()
    return docs.select(hashing.path_hash(path).alias("path_hash"), path.alias("original_path"))


# Five event types play five kinds; no runs are known for the sixth.
EVENT_KINDS = (("view", "word"), ("click", "excel"), ("signup", "powerpoint"), ("purchase", "pdf"),
               ("error", "msg"))


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job runs: a run ends at ts and took ``value`` seconds."""
    events = table(spark, sf_dir, "events")
    model = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(k)) for e, k in EVENT_KINDS])
    millis = F.round(F.col("value") * 1000).cast("long")
    return events.select(
        model.alias("model"),
        F.col("event_id").cast("string").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("entire_doc_count"),
        (F.col("user_id") % 50).alias("indexed_doc_count"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("processing_error"),
        (F.col("ts") - F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))).alias("start_job"),
        F.col("ts").alias("end_job"),
        millis.alias("elapsed_time_millis"),
    )


# Three event types play what users do with an index.
EVENT_OPERATIONS = (("view", "fetch"), ("click", "query"), ("purchase", "suggest"))
