"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import hashing, naming
from paperloom.functions import highlight as hl
from paperloom.functions import text as tx
from paperloom.operators import availability, batch_search, changes, cleanup, detail, hits, search, stats, suggest
from paperloom.operators import corpus as corpus_ops
from paperloom.operators import index as ix
from paperloom.plans import driver_tables as dt
from paperloom.plans.columns import computed_once
from paperloom.plans.sizing import spread_small
from paperloom.schemas import INDEX_NAME
from paperloom.session import configure
from paperloom.sources import files, mail, pages, runs, state

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

LIST_SEPARATOR = "|"
KEYS = ["doc_id", "doc_type"]
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    REGISTRY[query.__name__] = run
    return run


def listed(array: Column) -> Column:
    """An array as text, so that results compare across engines."""
    return F.array_join(array, LIST_SEPARATOR)


def time_text(column: str) -> Column:
    return F.date_format(column, TIME_TEXT)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.documents(spark, sf_dir)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(dt.table(spark, sf_dir, "pages"), "page_id")


# --- sources and sinks --------------------------------------------------------------------


@registered
def page_assembly(spark, sf_dir):
    """Page texts of a document in one content string, with the page count."""
    return pages.assemble_pages(dt.conversations(spark, sf_dir), "conv_id", "turn", "text")


@registered
def page_assembly_parts(spark, sf_dir):
    """The same in parts of two pages: the form for documents of any size."""
    return pages.assemble_parts(
        dt.conversations(spark, sf_dir), "conv_id", "turn", "text", part_size=2
    )


@registered
def mail_documents(spark, sf_dir):
    """HTML pages as mail bodies turned into documents with their receivers."""
    rows = web_pages(spark, sf_dir)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    messages = rows.select(
        F.concat(F.lit("/mail/"), F.col("page_id").cast("string"), F.lit(".msg")).alias("path"),
        F.when(F.col("page_id") % 9 != 0, F.col("html")).alias("body_html"),
        F.col("url").alias("body_text"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.concat(F.lit("info@"), host).alias("sender"),
    )
    # Every page has one to three recipients.
    numbers = rows.select("page_id", F.explode(F.sequence(F.lit(0), F.col("page_id") % 3)).alias("position"))
    recipients = numbers.select(
        F.concat(F.lit("/mail/"), F.col("page_id").cast("string"), F.lit(".msg")).alias("path"),
        "position",
        F.concat(F.lit("user"), (F.col("page_id") + F.col("position")).cast("string"),
                 F.lit("@example.org")).alias("address"),
    )
    found = mail.mail_to_document(
        mail.messages_with_receivers(messages, recipients), "msg", "/mail/", dt.URI_BASE
    )
    return found.select(
        "id", "content_hash", "uri_file_path", "content", "creator", "title", "content_type",
        listed(F.col("receiver")).alias("receiver"),
        F.size("completion_content").cast("long").alias("n_terms"),
    )


@registered
def state_parse(spark, sf_dir):
    """State rows from text lines; lines with more or fewer parts are dropped."""
    parts = [F.col("lang"), F.col("source"), F.col("text")]
    lines = docs(spark, sf_dir).select(
        F.when(F.col("doc_id") % 13 == 0, F.concat_ws(";", *parts[:2]))
        .otherwise(F.concat_ws(";", *parts))
        .alias("value")
    )
    return state.parse_state_lines(lines)


def _batch(corpus_rows: DataFrame) -> DataFrame:
    """A batch of updates: an update and a repeated update of every fourth document, new ones."""
    doc_id = F.col("doc_id")
    base = corpus_rows.where(doc_id % 4 == 0).select(
        "doc_id", "id", "doc_type", "process_time", "title",
        F.length("content").cast("long").alias("n"),
    )
    first = base.withColumn("content_hash", F.lit("first")).withColumn(
        "process_time", F.col("process_time") + F.expr("INTERVAL 1 HOUR")
    )
    second = base.where(doc_id % 8 == 0).withColumn("content_hash", F.lit("second")).withColumn(
        "process_time", F.col("process_time") + F.expr("INTERVAL 2 HOURS")
    )
    fresh = base.where(doc_id % 16 == 0).withColumn("content_hash", F.lit("fresh")).withColumn(
        "id", F.concat(F.col("id"), F.lit("-copy"))
    )
    return first.unionByName(second).unionByName(fresh)


def _narrow_corpus(spark, sf_dir):
    return dt.corpus_without_hash(spark, sf_dir).select(
        "doc_id", "id", "doc_type", "process_time", "title",
        F.length("content").cast("long").alias("n"), F.lit("base").alias("content_hash"),
    )


@registered
def corpus_upsert(spark, sf_dir):
    """Bulk upsert where a batch writes some ids twice."""
    batch = _batch(dt.corpus_without_hash(spark, sf_dir))
    merged = corpus_ops.upsert(_narrow_corpus(spark, sf_dir), batch)
    return merged.select("id", "doc_type", "title", "n", "content_hash", time_text("process_time").alias("written"))


@registered
def corpus_delete(spark, sf_dir):
    """Corpus without the documents that carry a toxic label."""
    labels = dt.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    rows = dt.corpus_without_hash(spark, sf_dir)
    ids = dt.table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi").select(
        hashing.path_hash(dt.path_of()).alias("id")
    )
    return corpus_ops.delete_by_id(rows, ids).select("id", "doc_type", "title")


@registered
def full_refresh(spark, sf_dir):
    """One kind dropped and rebuilt from what a scan finds now, the others untouched."""
    rows = _narrow_corpus(spark, sf_dir)
    rescanned = rows.where(F.col("doc_id") % 18 != 3).withColumn("content_hash", F.lit("rescanned"))
    refreshed = corpus_ops.replace_kind(rows, "pdf", rescanned)
    return refreshed.select("id", "doc_type", "n", "content_hash")


@registered
def index_list(spark, sf_dir):
    """Names of existing indices by pattern."""
    rows = dt.table(spark, sf_dir, "documents").select(dt.kind_of(F.col("doc_id")).alias("doc_type"))
    return corpus_ops.list_indices(rows, f"{INDEX_NAME}-*")


@registered
def run_json_roundtrip(spark, sf_dir):
    """Runs written as JSON and read back; broken and empty texts give nothing."""
    written = runs.runs_to_json(dt.job_runs(spark, sf_dir))
    found = computed_once(written, ["model"], json=F.col("json"))
    number = F.get_json_object("json", "$.id").cast("long")
    broken = found.withColumn(
        "json",
        F.when(number % 10 == 3, F.lit("")).when(number % 10 == 7, F.lit("{broken")).otherwise(F.col("json")),
    )
    back = runs.runs_from_json(broken)
    return back.select(
        "model", "id", "entire_doc_count", "indexed_doc_count", "processing_error",
        time_text("end_job").alias("ended"), "elapsed_time_millis",
    )


# --- projections --------------------------------------------------------------------------


@registered
def metadata_defaults(spark, sf_dir):
    """Absent texts become empty, absent times 1970."""
    labels = dt.table(spark, sf_dir, "labels")
    rows = dt.table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    stamp = F.when(F.col("quality") == 1, F.lit("2024-02-03 04:05:06").cast("timestamp"))
    return rows.select(
        "doc_id",
        naming.text_or_default(F.col("quality").cast("string")).alias("category"),
        naming.text_or_default(F.when(F.col("toxic") == 1, F.col("lang"))).alias("description"),
        F.date_format(naming.time_or_default(stamp), TIME_TEXT).alias("created"),
    )


@registered
def uri_rewrite(spark, sf_dir):
    """Scan path to URI base, backslashes to slashes."""
    windows_path = F.replace("url", F.lit("/"), F.lit("\\"))
    mixed = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(windows_path)
    rows = dt.table(spark, sf_dir, "pages")
    return rows.select("page_id", naming.uri_rewrite(mixed, "https:", "ftp:").alias("uri"))


@registered
def path_hash(spark, sf_dir):
    """Document ids: SHA-256 of the path."""
    return dt.table(spark, sf_dir, "documents").select("doc_id", hashing.path_hash(dt.path_of()).alias("id"))


def _hashes(spark, sf_dir, *kinds):
    rows = dt.corpus(spark, sf_dir)
    return rows.where(F.col("doc_type").isin(*kinds)).select("doc_id", "content_hash")


@registered
def content_hash_office(spark, sf_dir):
    """Hash of metadata, content and distinct comment words."""
    return _hashes(spark, sf_dir, "word", "excel", "powerpoint")


@registered
def content_hash_pdf(spark, sf_dir):
    """Hash of content, creator, keywords, title, subject and type."""
    return _hashes(spark, sf_dir, "pdf")


@registered
def content_hash_mail(spark, sf_dir):
    """Hash of content, sender, title and type."""
    return _hashes(spark, sf_dir, "eml", "msg")


@registered
def keywords_office(spark, sf_dir):
    """Keyword text split on commas; empty text gives none."""
    found = tx.keywords_office(dt.raw_keywords())
    rows = dt.table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.size(found).cast("long").alias("n"), listed(found).alias("keywords"))


@registered
def keywords_pdf(spark, sf_dir):
    """Keyword text split on blanks; null and empty text give none."""
    rows = dt.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 11 == 0, F.lit(""))
        .when(F.col("doc_id") % 11 != 1, F.col("text"))
        .alias("raw"),
    )
    found = tx.keywords_pdf(F.col("raw"))
    return rows.select("doc_id", F.size(found).cast("long").alias("n"), listed(found).alias("keywords"))


@registered
def regex_chain(spark, sf_dir):
    """A generic chain of replacements."""
    rules = [("[aeiou]{2}", "*"), (r"\*+", "+"), (r"[\d]", "#")]
    return docs(spark, sf_dir).select("doc_id", tx.regex_chain(F.col("text"), rules).alias("text"))


@registered
def clean_office(spark, sf_dir):
    """Line breaks removed, blanks squeezed."""
    return docs(spark, sf_dir).select("doc_id", tx.clean_office(F.col("text")).alias("content"))


@registered
def clean_mail(spark, sf_dir):
    """Mail bodies reduced to letters, digits, @ and dots."""
    return docs(spark, sf_dir).select("doc_id", tx.clean_mail(F.col("text")).alias("content"))


@registered
def html_to_text(spark, sf_dir):
    """Text of HTML pages."""
    return web_pages(spark, sf_dir).select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@registered
def html_to_text_plain(spark, sf_dir):
    """Text of HTML pages without scripts and styles."""
    text = tx.html_to_text(F.col("html"), drop_script_style=True)
    return web_pages(spark, sf_dir).select("page_id", text.alias("text"))


@registered
def comments_text(spark, sf_dir):
    """Comment texts of a document joined with a blank."""
    rows = dt.nested_comments(spark, sf_dir)
    return rows.select("doc_id", tx.comments_text(F.col("comments")).alias("text"))


@registered
def comment_words(spark, sf_dir):
    """Distinct comment words of a document in order of first appearance."""
    words = pages.first_appearance_words(dt.conversations(spark, sf_dir), "conv_id", "turn", "text")
    return words.select("conv_id", listed(F.col("words")).alias("words"))


@registered
def suggest_text(spark, sf_dir):
    """Comments and content reduced to letters and blanks."""
    comments = pages.assemble_pages(dt.conversations(spark, sf_dir), "conv_id", "turn", "text").select(
        F.col("conv_id").alias("doc_id"), F.col("content").alias("comments")
    )
    rows = dt.corpus_without_hash(spark, sf_dir).select("doc_id", "content").join(comments, "doc_id", "left")
    return rows.select("doc_id", tx.suggest_text(F.col("comments"), F.col("content")).alias("text"))


@registered
def suggest_terms_office(spark, sf_dir):
    """Search-as-you-type terms of office documents."""
    cleaned = F.regexp_replace("text", tx.SUGGEST_OFFICE_JUNK, "")
    return docs(spark, sf_dir).select("doc_id", listed(tx.suggest_terms(cleaned)).alias("terms"))


@registered
def suggest_terms_pdf(spark, sf_dir):
    """Search-as-you-type terms of PDF documents."""
    return docs(spark, sf_dir).select("doc_id", listed(tx.suggest_terms_pdf(F.col("text"))).alias("terms"))


@registered
def suggest_terms_mail(spark, sf_dir):
    """Search-as-you-type terms of mails, addresses kept."""
    rows = computed_once(docs(spark, sf_dir), ["doc_id"], content=tx.clean_mail(F.col("text")))
    return rows.select("doc_id", listed(tx.suggest_terms_mail(F.col("content"))).alias("terms"))


@registered
def mime_type(spark, sf_dir):
    """MIME type of a document type; unknown types pass through."""
    kind = F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(dt.extension_of(F.col("doc_id")))
    return dt.table(spark, sf_dir, "documents").select("doc_id", naming.mime_type(kind).alias("mime"))


@registered
def program_icon(spark, sf_dir):
    """Icon of a document type, or the unknown icon."""
    kind = F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(dt.extension_of(F.col("doc_id")))
    return dt.table(spark, sf_dir, "documents").select("doc_id", naming.program_icon(kind).alias("icon"))


@registered
def file_name(spark, sf_dir):
    """What follows the last slash of a URL."""
    return dt.table(spark, sf_dir, "pages").select("page_id", naming.file_name(F.col("url")).alias("name"))


@registered
def download_name(spark, sf_dir):
    """File name encoded for a download link."""
    path = F.concat(F.lit("/scan/"), F.col("source"), F.lit("/"), F.col("text"))
    flat = F.regexp_replace(path, r"[\r\n]", " ")
    return dt.table(spark, sf_dir, "documents").select("doc_id", naming.download_name(flat).alias("name"))


@registered
def comment_json(spark, sf_dir):
    """Comments as JSON texts with absent members left out."""
    known = F.col("turn") % 2 == 0
    json = runs.comment_to_json(
        F.col("text"),
        F.when(known, F.col("role")),
        F.when(F.col("turn") % 3 == 0, F.lit("1986-12-05 10:31:22").cast("timestamp")),
        F.col("turn").cast("string"),
        F.when(known, F.upper(F.substring("role", 1, 1))),
    )
    return dt.conversations(spark, sf_dir).select("conv_id", "turn", json.alias("json"))


@registered
def props_from_json(spark, sf_dir):
    """JSON texts read into typed columns."""
    parsed = F.from_json("props", "k BIGINT")
    return dt.table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


# --- filters ------------------------------------------------------------------------------


@registered
def exclude_filter(spark, sf_dir):
    """Paths that do not contain a substring (taken literally)."""
    rows = dt.table(spark, sf_dir, "pages").select("page_id", "url")
    return files.exclude_paths(rows, "?page=", "url")


@registered
def search_type_filter(spark, sf_dir):
    """Hits in the chosen kinds only."""
    chosen = search.selected_kinds(flags={"word": True, "pdf": True, "msg": False, "eml": True})
    rows = search.select_kinds(dt.corpus_without_hash(spark, sf_dir), chosen)
    return _ranked(rows, "the elle")


@registered
def search_match_all(spark, sf_dir):
    """A blank phrase matches everything with score 1."""
    rows = dt.table(spark, sf_dir, "documents")
    named = rows.select(F.col("doc_id").alias("id"), dt.kind_of(F.col("doc_id")).alias("doc_type"))
    return search.search(named, " ").withColumnRenamed("id", "doc_id")


@registered
def type_availability(spark, sf_dir):
    """Which kinds exist, and which of them were asked for."""
    config = availability.type_config(spark, {"word": "word", "excel": "excel", "eml": "eml", "pdf": "gone"})
    indices = index_list(spark, sf_dir)
    return availability.type_availability(config, indices, {"word": True, "eml": False, "pdf": True})


# --- change detection and cleanup ---------------------------------------------------------


@registered
def change_detect(spark, sf_dir):
    """New and changed documents against the previous state."""
    rows = dt.corpus(spark, sf_dir)
    before = dt.previous_state(rows)
    found = changes.with_labels(rows.select("id", "content_hash", "doc_type", "doc_id"), before)
    changed = found.where(F.col("label") != changes.UNCHANGED)
    return changed.select("doc_id", "id", "doc_type", "content_hash", "label")


@registered
def change_next_state(spark, sf_dir):
    """The state after indexing the new and changed documents."""
    rows = dt.corpus(spark, sf_dir).select("doc_id", "id", "content_hash", "doc_type", "original_file_path")
    return changes.next_state(dt.previous_state(rows), rows)


@registered
def cleanup_orphans(spark, sf_dir):
    """State rows whose file is gone."""
    gone = cleanup.orphans(_path_state(spark, sf_dir), dt.listing(spark, sf_dir))
    return gone.select("path_hash", "original_path", "doc_type")


def _path_state(spark, sf_dir):
    """The previous state where only paths matter; no text is read for it."""
    doc_id = F.col("doc_id")
    rows = dt.table(spark, sf_dir, "documents").select(
        "doc_id",
        hashing.path_hash(dt.path_of()).alias("id"),
        F.lit("known").alias("content_hash"),
        dt.path_of().alias("original_file_path"),
        dt.kind_of(doc_id).alias("doc_type"),
    )
    return dt.previous_state(rows)


@registered
def cleanup_apply(spark, sf_dir):
    """State after removing the rows whose file is gone."""
    before = _path_state(spark, sf_dir)
    gone = cleanup.orphans(before, dt.listing(spark, sf_dir))
    return cleanup.without_orphans(before, gone).select("path_hash", "original_path", "doc_type")


@registered
def cleanup_counters(spark, sf_dir):
    """State rows seen and removed."""
    return cleanup.cleanup_counters(_path_state(spark, sf_dir), dt.listing(spark, sf_dir))


@registered
def ingest_counters(spark, sf_dir):
    """Documents seen, indexed and failed in one run; unlabelled languages play failures."""
    rows = dt.corpus(spark, sf_dir).withColumn("error", F.when(F.col("creator") == "fr", F.lit("failed")))
    good = rows.where(F.col("error").isNull())
    labels = changes.change_labels(good, dt.previous_state(dt.corpus(spark, sf_dir)))
    return changes.run_counters(rows, labels)


# --- index --------------------------------------------------------------------------------


@registered
def tokens(spark, sf_dir):
    """Terms with positions."""
    return ix.token_rows(docs(spark, sf_dir), F.col("text"), "doc_id").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "term"
    )


@registered
def postings(spark, sf_dir):
    """Term frequencies and positions per document."""
    found = ix.postings(docs(spark, sf_dir), F.col("text"), "doc_id")
    return found.select(
        "doc_id", "term", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"),
        F.array_join(F.col("positions").cast("array<string>"), LIST_SEPARATOR).alias("positions"),
    )


@registered
def doc_freq(spark, sf_dir):
    """Documents and occurrences per term."""
    return ix.doc_freq(ix.term_counts(docs(spark, sf_dir), F.col("text"), "doc_id"))


@registered
def vocabulary_size(spark, sf_dir):
    """Distinct completion terms per kind."""
    rows = dt.corpus_without_hash(spark, sf_dir).select("doc_type", "content")
    return stats.vocabulary_size(suggest.term_table(rows))


# --- search -------------------------------------------------------------------------------


def _ranked(rows: DataFrame, phrase: str, **options) -> DataFrame:
    return search.rank_texts(rows, F.col("content"), ix.distinct_terms(phrase), KEYS, **options)


@registered
def search_bm25(spark, sf_dir):
    """Ranked OR search."""
    return _ranked(dt.corpus_without_hash(spark, sf_dir), "the elle")


@registered
def search_all_terms(spark, sf_dir):
    """Ranked AND search."""
    return _ranked(dt.corpus_without_hash(spark, sf_dir), "the with", require_all=True)


@registered
def search_must_not(spark, sf_dir):
    """Ranked search with an excluded term."""
    return _ranked(dt.corpus_without_hash(spark, sf_dir), "der und", excluded=["with"])


@registered
def search_phrase(spark, sf_dir):
    """Phrase search on the texts."""
    rows = dt.corpus_without_hash(spark, sf_dir)
    found = search.search_phrase(rows, F.col("content"), "of the", KEYS)
    return found.select(*KEYS, F.col("phrase_freq").cast("long").alias("phrase_freq"))


@registered
def search_phrase_postings(spark, sf_dir):
    """Phrase search on positions of postings."""
    rows = dt.corpus_without_hash(spark, sf_dir)
    found = search.phrase_from_postings(ix.postings(rows, F.col("content"), *KEYS), "in the the", KEYS)
    return found.select(*KEYS, F.col("phrase_freq").cast("long").alias("phrase_freq"))


@registered
def search_prefix(spark, sf_dir):
    """Documents with a term that starts with a prefix."""
    return search.search_prefix(dt.corpus_without_hash(spark, sf_dir), F.col("content"), "erth", KEYS)


def _two_fields(spark, sf_dir, phrase: str) -> DataFrame:
    terms = ix.distinct_terms(phrase)
    rows = dt.corpus_without_hash(spark, sf_dir)
    comments = dt.conversations(spark, sf_dir).withColumnRenamed("conv_id", "doc_id")
    counts = search.combine_fields(
        search.match_counts(rows, F.col("content"), terms, KEYS),
        search.summed_match_counts(comments, F.col("text"), terms, ["doc_id"]),
        ["doc_id"],
        "comments",
        len(terms),
    )
    return search.ranked(counts, len(terms), ["content", "comments"])


@registered
def search_two_fields(spark, sf_dir):
    """Content and comments scored together."""
    return _two_fields(spark, sf_dir, "la elle the")


@registered
def search_page(spark, sf_dir):
    """Third page of ten hits."""
    return search.page(_ranked(dt.corpus_without_hash(spark, sf_dir), "the elle"), 20, 10, "doc_id")


@registered
def search_total(spark, sf_dir):
    """Exact total beside the page information."""
    found = search.search_totals(_ranked(dt.corpus_without_hash(spark, sf_dir), "the elle"), "the elle", 20, 10)
    return found.select(
        F.col("from").cast("long").alias("from"), F.col("size").cast("long").alias("size"), "total",
        "search_phrase",
    )


@registered
def search_highlight(spark, sf_dir):
    """Highlighted fragments of the first hits."""
    top = search.page(_ranked(dt.corpus_without_hash(spark, sf_dir), "the elle"), 0, 20, "doc_id")
    found = hits.joined(dt.corpus_without_hash(spark, sf_dir).select("doc_id", "content"), top, "doc_id")
    marked = hl.fragments(F.col("content"), ["the", "elle"])
    return found.select("doc_id", F.array_join(marked, "\n~\n").alias("fragments"))


@registered
def snippet_fallback(spark, sf_dir):
    """Beginnings of contents, for hits without a fragment."""
    rows = dt.corpus_without_hash(spark, sf_dir)
    return rows.select("doc_id", hl.fallback_snippet(F.col("content")).alias("snippet"))


@registered
def comment_match(spark, sf_dir):
    """The first comment that contains a fragment of the last one."""
    rows = dt.conversations(spark, sf_dir).withColumnRenamed("conv_id", "doc_id")
    last = rows.groupBy("doc_id").agg(F.max_by("text", "turn").alias("fragment"))
    found = hits.first_comments_with(rows, last, "doc_id", "turn", "text")
    return found.select(
        "doc_id", "fragment", F.col("turn").cast("string").alias("comment_id"), F.col("role").alias("author")
    )


def _comment_texts(details: str) -> Column:
    """Highlighted comments of a result row as text."""
    comment = F.transform(
        details,
        lambda c: F.concat_ws(
            LIST_SEPARATOR, c["comment_text"], c["author"], F.date_format(c["date"], TIME_TEXT), c["id"],
            c["initials"],
        ),
    )
    return F.array_join(comment, "\n~\n")


@registered
def comment_highlights(spark, sf_dir):
    """Highlighted comments with their origin for every document that has any."""
    terms = ["la", "elle", "the"]
    nested = hits.hit_comments(dt.comment_rows(spark, sf_dir), terms, "doc_id", "turn")
    found = nested.select("doc_id", hits.comment_details(F.col("comments"), terms).alias("details"))
    return found.select("doc_id", _comment_texts("details").alias("comments"))


@registered
def search_hits(spark, sf_dir):
    """Full result rows of the first hits over content and comments: search, then join."""
    phrase = "la elle the"
    page = search.page(_two_fields(spark, sf_dir, phrase), 0, 25, "doc_id").select("doc_id", "score")
    terms = ix.distinct_terms(phrase)
    about = dt.comment_rows(spark, sf_dir).join(page.select("doc_id"), "doc_id", "left_semi")
    comments = hits.hit_comments(about, terms, "doc_id", "turn")
    none = F.array().cast(comments.schema["comments"].dataType)
    rows = hits.joined(dt.corpus_without_hash(spark, sf_dir), page, "doc_id")
    rows = rows.join(comments, "doc_id", "left").withColumn("comments", F.coalesce("comments", none))
    found = hits.hit_rows(rows, terms)
    return found.select(
        "relative_url", "id", time_text("process_time").alias("process_time"), "absolute_url",
        "document_type", "index_name", F.array_join("contents", "\n~\n").alias("contents"),
        _comment_texts("comments").alias("comments"), "relevance", "program_icon",
    )


@registered
def search_batch(spark, sf_dir):
    """Top ten documents for every text of a query table."""
    phrases = dt.table(spark, sf_dir, "benchmark")
    found = F.explode(F.array_distinct(tx.tokens(F.col("text"))))
    pairs = phrases.select(F.col("item_id").alias("query_id"), found.alias("term"))
    rows = docs(spark, sf_dir)
    lengths = computed_once(rows, [], dl=F.size(tx.tokens(F.col("text"))))
    counts = batch_search.batch_counts(rows, F.col("text"), pairs, "doc_id")
    top = batch_search.search_batch(counts, pairs, ix.field_stats(lengths), 10, "doc_id")
    return top.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# --- suggest and detail -------------------------------------------------------------------


@registered
def suggest_prefix(spark, sf_dir):
    """Suggestions for a prefix over all kinds, from contents and comments."""
    rows = dt.corpus_without_hash(spark, sf_dir).select("doc_type", "content")
    comments = dt.office_comments(spark, sf_dir).select(
        dt.kind_of(F.col("conv_id")).alias("doc_type"), F.col("text").alias("content")
    )
    found = suggest.suggest(suggest.term_table(rows.unionByName(comments)), "Er")
    return found.select("label", listed(F.col("index_names")).alias("index_names"))


REGISTRY["suggest"] = REGISTRY.pop("suggest_prefix")


def _detail_texts(found: DataFrame) -> DataFrame:
    times = {n: time_text(n) for n in detail.DETAIL_TIMES}
    return found.select(*[times.get(c, F.col(c)).alias(c) for c in found.columns])


@registered
def document_details(spark, sf_dir):
    """Detail rows of all documents."""
    return _detail_texts(detail.detail_columns(dt.corpus_without_hash(spark, sf_dir)))


@registered
def document_detail(spark, sf_dir):
    """Detail of the word document added last, looked up by its id."""
    rows = dt.corpus_without_hash(spark, sf_dir)
    newest = rows.where(F.col("doc_type") == "word").agg(F.max_by("id", "doc_id")).first()[0]
    return _detail_texts(detail.document_detail(rows, newest or "", "word"))


@registered
def document_detail_missing(spark, sf_dir):
    """The default row for an id nobody has."""
    rows = dt.corpus_without_hash(spark, sf_dir)
    return _detail_texts(detail.document_detail(rows, "no-such-id", "word"))


# --- statistics ---------------------------------------------------------------------------


@registered
def index_statistics(spark, sf_dir):
    """Documents and bytes per index."""
    return stats.index_statistics(dt.corpus_without_hash(spark, sf_dir))


@registered
def index_statistics_total(spark, sf_dir):
    """The same with totals."""
    return stats.index_statistics_total(dt.corpus_without_hash(spark, sf_dir))


@registered
def activity_counters(spark, sf_dir):
    """Calls and milliseconds per operation."""
    log = dt.table(spark, sf_dir, "events")
    return stats.activity_counters(log, "event_type", F.round(F.col("value") * 1000))


@registered
def index_activity(spark, sf_dir):
    """Documents, bytes, and fetches, queries and suggestions with their milliseconds per index."""
    operation = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(o)) for e, o in dt.EVENT_OPERATIONS])
    log = dt.table(spark, sf_dir, "events").select(
        dt.kind_of(F.col("user_id")).alias("doc_type"), operation.alias("operation"),
        F.round(F.col("value") * 1000).cast("long").alias("millis"),
    )
    return stats.index_activity(dt.corpus_without_hash(spark, sf_dir), log)


@registered
def latest_run(spark, sf_dir):
    """Latest run per model."""
    latest = stats.latest_run(dt.job_runs(spark, sf_dir))
    return latest.select(
        "model", "id", "entire_doc_count", "indexed_doc_count", "processing_error",
        time_text("start_job").alias("start_job"), time_text("end_job").alias("end_job"),
        "elapsed_time_millis",
    )


def _processors(spark, sf_dir):
    kinds = dt.table(spark, sf_dir, "documents").select(dt.kind_of(F.col("doc_id")).alias("model")).distinct()
    return kinds.select("model", F.initcap("model").alias("short_name"))


def _job_states(spark, sf_dir):
    """State of a job by the newest entry of the activity log about it; two have none."""
    log = dt.job_runs(spark, sf_dir).where(F.col("model").isin("word", "excel", "msg"))
    state_of = F.when(F.col("entire_doc_count") % 2 == 0, stats.JOB_STATES[0]).otherwise(stats.JOB_STATES[1])
    return log.groupBy("model").agg(F.max_by(state_of, F.struct("end_job", "id")).alias("job_state"))


@registered
def runtime_statistics(spark, sf_dir):
    """Processors with their latest run and job state."""
    latest = stats.latest_run(dt.job_runs(spark, sf_dir))
    found = stats.runtime_statistics(_processors(spark, sf_dir), latest, _job_states(spark, sf_dir))
    return found.select(
        "short_name", "id", "entire_doc_count", "indexed_doc_count", "processing_error",
        time_text("start_job").alias("start_job"), time_text("end_job").alias("end_job"),
        "elapsed_time_millis", "job_state",
    )


@registered
def job_state_report(spark, sf_dir):
    """Processing and cleanup jobs with their state, undefined where none is known."""
    jobs = _processors(spark, sf_dir).select("model")
    both = stats.tagged_union(jobs, jobs)
    return stats.job_state_report(both, _job_states(spark, sf_dir))


@registered
def runs_tagged_union(spark, sf_dir):
    """Processing and cleanup runs in one frame."""
    found = dt.job_runs(spark, sf_dir).select("model", "id", "elapsed_time_millis")
    odd = F.col("id").cast("long") % 2 == 1
    return stats.tagged_union(found.where(~odd), found.where(odd))
