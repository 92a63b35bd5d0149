"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Everything is run twice and the better time counts, since the first run also compiles. Index
and file ingest are measured on a fresh scratch folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WORD_FILES = 2000
HEADLINE = (
    "clean_office", "content_hash_office", "suggest_terms_office", "page_assembly", "mail_documents",
    "change_detect", "change_next_state", "cleanup_orphans", "corpus_upsert", "postings", "doc_freq",
    "search_bm25", "search_two_fields", "search_phrase", "search_prefix", "search_hits",
    "search_highlight", "search_batch", "suggest", "document_detail", "index_statistics_total",
    "runtime_statistics",
)
# On the block index, which is built once before.
INDEXED = ("search_block_max", "search_combined", "search_wildcard", "search_deep_page", "search_index_postings")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def best(action, runs: int = 2) -> float:
    return min(timed(action) for _ in range(runs))


def main() -> None:
    from office_files import write_docx
    from pyspark.sql import functions as F

    from paperloom.functions import text as tx
    from paperloom.operators import batch_search, search
    from paperloom.operators import index as ix
    from paperloom.plans import driver_tables as dt
    from paperloom.plans import ingest
    from paperloom.plans.catalog import REGISTRY
    from paperloom.session import local_session
    from paperloom.sources.store import CorpusStore

    spark = local_session(CPUS, "paperloom-bench")
    scratch = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    seconds: dict[str, float] = {}

    def all_rows(name: str):
        return lambda: REGISTRY[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        seconds[name] = round(best(all_rows(name)), 3)

    seconds["block_index_build"] = round(timed(lambda: dt.block_index(spark, SF_DIR)), 3)
    for name in INDEXED:
        seconds[name] = round(best(all_rows(name)), 3)

    # Index: built once, then searched without touching a text.
    nested = dt.nested_comments(spark, SF_DIR)
    none = F.array().cast(nested.schema["comments"].dataType)
    corpus = dt.corpus_without_hash(spark, SF_DIR).join(nested, "doc_id", "left")
    corpus = corpus.withColumn("comments", F.coalesce("comments", none))
    index = str(scratch / "index")
    seconds["index_build"] = round(best(lambda: ix.write_index(corpus, index)), 3)
    tables = ix.read_postings(spark, index), ix.read_doc_freq(spark, index), ix.read_field_stats(spark, index)
    hits = lambda: search.page(search.search_index(*tables, "the elle"), 0, 10).collect()
    seconds["search_index_page"] = round(best(hits, 3), 3)

    phrases = dt.table(spark, SF_DIR, "benchmark")
    terms = F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")
    pairs = phrases.select(F.col("item_id").alias("query_id"), terms)
    sizes = tables[2].where("field = 'content'").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
    counts = tables[0].where("field = 'content'").select("id", "dl", "term", "tf")
    many = lambda: batch_search.search_batch(counts, pairs, sizes, 10).collect()
    seconds["search_batch_index"] = round(best(many), 3)

    # Files: Word documents made of the first texts, scanned, extracted, hashed, compared, written.
    rows = dt.table(spark, SF_DIR, "documents").select("doc_id", "text").orderBy("doc_id").limit(WORD_FILES).collect()
    for r in rows:
        text = r.text.replace("&", "&amp;").replace("<", "&lt;")
        write_docx(scratch / "scan" / f"{r.doc_id % 50}" / f"{r.doc_id}.docx", text.split("\n"))
    stores = [CorpusStore(spark, str(scratch / f"store{i}")) for i in range(2)]

    def run(store: CorpusStore, name: str) -> float:
        return timed(lambda: ingest.ingest(
            store, str(scratch / "scan"), "word", dt.URI_BASE, name, datetime(2024, 7, 1), str(scratch / "staging")
        ).collect())

    seconds["word_files_first_run"] = round(min(run(s, f"first{i}") for i, s in enumerate(stores)), 3)
    seconds["word_files_second_run"] = round(min(run(s, f"second{i}") for i, s in enumerate(stores)), 3)

    n_docs = dt.table(spark, SF_DIR, "documents").count()
    n_queries = dt.table(spark, SF_DIR, "benchmark").count()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"),
        "cpus": CPUS,
        "word_files_per_sec": round(len(rows) / seconds["word_files_first_run"], 1),
        "index_docs_per_sec": round(n_docs / seconds["index_build"], 1),
        "batch_queries_per_sec": round(n_queries / seconds["search_batch_index"], 1),
        "indexed_search_ms": round(seconds["search_index_page"] * 1000),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
