"""Mail messages: from tables of messages and from EML files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import hashing, naming
from paperloom.functions import text as tx
from paperloom.plans.columns import computed_once
from paperloom.schemas import MAIL_SCHEMA

ERROR = "error"


def mail_to_document(messages: DataFrame, doc_type: str, scan_path: str, uri_base: str,
                     drop_script_style: bool = False) -> DataFrame:
    """Corpus rows of messages (path, body_html, body_text, title, sender, receiver).

    The HTML body wins over the plain one. An ``error`` column is carried along.
    """
    body = F.coalesce(tx.html_to_text(F.col("body_html"), drop_script_style), F.col("body_text"))
    keep = ["path", "title", "sender", "receiver", *([ERROR] if ERROR in messages.columns else [])]
    clean = computed_once(messages, keep, content=tx.clean_mail(body))
    content = F.col("content")
    return clean.select(
        hashing.path_hash(F.col("path")).alias("id"),
        F.lit(doc_type).alias("doc_type"),
        hashing.content_hash_mail(content, F.col("sender"), F.col("title")).alias("content_hash"),
        F.col("path").alias("original_file_path"),
        naming.uri_rewrite(F.col("path"), scan_path, uri_base).alias("uri_file_path"),
        "content",
        tx.suggest_terms_mail(content).alias("completion_content"),
        F.col("sender").alias("creator"),
        "title",
        F.lit(doc_type).alias("content_type"),
        "receiver",
        *keep[4:],
    )


def messages_with_receivers(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """Attach receiver addresses (path, position, address) as an ordered array.

    A message of very many recipients is a long row; addresses are short, and the arrays are
    built by partial aggregates.
    """
    ordered = F.sort_array(F.collect_list(F.struct("position", "address")))
    lists = recipients.groupBy("path").agg(F.transform(ordered, lambda r: r["address"]).alias("receiver"))
    none = F.array().cast("array<string>")
    return messages.join(lists, "path", "left").withColumn("receiver", F.coalesce("receiver", none))


def extract_eml(files: DataFrame) -> DataFrame:
    """Messages of EML files (path, content bytes); an unreadable file gives an error row."""
    return files.select("path", "content").mapInPandas(_eml_rows, MAIL_SCHEMA)


def _eml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = MAIL_SCHEMA.fieldNames()
    for batch in batches:
        rows = [_eml_row(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield pd.DataFrame(rows, columns=names)


def _eml_row(path: str, content: bytes) -> dict:
    """One message by the standard library's parser."""
    from email import policy
    from email.parser import BytesParser
    from email.utils import getaddresses

    row = dict.fromkeys(MAIL_SCHEMA.fieldNames())
    row["path"] = path
    try:
        message = BytesParser(policy=policy.default).parsebytes(bytes(content))
        if not message.keys():
            raise ValueError("no header lines")
        html = message.get_body(preferencelist=("html",))
        plain = message.get_body(preferencelist=("plain",))
        senders = getaddresses(message.get_all("from", []))
        receivers = [message.get_all(h, []) for h in ("to", "cc", "bcc")]
        row["body_html"] = html.get_content() if html is not None else None
        row["body_text"] = plain.get_content() if plain is not None else ""
        row["title"] = str(message.get("subject", ""))
        row["sender"] = senders[0][1] if senders else ""
        row["receiver"] = [address for _, address in getaddresses([v for r in receivers for v in r])]
    except Exception as exc:  # noqa: BLE001 - a bad file is a counted row, not a failed job
        row["error"] = f"{type(exc).__name__}: {exc}"
    return row
