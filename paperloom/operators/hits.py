"""Result rows of a page of hits: snippets, highlighted comments, icons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import highlight as hl
from paperloom.functions.naming import index_name, program_icon
from paperloom.plans.columns import literal_rows
from paperloom.schemas import COMMENT_TYPE, INDEX_NAME


def first_comment_with(comments: Column, fragment: Column) -> Column:
    """The first comment whose text contains the fragment, or null."""
    return F.get(F.filter(comments, lambda c: c["comment"].contains(fragment)), F.lit(0))


def first_comments_with(comments: DataFrame, fragments: DataFrame, key: str, order: str,
                        text: str) -> DataFrame:
    """The flat form: (key, fragment) and the first of the key's comments that contains it.

    One fragment per key meets the comments of that key once; a partial aggregate keeps the
    first match, so comments are never gathered. Fragments without a match give no row.
    """
    matching = comments.join(fragments, key).where(F.col(text).contains(F.col("fragment")))
    others = [c for c in comments.columns if c not in (key, order, text)]
    first = F.min_by(F.struct(order, *others), F.col(order)).alias("_m")
    return matching.groupBy(key, "fragment").agg(first).select(key, "fragment", "_m.*")


def hit_comments(comments: DataFrame, terms: Sequence[str], key: str, order: str) -> DataFrame:
    """(key, comments): per document the first comments with a highlight, nested in order.

    ``comments`` are flat rows with the fields of a nested comment and the two columns. A result
    row shows the first few fragments; every comment kept here has one, and a fragment's origin
    comes no later than the comment it was cut from. So that many comments are all it takes,
    and no more are gathered, however many a document has.
    """
    marked = comments.where(F.size(hl.fragments(F.col("comment"), terms)) > 0)
    first = Window.partitionBy(key).orderBy(order)
    kept = marked.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= hl.FRAGMENT_COUNT)
    fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMENT_TYPE])
    ordered = F.sort_array(F.collect_list(F.struct("_n", fields.alias("c"))))
    return kept.groupBy(key).agg(F.transform(ordered, lambda x: x["c"]).alias("comments"))


def contents(content: Column, terms: Sequence[str]) -> Column:
    """Highlighted fragments, or the beginning of the content where nothing is highlighted."""
    marked = hl.fragments(content, terms)
    return F.when(F.size(marked) > 0, marked).otherwise(F.array(hl.fallback_snippet(content)))


def comment_details(comments: Column, terms: Sequence[str]) -> Column:
    """Highlighted comment fragments, each with author, date, id and initials of the comment it is cut from."""

    def details(comment: Column) -> Column:
        fields = [comment[n].alias(n) for n in ("author", "date", "id", "initials")]
        return F.transform(
            hl.fragments(comment["comment"], terms), lambda fragment: F.struct(fragment.alias("comment_text"), *fields)
        )

    return F.slice(F.flatten(F.transform(comments, details)), 1, hl.FRAGMENT_COUNT)


def hit_rows(docs: DataFrame, terms: Sequence[str], main: str = INDEX_NAME) -> DataFrame:
    """Full result rows of the documents of a page: corpus rows with ``score``, nested ``comments``."""
    return docs.select(
        F.col("uri_file_path").alias("relative_url"),
        "id",
        "process_time",
        F.col("original_file_path").alias("absolute_url"),
        F.col("content_type").alias("document_type"),
        index_name(main, F.col("doc_type")).alias("index_name"),
        contents(F.col("content"), terms).alias("contents"),
        comment_details(F.col("comments"), terms).alias("comments"),
        F.col("score").alias("relevance"),
        program_icon(F.col("content_type")).alias("program_icon"),
    )


def fetched(corpus: DataFrame, page: dict, key: str = "id") -> DataFrame:
    """Corpus rows of a page (id -> score) with their score; the ids filter the scan. An empty page has no rows."""
    if not page:
        return corpus.where(F.lit(False)).withColumn("score", F.lit(0.0))
    scores = literal_rows(corpus.sparkSession, [(k, float(v)) for k, v in page.items()], [key, "score"])
    return corpus.where(F.col(key).isin(*page)).join(F.broadcast(scores), key)


def joined(corpus: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """Corpus rows of a page of any size; the optimizer knows the size of a limited frame."""
    return corpus.join(page.select(key, "score"), key)
