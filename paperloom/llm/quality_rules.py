"""Quality rules: base rules on each text, and cross-document line frequency per host.

Lines are normalised (A-Z lower-cased, digits to 0, white space to single blanks) and hashed. A line counts, per
host (the ``source`` column), once for every distinct text that holds it. Lines in more than ``MIN_DOCUMENTS`` texts
and more than ``HOST_SHARE`` of the host's are above the limits and are removed. A document that keeps less than
``DEPLETED`` of its words is rejected, as is one that fails a base rule.

Groups of near copies would make a document's own lines look like boilerplate. So texts that hold next to nothing of
their own count once per line together: those with less than ``OWN_PERCENT`` of their word pairs in no other text, of
all texts that hold a line above the limits. A text that only shares boilerplate has words of its own beside it.

One pass writes a narrow row per document and line; these rows are counted with partial aggregation and joined with
the lines above the limits (adaptive execution splits a hot line). Only of texts with such lines the hashes of word
pairs are counted, by the least and the largest text that holds a pair: no list of texts is gathered anywhere. Other
texts are not shuffled, but for ``cleaned``, which returns them.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own; rows of one
doc_id and one text count as one document; blank lines are neither counted nor removed; an empty table gives an
empty result; other columns are ignored (or passed through by ``cleaned``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import WordHashes, gram_hashes, signed, slices, stored, texts

MIN_WORDS = 50
REPEATED_PERCENT = 50
MIN_DOCUMENTS = 20
HOST_SHARE = 0.01
DEPLETED = 0.3
# So many text keys are sent to all executors; where there are more, the texts are dealt out to them.
BROADCAST_ROWS = 2_000_000
# Texts with fewer of their distinct word pairs in no other text are copies with small changes.
OWN_PERCENT = 10

_SYMBOLS = b"#*$%&|<>"
_ZERO = bytes.maketrans(b"0123456789", b"0" * 10)
# What is left of a text are the first bytes of its characters that stand in words.
_NOT_WORD_START = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "host string, line long, id long, key long, words int, text_words long"
PAIRS = "pair long, key long, pairs int"


def normalised(line: bytes) -> bytes:
    """The form in which lines are compared between documents."""
    return b" ".join(line.lower().translate(_ZERO).split())


def line_hash(line: bytes) -> int:
    """The signed hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three words that the text holds twice or more."""
    grams = gram_hashes(hashes, 3)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.zeros(len(hashes), bool)
    often = counts[inverse] > 1
    for k in range(3):
        hit[k : k + len(grams)] |= often
    return int(hit.sum())


def base_row(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """The base columns of one text."""
    words, seen, again = text.split(), set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.split())
        seen.add(line)
    return (
        len(words),
        len(text.translate(None, _NOT_WORD_START)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        again,
        repeated_words(hashes.of(words)),
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text_col).alias("key"),
        F.col(text_col).alias("text"),
        F.col(host_col).cast("string").alias("host"),
    )


def _line_rows(stream):
    for batch in slices(stream, 2):
        rows: list[list] = [[] for _ in range(6)]
        for id_, key, text, host in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True
        ):
            words = text.split()
            lengths: dict[bytes, int] = {}
            for line in text.split(b"\n"):
                form = normalised(line)
                if form:
                    lengths[form] = lengths.get(form, 0) + form.count(b" ") + 1
            for form, n in lengths.items():
                for column, value in zip(rows, (host, line_hash(form), id_, key, n, len(words)), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], [f.split()[0] for f in LINES.split(", ")]
        )


def _pair_rows(stream):
    """The distinct word pairs of every text, hashed; a text without any stands for itself."""
    hashes = WordHashes()
    for batch in slices(stream, 1):
        for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            pairs = signed(np.unique(gram_hashes(hashes.of(text.split()), 2)))
            if not len(pairs):
                pairs = np.array([key], np.int64)
            for at in range(0, len(pairs), 100_000):
                part = pairs[at : at + 100_000]
                columns = [pa.array(part), pa.array(np.full(len(part), key, np.int64)), pa.array(np.full(len(part), len(pairs), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PAIRS.split(", ")])


def _with_own_words(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted texts (key) those with enough word pairs that none of the others holds."""
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    held = keyed.select("key", "text").join(wanted, "key", "left_semi")
    pairs = held.mapInArrow(_pair_rows, PAIRS).groupBy("pair").agg(
        F.min("key").alias("key"), F.max("key").alias("last"), F.max("pairs").alias("pairs")
    )
    own = pairs.filter("key = last").groupBy("key").agg(F.count("*").alias("own"), F.max("pairs").alias("pairs"))
    return own.filter(100 * F.col("own") >= OWN_PERCENT * F.col("pairs")).select("key")


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """Per document with lines above the limits: id, key, those lines' hashes and words, and its number of words."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    lines = stored(keyed.mapInArrow(_line_rows, LINES), "lines").withColumn("host", F.coalesce("host", F.lit("\0")))
    counts = lines.select("host", "line", "key").distinct().groupBy("host", "line").agg(F.count("*").alias("documents"))
    hosts = lines.select("host", "key").distinct().groupBy("host").agg(F.count("*").alias("of"))
    above = (F.col("documents") > min_documents) & (F.col("documents") > host_share * F.col("of"))
    often = counts.filter(F.col("documents") > min_documents).join(hosts, "host").filter(above).select("host", "line", "of")
    held = stored(lines.join(often, ["host", "line"]), "held")
    own = _with_own_words(keyed, stored(held.select("key").distinct(), "wanted")).withColumn("apart", F.lit(True))
    each = held.select("host", "line", "of", "key").distinct().join(own, "key", "left")
    copies = F.coalesce(F.max(F.when(F.col("apart").isNull(), 1)), F.lit(0))
    counts = each.groupBy("host", "line", "of").agg((F.count("apart") + copies).alias("documents"))
    hit = held.join(counts.filter(above).select("host", "line"), ["host", "line"])
    hit = hit.dropDuplicates(["id", "key", "line"])
    return hit.groupBy("id", "key").agg(
        F.collect_list("line").alias("lines"), F.sum("words").alias("gone"), F.first("text_words").alias("text_words")
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """Per document: doc_id, the base columns, base_failed, the words in frequent lines and kept."""
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text_col).alias("key"),
        F.col(text_col).alias("text"),
    )

    def run(stream):
        hashes = WordHashes()
        for batch in slices(stream, 3):
            columns = list(zip(*[base_row(t, hashes) for t in texts(batch.column(3))], strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "id", "key", *[f.split()[0] for f in BASE.split(", ")]],
            )

    base = source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, id long, key long, {BASE}")
    gone = frequent_lines(docs, id_col, text_col, host_col, min_documents, host_share).select("id", "key", "gone")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    gone_words = F.coalesce("gone", F.lit(0)).cast("long")
    keeps = F.col("n_words") - gone_words >= DEPLETED * F.col("n_words")
    return base.join(gone, ["id", "key"], "left").select(
        "doc_id", *[f.split()[0] for f in BASE.split(", ")], failed.alias("base_failed"),
        gone_words.alias("n_frequent_words"), (~failed & keeps).alias("kept"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """The documents that are kept, without their lines above the limits; all columns as they are."""
    frequent = frequent_lines(docs, id_col, text_col, host_col, min_documents, host_share).select("id", "key", "lines")
    source = docs.select(
        F.struct(*[c for c in docs.columns if c != text_col]).alias("row"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text_col).alias("key"),
    )
    joined = source.join(frequent, ["id", "key"], "left").select("row", "text", "lines")

    def run(stream):
        hashes = WordHashes()
        for batch in slices(stream, 1):
            keep, left = [], []
            for text, gone in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                n, _, _, _, again = base_row(text, hashes)
                rest = text
                if gone:
                    gone = set(gone)
                    rest = b"\n".join(x for x in text.split(b"\n") if line_hash(normalised(x)) not in gone)
                failed = n < MIN_WORDS or 100 * again > REPEATED_PERCENT * n
                keep.append(not failed and len(rest.split()) >= DEPLETED * n)
                left.append(rest)
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.binary()).cast(pa.string())], ["row", "text"])
            yield made.filter(pa.array(keep, pa.bool_()))

    left = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, text string")
    return left.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])

