"""Suffix-array dedup: bytes covered by any string of 400 bytes that also starts elsewhere.

``anchors`` brings together the stretches of text whose 400-byte windows may be equal. Their suffixes are then
sorted blockwise with a difference cover (Kärkkäinen 2007): a block of bounded size is laid out so that
anchors stand at multiples of eight. The suffixes at the cover {0, 1, 2, 4} modulo 8 get ranks by their first
256 bytes, found by doubling from 8-byte words. Then one bucket of suffixes (one residue) after the other is
sorted by its first eight bytes, and long ties are settled by the ranks of two cover samples inside the window,
which with the last eight bytes span all 400 bytes. Equal neighbours in a bucket are repeats. Equal windows lie
at equal offsets from their anchor, so they share a bucket, and no two buckets are held sorted at a time.

Defined cases: a null or empty text has no bytes; rows of one doc_id and one text are one document, reported
for each row; a null doc_id is an id of its own; an empty table gives an empty result; texts shorter than a
window are never cut; very long texts are handled in overlapping pieces; other columns are ignored (or passed
through by ``remove_repeats``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.anchors import HOT, SPANS, Windows, covered, kept, keyed, repeated_spans, with_spans
from paperloom.llm.common import mixed, slices, texts

WINDOW = 400
GRAM = 32
# Bytes of contents that are sorted together; a group of one anchor is never split.
BLOCK_BYTES = 2 << 20

PERIOD = 8
COVER = (0, 1, 2, 4)
DEPTH = 256

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def byte_grams(text: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The hash of every ``n`` bytes (a power of two), by doubling."""
    h, width, factor = _BYTE[text], 1, np.uint64(0x9E3779B97F4A7C15)
    while width < n:
        h = h[:-width] * factor + h[width:] if len(h) > width else h[:0]
        width, factor = width * 2, factor * factor
    return mixed(h)


def _units():
    return lambda text: np.frombuffer(text, np.uint8)


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, equal for equal keys, in ascending order."""
    order = np.argsort(keys)
    new = np.concatenate([[0], (keys[order][1:] != keys[order][:-1]).astype(np.uint64)])
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray) -> np.ndarray:
    """Ranks by ``DEPTH`` bytes of the suffixes at cover positions; elsewhere 0. ``words``: 8 bytes from each place."""
    at = np.flatnonzero(np.isin(np.arange(len(words)) % PERIOD, COVER))
    ranks, depth = np.zeros(len(words) + DEPTH, np.uint64), PERIOD
    ranks[at] = _rank(words[at])
    while depth < DEPTH:
        ranks[at] = _rank(ranks[at] << np.uint64(32) | ranks[at + depth])
        depth *= 2
    return ranks


def next_cover(residue: int, bound: int) -> int:
    """The largest distance up to ``bound`` from a residue to a cover position."""
    return next(d for d in range(bound, bound - PERIOD, -1) if (residue + d) % PERIOD in COVER)


def block_repeats(contents: list[bytes], leads: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each content, which of its windows also start elsewhere in the block at the same lead."""
    start, end = [], 0
    for content, lead in zip(contents, leads, strict=True):
        end += -(end + lead) % PERIOD
        start.append(end)
        end += len(content)
    text = np.zeros(end + DEPTH + 8, np.uint8)
    for s, content in zip(start, contents, strict=True):
        text[s : s + len(content)] = np.frombuffer(content, np.uint8)
    words = text.astype(np.uint64)
    for width in (1, 2, 4):
        words = words[:-width] << np.uint64(8 * width) | words[width:]
    ranks = cover_ranks(words)
    n = np.array([len(c) - window + 1 for c in contents], np.int64)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(np.array(start, np.int64) - first, n)
    lead = np.repeat(np.array(leads, np.int64) + first, n) - np.arange(len(at))
    out = np.zeros(len(at), bool)
    for residue in range(PERIOD):
        bucket = np.flatnonzero(at % PERIOD == residue)
        if len(bucket) < 2:
            continue
        p = at[bucket]
        near = next(d for d in range(PERIOD) if (residue + d) % PERIOD in COVER)
        far = next_cover(residue, window - DEPTH)
        ties = ranks[p + near] << np.uint64(32) | ranks[p + far]
        keys = (lead[bucket], words[p + window - 8], ties, words[p])
        order = np.lexsort(keys)
        same = np.ones(len(p) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        hit = np.zeros(len(p), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[bucket[order[hit]]] = True
    return np.split(out, np.cumsum(n)[:-1])


def _spans(rows: list[list], settled: list[tuple]) -> pa.RecordBatch:
    """Spans of one block: runs of repeated windows of stretches that aren't settled as copies, and the settled ones."""
    found = list(settled)
    for row, hit in zip(rows, block_repeats([r[8] for r in rows], [r[6] for r in rows]), strict=True) if rows else ():
        if row[7] or not hit.any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        found += [(row[3], row[4], row[5] + a, b - a) for a, b in edges.reshape(-1, 2).tolist()]
    columns = list(zip(*found, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SPANS.split(", ")]
    )


def _compare(stream):
    """Sort the contents block by block; a group stays in one block.

    Equal contents of a group are settled when they come and not held: only the first of them is sorted.
    """
    held, size, settled, group, last, first = [], 0, [], None, None, {}
    for batch in slices(stream, 8):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != group:
                if size >= BLOCK_BYTES:
                    yield _spans(held, settled)
                    held, size, settled = [], 0, []
                group, last, first = row[:3], None, {}
            if row[3:6] == last:
                continue
            last = row[3:6]
            alike = first.setdefault((row[6], xxhash.xxh3_128_digest(row[8])), len(held))
            if alike == len(held):
                held.append(list(row))
                size += len(row[8])
                continue
            for one in (held[alike], row):
                if not one[7]:
                    settled.append((one[3], one[4], one[5], len(one[8]) - WINDOW + 1))
            held[alike][7] = True
            if len(settled) >= 100_000:
                yield _spans([], settled)
                settled = []
    yield _spans(held, settled)


KIND = Windows(WINDOW, GRAM, 16, _units, byte_grams)


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    source = keyed(docs, id_col, text_col)
    return with_spans(source, repeated_spans(source, KIND, _compare, True, hot))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, the removed byte runs and the SHA-256 of what is left."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(stream):
        for batch in slices(stream, 1):
            all_texts = texts(batch.column(1))
            runs = [covered(s, WINDOW) for s in batch.column(2).to_pylist()]
            left = [hashlib.sha256(b"".join(kept(t, r))).hexdigest() for t, r in zip(all_texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in all_texts], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], span),
                    pa.array(left, pa.string()),
                ],
                ["doc_id", "n_bytes", "removed", "kept_sha256"],
            )

    return (
        _with_repeats(docs, id_col, text_col, hot)
        .select("doc_id", "text", "spans")
        .mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept_sha256 string")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``find_repeats``."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    n_spans = F.size("removed").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans, "kept_sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated bytes cut out of the text, all other columns as they are.

    A character that loses some of its bytes goes as a whole; a null text stays null.
    """
    rest = [c for c in docs.columns if c != text_col]
    source = docs.select(
        F.struct(*rest).alias("row"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.hash(text_col).alias("key"),
    )
    spans = repeated_spans(keyed(docs, id_col, text_col), KIND, _compare, True)

    def cut(stream):
        for batch in slices(stream, 1):
            new = [
                None if was is None else b"".join(kept(was, covered(s, WINDOW))).decode(errors="ignore")
                for was, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["row", "text"])

    joined = with_spans(source, spans).select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()
    left = joined.mapInArrow(cut, f"row {row}, text string")
    return left.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows by counting every string of the window's length, for tests."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    counts: dict[bytes, int] = {}
    for _, t in raw:
        for k in range(len(t) - window + 1):
            counts[t[k : k + window]] = counts.get(t[k : k + window], 0) + 1
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if counts[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        left = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len([1 for x in bytes(gone).split(b"\0") if x])
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out
