"""Benchmark decontamination: one Aho-Corasick pass over normalised texts, offsets mapped back.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. Every
window of ten consecutive words of a benchmark item is a pattern; an item with fewer words is one
pattern. A document is normalised to its words with one space around each, so a pattern, which begins and
ends with a space too, matches whole words only, and one scan finds all occurrences of all patterns.

The benchmark is cut into blocks of bounded size, each with its own automaton; a task takes one block
after the other over each batch, so no size of the benchmark exceeds a worker's memory. As a rule there is
one block. Documents are neither shuffled nor collected.

Defined cases: a null or empty text has no words; a null item text has no windows; repeated items and
repeated ids are reported once per document; an item without an id counts as an item named by the empty
text; an empty table gives an empty result; columns of other names are ignored (or passed through by
``drop_contaminated``).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import broadcast_blocks, released, texts

WINDOW = 10
# Normalised benchmark bytes per automaton: ten times as many nodes, some 50 bytes each.
BLOCK_BYTES = 128 * 1024

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NORMAL = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())

RESULT = (
    "n_words long, n_hit long, items array<string>, "
    "spans array<struct<start: long, end: long>>"
)


def words(text: bytes) -> list[bytes]:
    """The normalised words of a text."""
    return text.translate(_NORMAL).split()


def word_starts(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of every word in the text as it was: normalising keeps each byte in its place."""
    normal, at, out = text.translate(_NORMAL), 0, []
    for w in normal.split():
        at = normal.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def blocks(items: Iterable, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's (id, normalised text) rows in lists of bounded size; a long item is cut with overlap."""
    held, size = [], 0
    for item_id, text in items:
        ws = words((text or "").encode())
        step = max(WINDOW, limit // 64)
        for k in range(0, max(1, len(ws) - WINDOW + 1), step):
            part = b" ".join(ws[k : k + step + WINDOW - 1])
            if not part:
                continue
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append(("" if item_id is None else str(item_id), part))
            size += len(part)
    if held:
        yield held


def automaton(block: list[tuple[str, bytes]]) -> tuple[ahocorasick.Automaton, list[set[str]]]:
    """The automaton of a block's windows and, per window, the items that hold it."""
    machine, owners = ahocorasick.Automaton(), []
    for item_id, text in block:
        ws = text.split()
        for k in range(max(1, len(ws) - WINDOW + 1)):
            window = ws[k : k + WINDOW]
            key = (b" " + b" ".join(window) + b" ").decode("latin-1")
            if key not in machine:
                machine.add_word(key, (len(owners), len(window)))
                owners.append(set())
            owners[machine.get(key)[0]].add(item_id)
    machine.make_automaton()
    return machine, owners


def scan(all_words: list[list[bytes]], machine, owners, found: list[tuple[set[int], set[str]]]) -> None:
    """Add to each document's (hit words, items) what one automaton finds in it."""
    for ws, (hit, items) in zip(all_words, found, strict=True):
        text = " " + b" ".join(ws).decode("latin-1") + " "
        ends: list[int] = []
        for at, (pattern, n) in machine.iter(text):
            ends = ends or list(accumulate(len(w) + 1 for w in ws))
            last = bisect_left(ends, at)
            hit.update(range(last - n + 1, last + 1))
            items.update(owners[pattern])


def _spans(text: bytes, hit: set[int]) -> list[dict[str, int]]:
    """Runs of hit words as byte offsets into the original text."""
    if not hit:
        return []
    at, out = word_starts(text), []
    for k in sorted(hit):
        if out and k - 1 in hit:
            out[-1]["end"] = at[k][1]
        else:
            out.append({"start": at[k][0], "end": at[k][1]})
    return out


def _matcher(docs: DataFrame, benchmark: DataFrame, block_bytes: int):
    """A function for tasks: the (hit words, items) and words of each text of a batch."""
    rows = ((r[0], r[1]) for r in benchmark.select("item_id", "text").toLocalIterator())
    held = broadcast_blocks(docs.sparkSession.sparkContext, blocks(rows, block_bytes))

    def batches(stream: Iterable[pa.RecordBatch], text_col: str):
        built = None
        for batch in stream:
            all_texts = texts(batch.column(batch.schema.get_field_index(text_col)))
            all_words = [words(t) for t in all_texts]
            found: list[tuple[set[int], set[str]]] = [(set(), set()) for _ in all_words]
            for k, block in enumerate(held):
                if built is None or built[0] != k:
                    for value in released(block):
                        built = (k, *automaton(value))
                scan(all_words, built[1], built[2], found)
            yield batch, all_texts, all_words, found

    return batches


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document: its id, number of words, hit words, items found and hit spans (UTF-8 byte offsets)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    match = _matcher(docs, benchmark, block_bytes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(stream):
        for batch, all_texts, all_words, found in match(stream, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in all_words], pa.int64()),
                    pa.array([len(h) for h, _ in found], pa.int64()),
                    pa.array([sorted(i) for _, i in found], pa.list_(pa.string())),
                    pa.array([_spans(t, h) for t, (h, _) in zip(all_texts, found, strict=True)], span),
                ],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, {RESULT}")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents without any hit, all columns as they are."""
    match = _matcher(docs, benchmark, block_bytes)

    def run(stream):
        for batch, _, _, found in match(stream, text_col):
            yield batch.filter(pc.invert(pa.array([bool(h) for h, _ in found], pa.bool_())))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``find_contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple]) -> dict:
    """Plain comparison of every window with every position, for tests."""
    out = {}
    for doc_id, text in docs:
        ws, hit, names = words((text or "").encode()), set(), set()
        for item_id, item in items:
            iw = words((item or "").encode())
            for k in range(max(1, len(iw) - WINDOW + 1) if iw else 0):
                window = iw[k : k + WINDOW]
                for p in range(len(ws) - len(window) + 1):
                    if ws[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        names.add("" if item_id is None else str(item_id))
        listed = ",".join(sorted(names)).encode()
        out[doc_id] = (len(ws), len(hit), len(names), hashlib.sha256(listed).hexdigest(), bool(hit))
    return out
