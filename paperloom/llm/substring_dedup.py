"""Substring dedup: words covered by a window of 20 words whose words also start earlier.

``anchors`` brings together the stretches of words whose windows may be equal, in the order of their places. Each
group is then factored by relative Lempel-Ziv parsing: the stretches seen so far are the reference block, indexed by
the hash of every window. A stretch is factored greedily against it: where a window is known, the match is
followed as far as it reaches and becomes one factor; the parse goes on at the first window that crosses the
factor's end, so a repeat that starts before a factor boundary and ends behind it is checked too. Factors have 20
words at least and are the duplicate spans. Then the stretch joins the reference block.

Words are compared by their 64-bit hashes. Defined cases: a null or empty text has no words; rows of one doc_id and
one text are one document, reported for each row; of different texts with one doc_id some one comes first; a null
doc_id comes before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.anchors import HOT, SPANS, Windows, covered, kept, keyed, repeated_spans, with_spans
from paperloom.llm.common import WordHashes, gram_hashes, slices, texts

WINDOW = 20
GRAM = 3


def _units():
    hashes = WordHashes()
    return lambda text: hashes.of(text.split())


KIND = Windows(WINDOW, GRAM, 1, _units, lambda units: gram_hashes(units, GRAM))


class ReferenceBlock:
    """Indexed stretches of one group."""

    def __init__(self):
        self._windows: dict[int, tuple[int, int]] = {}
        self._stretches: list[tuple[bytes, list[int]]] = []

    def factor(self, units: bytes, windows: list[int]) -> list[tuple[int, int]]:
        """Greedy factors as runs of windows (first, number)."""
        out, at = [], 0
        while at < len(windows):
            met = self._windows.get(windows[at])
            if met is None:
                at += 1
                continue
            held, other = self._stretches[met[0]]
            q, n = met[1], 0
            if held[q * 8 : (q + WINDOW) * 8] != units[at * 8 : (at + WINDOW) * 8]:
                at += 1
                continue
            while at + n < len(windows) and q + n < len(other) and windows[at + n] == other[q + n]:
                n += 1
            out.append((at, n))
            at += n
        return out

    def add(self, units: bytes, windows: list[int]) -> None:
        """Index a stretch; a window keeps its first place."""
        for k, w in enumerate(windows):
            self._windows.setdefault(w, (len(self._stretches), k))
        self._stretches.append((units, windows))


def _compare(stream):
    """Factor every stretch against the earlier ones of its group."""
    group, last, reference = None, None, ReferenceBlock()
    for batch in stream:
        columns = [c.to_pylist() for c in batch.columns]
        units = columns[8]
        sizes = np.array([len(u) // 8 for u in units], np.int64)
        hashed = gram_hashes(np.frombuffer(b"".join(units), np.uint64), WINDOW)
        ends = np.cumsum(sizes)
        found = []
        for k, row in enumerate(zip(*columns, strict=True)):
            if row[:3] != group:
                group, last, reference = row[:3], None, ReferenceBlock()
            if row[3:6] == last:
                continue
            last = row[3:6]
            begin = int(ends[k] - sizes[k])
            windows = hashed[begin : begin + int(sizes[k]) - WINDOW + 1].tolist()
            factors = reference.factor(row[8], windows)
            found += [(row[3], row[4], row[5] + at, n) for at, n in factors]
            if sum(n for _, n in factors) < len(windows):
                # A stretch without a new window would add nothing, however often it comes.
                reference.add(row[8], windows)
        if found:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)],
                [f.split()[0] for f in SPANS.split(", ")],
            )


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_words, the removed word runs and the SHA-256 of the words left, joined by a space."""
    source = keyed(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(stream):
        for batch in slices(stream, 1):
            all_words = [t.split() for t in texts(batch.column(1))]
            runs = [covered(s, WINDOW) for s in batch.column(2).to_pylist()]
            left = [b" ".join(w for p in kept(ws, r) for w in p) for ws, r in zip(all_words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(w) for w in all_words], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], span),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                ],
                ["doc_id", "n_words", "removed", "kept_sha256"],
            )

    return (
        with_spans(source, repeated_spans(source, KIND, _compare, False, hot))
        .select("doc_id", "text", "spans")
        .mapInArrow(run, "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept_sha256 string")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the result of ``find_duplicates``."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract's rows by remembering every window in order, for tests."""
    seen: set[tuple] = set()
    out = []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - WINDOW + 1):
            w = tuple(ws[k : k + WINDOW])
            if w in seen:
                gone[k : k + WINDOW] = [True] * WINDOW
            seen.add(w)
        left = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d, len(ws), sum(gone), hashlib.sha256(left).hexdigest()))
    return out
