"""Lexical retrieval packing: windows filled with lexically near documents, nearly without padding.

Texts become token ids once. Whole windows of a long document are sequences of their own; what is left of each
document, its tail, is packed. Tails are ordered by a lexical key, their three most telling tokens by tf-idf over all
tails, and range-partitioned by it, ties by id, so copies and related texts lie together and no key meets in
one task. Each task cuts its range into index shards of ``SHARD`` tails. A shard is a BM25 inverted index over
token ids (statistics of all tails; at most one number per vocabulary entry is broadcast). A seed tail asks it for
the unused neighbours in order of score, which greedily fill the window: first those that fit as they are, then the
best one left is cut to fill the rest, and its remainder is the next seed. A window that a shard leaves open goes on
in the next shard; the last of a task is cut at powers of two, which need no padding, and only a rest of
under ``LEAST`` tokens is padded.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; ties in score go by order
in the shard; an empty table gives an empty result; very long texts are cut into windows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import slices, stored
from paperloom.llm.encoding import documents_of, token_table
from paperloom.llm.tokens import encoder, tokenizer_path

WINDOW = 1024
END = 0
# Tails in one index.
SHARD = 1024
# The shortest sequence that is cut off at a power of two.
LEAST = 32
# Bytes of tails in one range.
PART_BYTES = 16 << 20
# BM25's usual constants.
K1, B = 1.2, 0.75

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
TAILS = "doc_id long, doc_tokens long, start long, ids binary, a int, b int, c int"


def _piece(doc, ids: np.ndarray, start: int, sequence: int, offset: int) -> tuple:
    raw = ids.tobytes()
    return (doc[0], start, len(ids), zlib.crc32(raw), doc[1], sequence, offset, raw)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in PIECES.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, (_, k) in zip(columns, fields, strict=True)],
        [n for n, _ in fields],
    )


def _whole_windows(kind: str):
    """Sequences that one document fills alone."""

    def run(stream):
        made = 0
        for batch in slices(stream, 1):
            rows = []
            for doc_id, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for at in range(0, len(ids) - WINDOW + 1, WINDOW):
                    rows.append(_piece((doc_id, len(ids)), ids[at : at + WINDOW], at, part << 32 | made << 1 | 1, 0))
                    made += 1
            yield _batch(rows)

    return run


def _tails(column: pa.Array, kind: str) -> tuple[np.ndarray, list[bytes]]:
    """Of documents with a tail: their rows, and the ids of the tails."""
    window = WINDOW * np.dtype(kind).itemsize
    tails = [raw[len(raw) // window * window :] for raw in column.to_pylist()]
    rows = [k for k, t in enumerate(tails) if t]
    return np.array(rows, np.int64), [tails[k] for k in rows]


def _pairs(tails: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tail, id and frequency of every distinct id of each tail, in this order."""
    flat = np.frombuffer(b"".join(tails), kind)
    width = int(flat.max(initial=0)) + 1
    whole = np.uint32 if len(tails) * width < 1 << 32 else np.uint64
    sizes = np.array([len(t) for t in tails], np.int64) // np.dtype(kind).itemsize
    keys = np.sort(np.repeat(np.arange(len(tails), dtype=whole) * whole(width), sizes) + flat.astype(whole))
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    tail, ids = np.divmod(keys[first], whole(width))
    return tail.astype(np.int64), ids.astype(np.int64), np.diff(np.append(first, len(keys)))


def _most_telling(tail: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int) -> list[np.ndarray]:
    """The ids of the three largest weights of each of ``n`` tails, ties by id; -1 where there are fewer."""
    weights, out = weights.copy(), []
    begin = np.searchsorted(tail, np.arange(n))
    for _ in range(3 if n else 0):
        best = np.maximum.reduceat(weights, begin)
        at = np.flatnonzero((weights == best[tail]) & (weights > -np.inf))
        at = at[np.concatenate([[True], tail[at][1:] != tail[at][:-1]])[: len(at)]]
        own = np.full(n, -1, np.int64)
        own[tail[at]] = ids[at]
        weights[at] = -np.inf
        out.append(own)
    return out or [np.zeros(0, np.int64)] * 3


def _statistics(kind: str):
    """Of all tails: in how many each id occurs (id -1: the tails, id -2: their tokens)."""

    def run(stream):
        df, tails, tokens = np.zeros(0, np.int64), 0, 0
        for batch in slices(stream, 0):
            _, own = _tails(batch.column(0), kind)
            counted = np.bincount(_pairs(own, kind)[1], minlength=len(df))
            counted[: len(df)] += df
            df, tails, tokens = counted, tails + len(own), tokens + sum(map(len, own)) // np.dtype(kind).itemsize
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [tails, tokens]]))], ["id", "n"]
        )

    return run


class Statistics:
    """Inverse document frequencies and the mean length of all tails."""

    def __init__(self, counted: dict[int, int]):
        tails = counted.get(-1, 0)
        df = np.zeros(max(counted, default=0) + 1 if counted else 1)
        for i, n in counted.items():
            if i >= 0:
                df[i] = n
        self.idf = np.log1p((tails - df + 0.5) / (df + 0.5))
        self.mean = counted.get(-2, 0) / max(1, tails)


def _keyed_tails(statistics, kind: str):
    def run(stream):
        idf = statistics.value.idf
        for batch in slices(stream, 1):
            rows, tails = _tails(batch.column(1), kind)
            tail, ids, tf = _pairs(tails, kind)
            top = _most_telling(tail, ids, idf[ids] * tf / (tf + K1), len(tails))
            width = np.dtype(kind).itemsize
            n = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)[rows].astype(np.int64) // width
            start = n - np.array([len(t) for t in tails], np.int64) // width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(n), pa.array(start), pa.array(tails, pa.binary())]
                + [pa.array(t.astype(np.int32)) for t in top],
                [f.split()[0] for f in TAILS.split(", ")],
            )

    return run


class Index:
    """A BM25 inverted index over the tails of one shard."""

    def __init__(self, tails: list[np.ndarray], statistics: Statistics):
        sizes = np.array([len(t) for t in tails])
        flat = np.concatenate(tails).astype(np.int64)
        pair, tf = np.unique(flat * len(tails) + np.repeat(np.arange(len(tails)), sizes), return_counts=True)
        self._term, self._doc = pair // len(tails), pair % len(tails)
        norm = K1 * (1 - B + B * sizes[self._doc] / max(statistics.mean, 1e-9))
        self._weight = statistics.idf[self._term] * tf * (K1 + 1) / (tf + norm)
        self._n = len(tails)
        self._from = np.searchsorted(self._term, np.arange(int(self._term.max(initial=0)) + 2))
        # Terms that every fourth tail holds are rows of a matrix.
        self._size = np.diff(self._from)
        hot = np.flatnonzero(self._size * 4 > len(tails))
        self._row = np.full(len(self._size), -1)
        self._row[hot] = np.arange(len(hot))
        self._dense = np.zeros((len(hot), len(tails)))
        held = self._row[self._term] >= 0
        self._dense[self._row[self._term[held]], self._doc[held]] = self._weight[held]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The score of every tail for the distinct tokens of a query."""
        terms = np.unique(query).astype(np.int64)
        terms = terms[terms < len(self._row)]
        row = self._row[terms]
        low, size = self._from[terms[row < 0]], self._size[terms[row < 0]]
        at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        return np.bincount(self._doc[at], self._weight[at], self._n) + self._dense[row[row >= 0]].sum(0)


class Packer:
    """Fills windows shard by shard; holds one open window."""

    def __init__(self, statistics: Statistics, part: int):
        self._statistics, self._part, self._made = statistics, part, 0
        self._open: list[tuple] = []  # (document, start, ids)
        self._room = WINDOW

    def _close(self) -> list[tuple]:
        sequence, at, rows = self._part << 32 | self._made << 1, 0, []
        for doc, start, ids in self._open:
            rows.append(_piece(doc, ids, start, sequence, at))
            at += len(ids)
        self._made += 1
        self._open, self._room = [], WINDOW
        return rows

    def _put(self, doc, start: int, ids: np.ndarray) -> int:
        """Add what fits of a tail; how much that was."""
        n = min(self._room, len(ids))
        self._open.append((doc, start, ids[:n]))
        self._room -= n
        return n

    def shard(self, tails: list[tuple]) -> Iterator[tuple]:
        """Pack the tails (document, start, ids) of one shard; gives the pieces of closed windows."""
        index = Index([t[2] for t in tails], self._statistics)
        begin = np.zeros(len(tails), np.int64)
        size = np.array([len(t[2]) for t in tails])
        unused = np.ones(len(tails), bool)
        seed, following = None, 0

        def take(k: int) -> None:
            doc, start, ids = tails[k]
            n = self._put(doc, start + int(begin[k]), ids[begin[k] :])
            begin[k] += n
            size[k] -= n
            unused[k] = size[k] > 0

        while True:
            if seed is None or not unused[seed]:
                while following < len(tails) and not unused[following]:
                    following += 1
                if following == len(tails):
                    return
                seed = following
            take(seed)
            if self._room:
                scores = index.scores(tails[seed][2])
                near = np.flatnonzero(unused)
                near = near[np.argsort(-scores[near], kind="stable")]
                least = size[near].min(initial=WINDOW)
                fit = near[size[near] <= self._room]
                for k, n in zip(fit.tolist(), size[fit].tolist(), strict=True):
                    if self._room < least:
                        break
                    if n <= self._room:
                        take(k)
                if self._room:
                    left = near[unused[near]]
                    if not len(left):
                        return
                    seed = int(left[0])
                    take(seed)
            if not self._room:
                yield from self._close()

    def rest(self) -> Iterator[tuple]:
        """The last window, cut at powers of two."""
        held = self._open
        left = WINDOW - self._room
        self._open = []
        while left:
            self._room = 1 << (left.bit_length() - 1) if left >= LEAST else left
            left -= self._room
            while self._room:
                doc, start, ids = held.pop(0)
                n = self._put(doc, start, ids)
                if n < len(ids):
                    held.insert(0, (doc, start + n, ids[n:]))
            yield from self._close()


def _packed(statistics, kind: str):
    def run(stream):
        packer, held = None, []
        for batch in slices(stream, 3):
            out = []
            for doc_id, n, start, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer = packer or Packer(statistics.value, part)
                held.append(((doc_id, n), start, np.frombuffer(raw, kind).astype("<u4")))
                if len(held) == SHARD:
                    out += packer.shard(held)
                    held = []
            yield _batch(out)
        if packer:
            yield _batch([*(packer.shard(held) if held else ()), *packer.rest()])

    return run


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: its document, place, length, checksum and ids, and its sequence and offset there."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    kind = encoder(path).type
    ids = documents_of(token_table(docs, path, END, id_col, text_col))
    counted = ids.select("ids").mapInArrow(_statistics(kind), "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    counted = {r.id: r.n for r in counted.collect()}  # one row per vocabulary entry at most
    statistics = spark.sparkContext.broadcast(Statistics(counted))
    ranges = max(1, counted.get(-2, 0) * np.dtype(kind).itemsize // PART_BYTES)
    tails = stored(ids.mapInArrow(_keyed_tails(statistics, kind), TAILS), "tails")  # ranges are found in a pass of their own
    key = ["a", "b", "c", "doc_id", "ids"]
    ranged = tails.repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    part = F.spark_partition_id().cast("long").alias("part")
    packed = ranged.select("doc_id", "doc_tokens", "start", "ids", part).mapInArrow(_packed(statistics, kind), PIECES)
    whole = ids.filter(F.octet_length("ids") >= np.dtype(kind).itemsize * WINDOW).select("doc_id", "ids", part)
    return whole.mapInArrow(_whole_windows(kind), PIECES).unionByName(packed)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pieces.drop("ids")
