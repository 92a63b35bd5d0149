"""Repeated windows of fixed length over many documents, by content-defined anchors.

Both substring operators ask which windows of ``window`` units (bytes or words) occur more than once. The
anchor of a window is its smallest ``gram``-unit hash, the leftmost of equals. That is a function of the
window's content, so equal windows have equal anchors at equal offsets; neighbouring windows mostly share
theirs. A *stretch* is a run of neighbouring windows of one document with one anchor. Therefore

- windows whose anchor occurs in one stretch only are unique; they never leave the first pass but as a hash;
- stretches of equal anchor and content repeat as a whole; one representative stands for all of them, and
  each pass hands on one representative per batch only, so hot copies do not meet in one task;
- only anchors with several different stretches need their contents compared: for these alone the
  representatives' units are fetched, and dealt out by anchor to the operator's own method. An anchor with more
  than ``HOT`` stretches is dealt out by slices of its windows and the units that all windows of the slice
  share; equal windows still meet.

Rows of one doc_id and one text count as one document. What moves: one small row per stretch, the texts twice
(fetch, result), the contents in question once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import batch_rows, mixed, signed, slices, stored, texts

# Rows and bytes of text that the first pass takes at a time, and units that it handles as one array (some 80 bytes each).
BATCH_ROWS = 2500
BATCH_BYTES = 4 << 20
BATCH_UNITS = 1 << 20
# Windows of one document in one array; a longer document is handled in overlapping pieces.
PIECE_UNITS = 1 << 20
# Different stretches of one anchor that one task compares without dealing them out further.
HOT = 4096

NULL_ID = -(1 << 63)
FOUND = "need boolean, anchor long, id long, key int, start long, n long, lead int, copied boolean"
CONTENTS = "anchor long, slice int, core long, id long, key int, start long, lead int, copied boolean, units binary"
SPANS = "id long, key int, start long, n long"


@dataclass(frozen=True)
class Windows:
    """What a window is: its length, the length of a hashed gram, and how a text becomes an array of units."""

    window: int
    gram: int
    slice: int
    units: Callable[[], Callable[[bytes], np.ndarray]]
    grams: Callable[[np.ndarray], np.ndarray]


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """The minimum of every ``m`` neighbours, in time independent of ``m``."""
    n = len(x)
    blocks = np.pad(x, (0, -n % m), constant_values=np.iinfo(x.dtype).max).reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - m + 1], ahead[m - 1 : n])


def stretches(kind: Windows, pieces: list[tuple[int, int, np.ndarray]]) -> dict[str, np.ndarray]:
    """The stretches of pieces (row, offset, units): row, start in the document, windows, lead, anchor, content."""
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    base = np.cumsum(sizes) - sizes
    text = np.concatenate([p[2] for p in pieces])
    grams = kind.grams(text)
    m = kind.window - kind.gram + 1
    place = np.uint64(0xFFFFFFFF)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), m) & place
    windows = sizes - kind.window + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    at = np.arange(len(piece)) + np.repeat(base - (np.cumsum(windows) - windows), windows)
    anchor = least[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    start, own, view = at[first], piece[first], memoryview(text.view(np.uint8))
    u = text.itemsize
    content = np.fromiter(
        (
            xxhash.xxh3_64_intdigest(view[a:b])
            for a, b in zip((start * u).tolist(), ((start + n + kind.window - 1) * u).tolist(), strict=True)
        ),
        np.uint64,
        len(start),
    )
    offset = np.array([p[1] for p in pieces], np.int64)
    return {
        "row": np.array([p[0] for p in pieces], np.int64)[own],
        "start": start - base[own] + offset[own],
        "n": n,
        "lead": anchor[first] - start,
        "anchor": signed(grams[anchor[first]]),
        "content": signed(content),
    }


def _pieces(kind: Windows, documents: Iterable[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Documents of at least one window in lists of bounded size."""
    held, size = [], 0
    for row, units in enumerate(documents):
        for at in range(0, len(units) - kind.window + 1, PIECE_UNITS):
            part = units[at : at + PIECE_UNITS + kind.window - 1]
            held.append((row, at, part))
            size += len(part)
            if size >= BATCH_UNITS:
                yield held
                held, size = [], 0
    if held:
        yield held


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, id, key): id replaces a null, key tells rows of one doc_id apart by their text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.hash(text_col).alias("key"),
    )


def _equal(columns: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """Which rows equal the one before in these columns."""
    out = np.ones(max(0, len(columns[names[0]]) - 1), bool)
    for k in names:
        out &= columns[k][1:] == columns[k][:-1]
    return np.concatenate([np.zeros(min(1, len(columns[names[0]])), bool), out])


RUNS = "anchor long, content long, id long, key int, start long, n int, lead int"


def _runs(kind: Windows):
    """First pass: one row per stretch; copies within a batch become resolved spans (lead -1) right away."""

    def run(stream):
        units = kind.units()
        for batch in slices(stream, 2, BATCH_BYTES):
            ids = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy()
            for pieces in _pieces(kind, map(units, texts(batch.column(2)))):
                s = stretches(kind, pieces)
                order = np.lexsort((s["start"], keys[s["row"]], ids[s["row"]], s["content"], s["anchor"]))
                s = {k: v[order] for k, v in s.items()}
                s["id"], s["key"] = ids[s["row"]], keys[s["row"]]
                again = _equal(s, ("anchor", "content", "id", "key", "start"))
                s = {k: v[~again] for k, v in s.items()}
                same = _equal(s, ("anchor", "content"))[1:]
                copy = np.concatenate([[False], same])
                # a class that repeats here sends its first stretch twice at most: enough to be known as copied
                second = copy & ~np.concatenate([[False], copy[:-1]])
                done = {k: v[copy & ~second] for k, v in s.items()}
                order = np.lexsort((done["start"], done["row"]))
                done = {k: v[order] for k, v in done.items()}
                row, start, n = done["row"], done["start"], done["n"]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != (start + n)[:-1])])[: len(row)]
                first = np.flatnonzero(new)
                n = np.add.reduceat(n, first) if len(first) else n
                row, start = row[first], start[first]
                left = {k: v[~copy | second] for k, v in s.items()}
                spread = signed(mixed((ids[row] ^ start).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([left["anchor"], spread])),
                        pa.array(np.concatenate([left["content"], spread])),
                        pa.array(np.concatenate([ids[left["row"]], ids[row]])),
                        pa.array(np.concatenate([keys[left["row"]], keys[row]])),
                        pa.array(np.concatenate([left["start"], start])),
                        pa.array(np.concatenate([left["n"], n]).astype(np.int32)),
                        pa.array(np.concatenate([left["lead"], np.full(len(row), -1)]).astype(np.int32)),
                    ],
                    ["anchor", "content", "id", "key", "start", "n", "lead"],
                )

    return run


def _resolve(first_too: bool):
    """Stretches sorted by anchor, content and place: spans that are settled, and stretches to compare.

    Holds one row from batch to batch: the first stretch of the class that may go on.
    """

    def run(stream):
        held: dict[str, np.ndarray] | None = None
        before, copies = False, 0

        def emit(c, reps, multi, copied, more) -> pa.RecordBatch:
            spans = np.concatenate([more, reps[copied]]) if first_too else more
            ask = reps[multi]
            at = np.concatenate([spans, ask])
            kind = np.repeat([False, True], [len(spans), len(ask)])
            flag = np.concatenate([np.ones(len(spans), bool), copied[multi]])
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), *[pa.array(c[k][at]) for k in ("anchor", "id", "key", "start")]]
                + [pa.array(c["n"][at].astype(np.int64)), pa.array(c["lead"][at]), pa.array(flag)],
                ["need", "anchor", "id", "key", "start", "n", "lead", "copied"],
            )

        for batch in stream:
            c = {k: v.to_numpy() for k, v in zip(batch.schema.names, batch.columns, strict=True)}
            settled = np.flatnonzero(c["lead"] < 0)
            none = np.zeros(0, np.int64)
            if len(settled):
                yield emit(c, none, none.astype(bool), none.astype(bool), settled)
            open_ = c["lead"] >= 0
            c = {k: v[open_] for k, v in c.items()}
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            again = _equal(c, ("anchor", "content", "id", "key", "start"))
            c = {k: v[~again] for k, v in c.items()}
            if not len(c["anchor"]):
                continue
            same_anchor = np.concatenate([[False], c["anchor"][1:] == c["anchor"][:-1]])
            same = same_anchor & np.concatenate([[False], c["content"][1:] == c["content"][:-1]])
            reps = np.flatnonzero(~same)
            size = np.diff(np.concatenate([reps, [len(same)]]))
            size[0] += max(0, copies - 1)
            joined = same_anchor[reps]
            joined[0] = before
            follows = np.concatenate([joined[1:], [False]])
            last = reps[-1]
            yield emit(c, reps[:-1], (joined | follows)[:-1], (size > 1)[:-1], np.flatnonzero(same))
            held, before, copies = {k: v[last : last + 1] for k, v in c.items()}, bool(joined[-1]), int(size[-1])
        if held is not None:
            one = np.zeros(1, np.int64)
            yield emit(held, one, np.array([before]), np.array([copies > 1]), one[:0])

    return run


def _contents(kind: Windows, hot: int):
    """Fetch: the units of the stretches asked for, a hot anchor's by slices."""

    def run(stream):
        units = kind.units()
        for batch in slices(stream, 2):
            found: list[list] = [[] for _ in CONTENTS.split(",")]
            asked = batch.column(3).to_pylist()
            for id_, key, text, wanted in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), asked, strict=True
            ):
                whole = units(text)
                for w in wanted:
                    start, n, lead = w["start"], w["n"], w["lead"]
                    cuts = [(0, n, -1)]
                    if w["stretches"] > hot:
                        q = [(lead - j) // kind.slice for j in range(n)]
                        edge = [j for j in range(n) if j == 0 or q[j] != q[j - 1]] + [n]
                        cuts = [(a, b, q[a]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    for a, b, part in cuts:
                        core = 0
                        if part >= 0:  # the units that every window of the slice holds
                            high = start + lead - part * kind.slice
                            held = whole[high : high - kind.slice + 1 + kind.window]
                            core = xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63)
                        row = (
                            w["anchor"], part, core, id_, key, start + a, lead - a, w["copied"],
                            whole[start + a : start + b - 1 + kind.window].tobytes(),
                        )
                        for column, value in zip(found, row, strict=True):
                            column.append(value)
            names = [f.split()[0] for f in CONTENTS.split(", ")]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, kinds, strict=True)], names)

    return run


def repeated_spans(
    source: DataFrame, kind: Windows, compare: Callable[[Iterable], Iterator], first_too: bool, hot: int = HOT
) -> DataFrame:
    """(id, key, spans) of the ``keyed`` documents: runs of windows (start, n) that repeat.

    ``compare`` gets the contents sorted by anchor, slice, core and place, and gives spans. With ``first_too`` every
    occurrence counts, else all but the first by (id, key, start).
    """
    rows = source.select("id", "key", "text").mapInArrow(_runs(kind), RUNS)
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "content", "id", "key", "start")
    with batch_rows(source.sparkSession, BATCH_ROWS):
        found = stored(rows.mapInArrow(_resolve(first_too), FOUND), "stretches")
    need = found.filter("need")
    many = need.groupBy("anchor").agg(F.count("*").alias("stretches"))
    asked = need.join(many, "anchor").groupBy("id", "key").agg(
        F.collect_list(F.struct("anchor", "start", "n", "lead", "copied", "stretches")).alias("asked")
    )
    joined = source.join(asked, ["id", "key"]).select("id", "key", "text", "asked")
    contents = joined.mapInArrow(_contents(kind, hot), CONTENTS)
    place = ["anchor", "slice", "core"]
    dealt = contents.repartition(*place).sortWithinPartitions(*place, "id", "key", "start")
    spans = dealt.mapInArrow(compare, SPANS).unionByName(found.filter("not need").select("id", "key", "start", "n"))
    return spans.groupBy("id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """The keyed documents with their spans; documents without any have null."""
    return source.join(spans, ["id", "key"], "left")


def covered(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of units that the windows of the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["start"] + s["n"] - 1 + window) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept(units: list | bytes, spans: list[tuple[int, int]]) -> list:
    """What the spans leave, piece by piece."""
    edges = [0, *[x for s in spans for x in s], len(units)]
    return [units[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
