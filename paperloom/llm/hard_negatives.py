"""Hard negatives by exact integer scores: a matrix product in residues of small primes, in blocks.

Vectors are quantised to integers. Their components modulo several small primes are multiplied as float32 matrices:
residues are balanced and products are cut into chunks, so that every sum stays below 2 ** 23 and is exact. Chinese
remaindering gives the signed score back; the primes are as many as the table's own largest component and length ask
for.

The anchors are a stated query set, taken in blocks of bounded size: each block is broadcast and all rows pass by it
twice, once for the positives and once for the negatives in the windows that the positives' scores open. A task keeps
k rows per anchor and window, whatever it reads; the k best of all tasks are found by a window function. Rows of the
same score (a common vector) are told apart by their id, so a group of copies costs no more than others.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that share an id are one,
the smallest by (label, vector). Vectors of different lengths count as filled up with zeros, so an empty vector scores
0. Scores beyond 2 ** 61 raise an error, as a long could not hold them. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import batch_rows, numbered, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
# An anchor block holds at most so many anchors and so many bytes of vectors.
BLOCK_ANCHORS = 4_096
BLOCK_BYTES = 32 << 20
# Scores that a task computes at a time, and bytes of vectors in a batch.
CELLS = 1 << 20
BATCH_BYTES = 8 << 20
# Residues lie below half of this in size; sums of their products have to stay below 2 ** 23.
LARGEST_PRIME = 256
EXACT = 1 << 23
MOST = 1 << 61
PAIR = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(rows: DataFrame, label: Column, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): the rows that take part, one per id, with integer components floor(scale * x)."""
    named = rows.select(
        "vec_id", label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    q = F.transform("vector", lambda x: F.floor(x * scale).cast("long"))
    one = fit.groupBy("vec_id").agg(F.min(F.struct("label", q.alias("q"))).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """Negatives of the anchors among quantised rows (see `quantised`): anchor_id, positive_id, rank, negative_id, scores.

    An anchor's positives are its best ``positives`` other rows of its label. Of each, the best ``negatives`` rows of
    other labels whose score is between ``low`` and ``high`` hundredths of the positive's are returned.
    """
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    # Float64 keeps the size of components that are too large for exact work.
    longest, largest = rows.agg(
        F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))))
    ).first()
    dims = longest or 0
    bound = dims * int(largest or 0) ** 2
    if bound >= MOST:
        raise ValueError(f"scores of up to {bound} do not fit a long: scale the vectors down")
    primes = needed_primes(2 * bound + 1)
    block = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * max(dims, 1))))
    anchors = numbered(rows.where(is_anchor), "vec_id").select(
        "vec_id", "label", "q", F.floor(F.col("pos") / block).cast("int").alias("block")
    )
    last = anchors.agg(F.max("block")).first()[0]
    found = None
    with batch_rows(spark, max(1, min(10_000, BATCH_BYTES // (8 * max(dims, 1))))):
        for k in range(-1 if last is None else last + 1):
            here = Anchors(anchors.where(F.col("block") == k).orderBy("vec_id").toArrow(), dims, primes)
            near = _best(rows, here.looking_for_positives(), positives).toArrow()
            part = stored(_best(rows, here.looking_for_negatives(near, positives, low, high), negatives), "negatives")
            chosen = stored(spark.createDataFrame(near), "positives")
            part = part.join(
                chosen.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
                ["anchor_id", "slot"],
            )
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _best(rows: DataFrame, sought: Sought, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the first ``k`` rows of every anchor and slot."""
    shared = rows.sparkSession.sparkContext.broadcast(sought)

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Kept(shared.value, k).over(stream)

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    offered = rows.mapInArrow(scan, "anchor_id long, slot int, vec_id long, score long")
    return offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- residues ------------------------------------------------------------------------------


def needed_primes(range_size: int) -> list[int]:
    """Odd primes below `LARGEST_PRIME`, largest first, whose product exceeds ``range_size``; the last is the least that does."""
    primes = [n for n in range(3, LARGEST_PRIME, 2) if all(n % d for d in range(3, isqrt(n) + 1, 2))]
    chosen, product = [], 1
    while product <= range_size:
        enough = [p for p in primes if product * p > range_size]
        chosen.append(enough[0] if enough else primes[-1])
        primes.remove(chosen[-1])
        product *= chosen[-1]
    return chosen


def residues(q: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """Balanced residues of an integer matrix for every prime, as float32."""
    return [((q + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact inner products of all rows of two matrices given by their residues."""
    total = np.zeros((len(left[0]), len(right[0])), np.int64) if primes else None
    modulus = 1
    for a, b, p in zip(left, right, primes, strict=True):
        chunk = EXACT // (p // 2) ** 2
        part = np.zeros(total.shape, np.int32)
        for at in range(0, a.shape[1], chunk):
            part += (a[:, at : at + chunk] @ b[:, at : at + chunk].T).astype(np.int32) % p
        # Garner: what has to be added in multiples of the primes so far.
        total += modulus * ((part - total % p) * pow(modulus, -1, p) % p)
        modulus *= p
    return np.where(total > modulus // 2, total - modulus, total)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as an integer matrix, short rows filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy()
    return out


# --- what a task does ----------------------------------------------------------------------


class Sought:
    """Anchors as residues, with bounds on the score for every anchor (rows) and slot (columns)."""

    def __init__(self, anchors: Anchors, low: np.ndarray, high: np.ndarray, same_label: bool):
        self.anchors, self.low, self.high, self.same_label = anchors, low, high, same_label


class Anchors:
    """One block of anchors."""

    def __init__(self, table: pa.Table, dims: int, primes: list[int]):
        self.dims, self.primes = dims, primes
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.residues = residues(matrix(table["q"].combine_chunks(), dims), primes)

    def looking_for_positives(self) -> Sought:
        """One slot per anchor without bounds, for rows of its label."""
        shape = (len(self.ids), 1)
        return Sought(self, np.full(shape, -MOST, np.int64), np.full(shape, MOST, np.int64), True)

    def looking_for_negatives(self, near: pa.Table, slots: int, low: int, high: int) -> Sought:
        """A slot per positive with its window, for rows of other labels; slots without a positive stay shut."""
        shape = (len(self.ids), slots)
        lows, highs = np.full(shape, 1, np.int64), np.full(shape, 0, np.int64)
        at = np.searchsorted(self.ids, near["anchor_id"].to_numpy())
        slot, score = near["rank"].to_numpy() - 1, near["score"].to_numpy()
        # floor and ceiling of hundredths without leaving 64 bits
        whole, rest = np.divmod(score, 100)
        lows[at, slot] = low * whole - (-low * rest) // 100
        highs[at, slot] = high * whole + high * rest // 100
        return Sought(self, lows, highs, False)


class Kept:
    """The first ``k`` rows per anchor and slot among those seen so far."""

    def __init__(self, sought: Sought, k: int):
        self.sought, self.k = sought, k
        self.slots = sought.low.shape[1]
        # A group that is full takes nothing below its last score, nor of that score with a larger id.
        self.floor = sought.low.copy()
        self.last_id = np.full(sought.low.shape, np.iinfo(np.int64).max)
        self.group, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))

    def over(self, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Read all batches, then give what was kept."""
        rows = max(1, CELLS // (len(self.sought.anchors.ids) * self.slots))
        for batch in stream:
            for at in range(0, batch.num_rows, rows):
                self.add(batch.slice(at, rows))
        anchor, slot = np.divmod(self.group, self.slots)
        for at in range(0, len(anchor), 100_000):
            cut = slice(at, at + 100_000)
            arrays = [self.sought.anchors.ids[anchor[cut]], slot[cut].astype(np.int32) + 1, self.vec[cut], self.score[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=PAIR)

    def add(self, batch: pa.RecordBatch) -> None:
        """Score a batch against the block and keep what is among the first."""
        anchors = self.sought.anchors
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        scores = products(residues(matrix(batch.column(2), anchors.dims), anchors.primes), anchors.residues, anchors.primes)
        alike = labels[:, None] == anchors.labels[None, :]
        fit = alike & (ids[:, None] != anchors.ids[None, :]) if self.sought.same_label else ~alike
        for slot in range(self.slots):
            floor = self.floor[:, slot]
            r, a = np.nonzero(fit & (scores >= floor[None, :]) & (scores <= self.sought.high[None, :, slot]))
            s, vec = scores[r, a], ids[r]
            new = (s > floor[a]) | (vec < self.last_id[a, slot])
            if new.any():
                self.merge(a[new] * self.slots + slot, s[new], vec[new])

    def merge(self, group: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Put rows in and keep the first ``k`` of each group they touch."""
        group, score, vec = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, group))
        group, score, vec = group[order], score[order], vec[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        stay, full = place < self.k, place == self.k - 1
        anchor, slot = np.divmod(group[full], self.slots)
        self.floor[anchor, slot], self.last_id[anchor, slot] = score[full], vec[full]
        self.group, self.score, self.vec = group[stay], score[stay], vec[stay]


def query(embeddings: DataFrame) -> DataFrame:
    """The registered query: every 100th id is an anchor; the label of every 7th is moved on by one."""
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return mine(quantised(embeddings, label), F.col("vec_id") % 100 == 0)
