"""Token ids in a compact file: canonical length-limited Huffman codes from global counts.

Writing: (1) every text is encoded in place and its ids stored compressed; (2) the ids are counted over all
documents, at most one count per vocabulary entry reaches the driver, and package-merge gives code lengths of
at most ``LIMIT`` bits; (3) each document's ids become canonical codes in place, and only coded bytes are
shuffled, into ranges of ``doc_id``; (4) each range is sorted and written as independent blocks.

The file is a folder of two tables. ``codebook`` (id, length) gives the canonical code. ``blocks`` holds, in
ascending ``doc_id`` order over (part, block): the block's doc_ids, their numbers of ids, bit-offset
checkpoints (one at each document's start and one every ``STRIDE`` ids) and the coded bytes. A block needs
nothing but the codebook; its checkpoints are decoded side by side by table lookups on arrays.

Defined cases: a null or empty text has the end id only; a null doc_id sorts first; rows of the same doc_id
stand one after the other, ordered by their ids; one very long text is one block; an empty table gives an
empty folder of blocks and an empty codebook; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import batch_rows, scratch, slices, texts
from paperloom.llm.tokens import encoder, forget, tokenizer_path

LIMIT = 18
STRIDE = 256
BLOCK_IDS = 1 << 19
# Coded bytes that one range of doc_ids should hold.
PART_BYTES = 64 << 20

BLOCKS = "part int, block int, before long, doc_ids array<long>, n_ids array<int>, checkpoints array<int>, data binary"


TOKENS = "doc_id long, ids binary, counts binary"


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with the end id, stored once.

    A task's last row holds no document but how often it has met each id; ``documents_of`` and ``id_counts`` read
    the two kinds of rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(stream):
        own = encoder(path)
        counts = np.zeros(own.vocabulary, np.int64)
        end = np.array([end_id], own.type).tobytes()
        for batch in slices(stream, 1):
            coded = own.encode([t.decode() for t in texts(batch.column(1))])
            counts += np.bincount(np.frombuffer(b"".join(coded), own.type), minlength=len(counts))
            counts[end_id] += len(coded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c + end for c in coded], pa.binary()), pa.nulls(len(coded), pa.binary())],
                ["doc_id", "ids", "counts"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
            ["doc_id", "ids", "counts"],
        )

    spark, held = docs.sparkSession, scratch(docs.sparkSession, "ids")
    with batch_rows(spark, 1000):
        source.mapInArrow(run, TOKENS).write.option("compression", "zstd").parquet(held)
    return spark.read.schema(TOKENS).parquet(held)


def documents_of(tokens: DataFrame) -> DataFrame:
    """(doc_id, ids) of a token table."""
    return tokens.filter("ids is not null").select("doc_id", "ids")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in a token table; one number per vocabulary entry reaches the driver."""

    def run(stream):
        total = np.zeros(0, np.int64)
        for batch in stream:
            for raw in batch.column(0).to_pylist():
                own = np.frombuffer(raw, np.int64)
                total = own + total if len(total) else own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long")
    counted = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    at = counted["id"].to_numpy()
    counts = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    counts[at] = counted["n"].to_numpy()
    return counts


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights, packages, leaves = counts[used].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaves.append(np.cumsum(order < len(used)))
        merged = merged[order][: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for seen in reversed(leaves):
        if take == 0:
            break
        n = seen[take - 1]
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then by id."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in used.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode_ids(
    parts: list[bytes], lengths: np.ndarray, codes: np.ndarray, kind: str = "<u4"
) -> tuple[list[bytes], list[np.ndarray]]:
    """Each document's codes from a byte boundary on, and the bit offsets of its checkpoints."""
    ids = np.frombuffer(b"".join(parts), kind)
    sizes = np.array([len(p) for p in parts], np.int64) // ids.itemsize
    if not len(ids):
        return [b""] * len(parts), [np.zeros(0, np.int32) for _ in parts]
    width = lengths[ids].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(width)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n_bytes = (before[first[1:]] - before[first[:-1]] + 7) // 8
    base = np.concatenate([[0], np.cumsum(n_bytes)])
    at = before[:-1] + np.repeat(base[:-1] * 8 - before[first[:-1]], sizes)
    shifted = codes[ids] << (64 - (at & 31) - width).astype(np.uint64)
    n_words = int(base[-1]) // 4 + 2
    word = at >> 5
    packed = np.bincount(word, (shifted >> np.uint64(32)).astype(float), n_words)
    packed += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), n_words)
    data = packed.astype(">u4").tobytes()
    out, marks = [], []
    for k in range(len(parts)):
        out.append(data[base[k] : base[k + 1]])
        marks.append((at[first[k] : first[k + 1] : STRIDE] - base[k] * 8).astype(np.int32))
    return out, marks


class Decoder:
    """Table-driven decoding of blocks."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        codes, self._limit = canonical(lengths), limit
        used = np.flatnonzero(lengths)
        spare = (limit - lengths[used]).astype(np.uint64)
        starts, reach = (codes[used] << spare).astype(np.int64), (np.uint64(1) << spare).astype(np.int64)
        order = np.argsort(starts)
        self._symbol = np.zeros(1 << limit, np.uint32)
        self._width = np.zeros(1 << limit, np.int64)
        span = np.repeat(used[order], reach[order])
        self._symbol[: len(span)] = span
        self._width[: len(span)] = lengths[span]

    def decode(self, data: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids of the runs that begin at the checkpoints (bits) and hold ``counts`` ids, in order."""
        b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        lanes = np.argsort(-counts, kind="stable")
        at, left = checkpoints[lanes].astype(np.int64), counts[lanes]
        place = (np.cumsum(counts) - counts)[lanes]
        out = np.zeros(int(counts.sum()), np.uint32)
        mask = (1 << self._limit) - 1
        for step in range(int(counts.max(initial=0))):
            k = int(np.searchsorted(-left, -step))
            p = at[:k]
            key = (window[p >> 3] >> (32 - self._limit - (p & 7)).astype(np.uint32)) & mask
            out[place[:k] + step] = self._symbol[key]
            at[:k] += self._width[key]
        return out


def lane_counts(sizes: np.ndarray) -> np.ndarray:
    """Ids behind each checkpoint of documents of these sizes."""
    runs = (sizes + STRIDE - 1) // STRIDE
    counts = np.full(int(runs.sum()), STRIDE, np.int64)
    last = np.cumsum(runs)[runs > 0] - 1
    counts[last] = (sizes - (runs - 1) * STRIDE)[runs > 0]
    return counts


def write_ids(tokens: DataFrame, folder: str, kind: str) -> None:
    """Write a token table in the file format; ``kind`` is the numpy type of its ids."""
    spark, ids = tokens.sparkSession, documents_of(tokens)
    counts = id_counts(tokens)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used], pa.int32())})
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast(lengths)  # one byte per vocabulary entry
    coded_bytes = int((counts * lengths).sum()) // 8
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), coded_bytes // PART_BYTES + 1)
    cuts = ids.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], min(100 * parts, 1_000_000))).first()[0]
    cuts = sorted(set(cuts or []))

    def coded(stream):
        forget()
        lengths, width = shared.value, np.dtype(kind).itemsize
        codes = canonical(lengths)
        for batch in slices(stream, 1):
            doc_ids, raw = batch.column(0), batch.column(1).to_pylist()
            data, marks = encode_ids(raw, lengths, codes, kind)
            known = np.array([x if x is not None else -(1 << 63) for x in doc_ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(np.array(cuts, np.int64), known, "left").astype(np.int32)),
                    doc_ids,
                    pa.array([len(r) // width for r in raw], pa.int32()),
                    pa.array(marks, pa.list_(pa.int32())),
                    pa.array(data, pa.binary()),
                ],
                ["part", "doc_id", "n", "marks", "data"],
            )

    def blocked(stream):
        held, size, last, block, before = [], 0, None, 0, 0

        def made() -> pa.RecordBatch:
            shift = np.cumsum([0, *[len(r[4]) * 8 for r in held]])
            marks = np.concatenate([np.array(r[3], np.int64) + s for r, s in zip(held, shift, strict=False)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([last], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
                    pa.array([[r[2] for r in held]], pa.list_(pa.int32())),
                    pa.array([marks.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([b"".join(r[4] for r in held)], pa.binary()),
                ],
                ["part", "block", "before", "doc_ids", "n_ids", "checkpoints", "data"],
            )

        for batch in stream:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != last or size + row[2] > BLOCK_IDS):
                    yield made()
                    block, before = (block + 1, before + size) if row[0] == last else (0, 0)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += row[2]
        if held:
            yield made()

    rows = ids.mapInArrow(coded, "part int, doc_id long, n int, marks array<int>, data binary")
    ranged = rows.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n", "data")
    with batch_rows(spark, 1000):
        ranged.mapInArrow(blocked, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _documents(doc_ids: list, starts: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"]
    )


def _checksums(doc_ids: list, starts: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    sizes, sums = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(starts), sizes, sums], ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def read_ids(
    spark: SparkSession, folder: str, made: Callable = _documents, schema: str = "doc_id long, start long, ids binary"
) -> DataFrame:
    """(doc_id, start, ids) of every document in a written folder, or what ``made`` makes of a block's documents."""
    book = spark.read.parquet(f"{folder}/codebook").toArrow()  # one row per vocabulary entry
    lengths = np.zeros(int(book["id"].to_numpy().max(initial=-1)) + 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    n_ids = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = dict(blocks.groupBy("part").agg(F.sum(n_ids)).toLocalIterator())  # one row per PART_BYTES of the file
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]

    def run(stream):
        decoder = Decoder(shared.value)
        for batch in stream:
            for part, before, doc_ids, n_ids, marks, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.array(n_ids, np.int64)
                ids = decoder.decode(data, np.array(marks, np.int64), lane_counts(counts)).astype("<u4")
                first = np.concatenate([[0], np.cumsum(counts)])
                parts = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield made(doc_ids, first[:-1] + before + starts[part], parts)

    return blocks.select("part", "before", "doc_ids", "n_ids", "checkpoints", "data").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Encode all texts and write them to ``folder``."""
    write_ids(token_table(docs, path, end_id), folder, encoder(path).type)


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's columns, read from a written folder."""
    return read_ids(spark, folder, _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write all documents and read them back."""
    folder = scratch(spark, "huffman")
    encode_documents(docs, folder, tokenizer_path())
    return digest(spark, folder)
