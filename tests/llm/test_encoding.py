"""Token output: exact round trips and plain encoding."""

from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import encoding as op
from paperloom.llm.common import scratch
from paperloom.llm.tokens import Encoder, tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
PLAIN.encode_special_tokens = True
ENCODER = Encoder(tokenizer_path())


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é's'll1.,!\n\t  　\x1c", max_size=40), max_size=4))
def test_chunked_ids_are_the_ids_of_the_whole_text(texts):
    coded = ENCODER.encode(texts)
    assert [np.frombuffer(c, ENCODER.type).tolist() for c in coded] == [plain(t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300))
def test_code_lengths_fit_and_fill(counts):
    lengths = op.code_lengths(np.array(counts), 9).astype(float)
    used = lengths[lengths > 0]
    assert (lengths > 0).tolist() == [c > 0 for c in counts]
    assert used.max(initial=0) <= 9
    if len(used) > 1:
        assert abs((2.0**-used).sum() - 1) < 1e-9


def test_arrays_survive_coding():
    rng = np.random.default_rng(1)
    parts = [rng.zipf(1.3, n).clip(0, 5000).astype("<u4").tobytes() for n in (0, 1, 255, 256, 257, 9000, 3)]
    counts = np.bincount(np.frombuffer(b"".join(parts), "<u4"))
    lengths = op.code_lengths(counts)
    data, marks = op.encode_ids(parts, lengths, op.canonical(lengths))
    decoder = op.Decoder(lengths)
    for raw, coded, at in zip(parts, data, marks, strict=True):
        n = op.lane_counts(np.array([len(raw) // 4]))
        assert decoder.decode(coded, at.astype(np.int64), n).astype("<u4").tobytes() == raw


def expected(pairs):
    """(doc_id, start, n_tokens, crc) in file order."""
    coded = sorted(
        ((d is not None, d or 0), len(ids), d, ids) for d, t in pairs for ids in [plain(t) + [2]]
    )
    at, out = 0, []
    for _, n, d, ids in coded:
        out.append((d, at, n, zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += n
    return out


def test_written_and_read_back(spark, awkward, nothing, pairs):
    got = sorted((tuple(r) for r in op.query(spark, awkward).collect()), key=lambda r: r[1])
    assert got == expected(pairs)
    assert op.query(spark, nothing).count() == 0
    assert op.query(spark, nothing.unionByName(awkward.filter("doc_id = 4"))).collect()[0].n_tokens == 1


def test_small_blocks(spark, awkward, pairs, monkeypatch):
    folder = scratch(spark, "huffman")
    op.encode_documents(awkward.withColumnRenamed("lang", "ids").withColumnRenamed("source", "part"), folder, tokenizer_path())
    blocks = spark.read.parquet(f"{folder}/blocks").orderBy("part", "block").collect()
    ids = [d for b in blocks for d in b.doc_ids if d is not None]
    assert ids == sorted(ids)
    assert sum(sum(b.n_ids) for b in blocks) == sum(r[2] for r in expected(pairs))


def test_added_tokens_get_the_ids_of_an_unmodified_tokenizer():
    own = Tokenizer.from_file(tokenizer_path())
    marks = [t.content for t in own.get_added_tokens_decoder().values()]
    assert marks
    texts = [t for m in marks for t in (m, f"a {m} b", f"a{m}b  {m}\n c", f"a {m[:-1]} b", f"{m}{m} d'll")]
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(c, ENCODER.type).tolist() for c in Encoder(tokenizer_path()).encode(texts)] == want
