import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import packing, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, pieces int, Sequence_ID int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.WORDS)


def checked(sequences, texts, tokenizer, capacity):
    """Rebuilds every document's tokens from the sequences; returns the share of padding."""
    found, padding, total = {}, 0, 0
    for row in sequences:
        ids = np.frombuffer(row.ids, "<u4")
        assert len(ids) == row.n_tokens <= capacity
        at = 0
        for p in row.pieces:
            assert p.offset == at and p.length > 0
            found.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids[at : at + p.length].tolist()))
            at += p.length
        assert at == len(ids)
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    want = sorted((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in texts)
    got = []
    for (d, tokens), parts in found.items():
        ids = [i for _, p in sorted(parts) for i in p]
        assert len(ids) % tokens == 0
        got.append((d, ids))
    assert sorted(got) == want
    assert len({r.sequence_id for r in sequences}) == len(sequences)
    return padding / total


def test_all_documents_come_back(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for parts in (1, 3):
        sequences = packing.pack(docs.repartition(parts), queries.WORDS).collect()
        assert checked(sequences, texts, tokenizer, 2048) < 0.02


def test_edges(spark, tokenizer):
    long = "a very long text of many words " * 40_000
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "Héllo <|endoftext|> it's ǅ x y ١٢"), (5, long), (6, "x" * 5000), (8, "́a é")]
    docs = spark.createDataFrame([(*t, "i", 1, 2) for t in texts], SCHEMA)
    sequences = packing.pack(docs, queries.WORDS, 256, 16).collect()
    assert checked(sequences, texts, tokenizer, 256) < 0.02
    assert packing.pack(docs.limit(0), queries.WORDS).count() == 0
    twice = spark.createDataFrame([(None, "a b", "", 0, 0)] * 2 + [(7, "a b", "", 0, 0)] * 2, SCHEMA)
    pieces = packing.piece_digests(packing.pack(twice, queries.WORDS)).collect()
    assert {d: sum(r.length for r in pieces if r.doc_id == d) for d in (None, 7)} == {None: 6, 7: 6} and {r.doc_tokens for r in pieces} == {3}
    with pytest.raises(ValueError):
        packing.pack(docs, queries.WORDS, 256, 17)


def test_digests(spark, tokenizer):
    rows = queries.op11_harmonic_packing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=60), st.sampled_from([(64, 8), (256, 16), (100, 10)]))
def test_bins(lengths, shape):
    """Every class holds a fixed number of pieces and no sequence overflows."""
    capacity, classes = shape
    out = []
    bins, total = packing.Bins(capacity, out.append), 0
    for doc, n in enumerate(lengths):
        start = 0
        assert sum(packing.cuts(n, capacity, classes)) == n
        for length in packing.cuts(n, capacity, classes):
            assert 0 < length <= capacity
            bins.add((doc, start, bytes(4 * length), n))
            start += length
        total += n
    full = len(out)
    sizes = [sum(len(p[2]) // 4 for p in s) for s in out]
    assert all(capacity // (len(p[2]) // 4) == len(s) for s in out for p in s)
    assert all(n <= capacity and n * (len(s) + 1) > capacity * len(s) - len(s) * len(s) for n, s in zip(sizes, out))
    assert all(len(held) < kind for kind, held in bins.open.items())
    bins.close()
    rest = [sum(len(p[2]) // 4 for p in s) for s in out[full:]]
    assert all(n == capacity or n & (n - 1) == 0 for n in rest) and sum(sizes) + sum(rest) == total


def test_padded(spark):
    row = spark.createDataFrame([(1,), (3,), (1024,), (2047,), (2048,)], "n long").select(packing.padded(F.col("n")).alias("p")).collect()
    assert [r.p for r in row] == [1, 2048, 1024, 2048, 2048]
