"""Batched hybrid search against the search of one query at a time, and the gate's near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.config import Retrieval
from lodestack.operators import batch_search, embed, gate, hybrid, lexical, segments

WORDS = "alpha beta gamma delta für fur élan epsilon zeta eta theta iota kappa".split()
NOTE = "note_id string, type string, scope string, agent string, profile string, status string, confidence string, tags array<string>, title string"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    notes, rows = [], []
    for i in range(90):
        notes.append((f"n{i}", r.choice(["semantic", "procedural"]), r.choice(["s0", "s1", None]), r.choice(["a", None]), None, r.choice(["ativo", "ativo", None, "arquivado", "deprecado"]), r.choice(["low", "medium", "high", None]), r.sample(["x", "y", "z"], r.randint(0, 3)) or None, f"T{i}"))
        for part in range(r.randint(1, 3)):
            text = " ".join(r.choices(WORDS, k=r.randint(1, 12))) if r.random() > 0.1 else None
            rows.append((f"n{i}#{part}", f"n{i}", part, text, None if text is None else embed.hash_vector(text, 16).tolist()))
    return spark.createDataFrame(rows, "chunk_id string, note_id string, ordinal int, text string, embedding array<double>"), spark.createDataFrame(notes, NOTE)


CASES = [
    ("alpha beta", {}),
    ("für fur", {"status": ["ativo", "arquivado"]}),
    ("gamma Gamma élan", {"tags": ["x", "y"]}),
    ("zeta zeta eta", {"min_confidence": ["medium"], "agent": ["a"]}),
    ("theta", {"confidence": ["low", "high"], "scope": ["s0"]}),
    ("nothing known here", {}),
    ("", {"type": ["semantic"]}),
]


@pytest.mark.parametrize("k", [3, 12])
def test_equals_single_searches(spark, corpus, k):
    chunks, notes = corpus
    vectors = [embed.hash_vector(t, 16).tolist() for t, _ in CASES]
    queries = spark.createDataFrame([(i, t, v, f) for i, ((t, f), v) in enumerate(zip(CASES, vectors))], f"query_id long, text string, embedding array<double>, filters {batch_search.FILTERS}")
    got = batch_search.search_many(chunks, notes, queries, k, settings=Retrieval()).collect()
    edges = spark.createDataFrame([], "source string, target string, relation string, origin string")
    for i, (text, filters) in enumerate(CASES):
        want = hybrid.search(chunks, notes, edges, text, vectors[i], k, {a: b[0] if a == "min_confidence" else b for a, b in filters.items()}, hops=0).collect()
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [(r.note_id, round(r.score, 6), round(r.similarity, 6)) for r in mine] == [(r.note_id, r.score, r.similarity) for r in want], text


def test_same_fields_equal_filters(spark, corpus):
    """Meeting on type and scope finds what filters on them find, in blocks of any size."""
    chunks, notes = corpus
    cases = [(i, t, s) for i, (t, s) in enumerate((t, s) for t in ("semantic", "procedural", "other", None) for s in ("s0", "s1", None))]
    text = "alpha für gamma"
    v = embed.hash_vector(text, 16).tolist()
    queries = spark.createDataFrame([(i, text, v, t, s, {"type": [t], "scope": [s]}) for i, t, s in cases], f"query_id long, text string, embedding array<double>, type string, scope string, filters {batch_search.FILTERS}")
    rows = lambda df: sorted((r.query_id, r["rank"], r.note_id, round(r.score, 9)) for r in df.collect())
    same = rows(batch_search.search_many(chunks, notes, queries.drop("filters"), 4, ("type", "scope")))
    usual = rows(batch_search.search_many(chunks, notes, queries.where("type is not null and scope is not null"), 4))
    assert same == usual and same
    fields = chunks.join(notes, "note_id")
    q = queries.withColumn("filters", F.lit(None).cast(batch_search.FILTERS))
    pools = [sorted(map(tuple, batch_search.dense_pools(fields, q, 5, ("type", "scope"), *b).select("query_id", "chunk_id", F.round("cos", 9)).collect())) for b in ((1024, 8192), (1, 3))]
    assert pools[0] == pools[1]


def test_stored_postings(spark, corpus, tmp_path):
    chunks, notes = corpus
    stored = segments.upsert(spark, str(tmp_path / "i"), chunks)
    queries = spark.createDataFrame([(1, "alpha eta", embed.hash_vector("alpha", 16).tolist())], "query_id long, text string, embedding array<double>")
    rows = lambda **kw: sorted((r.note_id, round(r.score, 9)) for r in batch_search.search_many(chunks, notes, queries, 5, **kw).collect())
    assert rows(index=(segments.postings(spark, stored), stored.chunks, stored.tokens)) == rows()
    with pytest.raises(ValueError):
        batch_search.search_many(chunks, notes, queries, 0)
    assert batch_search.search_many(chunks, notes, queries.limit(0), 5).count() == 0
    assert batch_search.search_many(chunks.limit(0), notes, queries, 5).count() == 0


def test_terms(spark):
    texts = ["für fur FÜR", "a_b c-d ½", "", None, "Straße STRASSE"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(batch_search.terms_of(F.col("t")).alias("t")).collect()]
    assert got[0] == lexical.query_terms(texts[0]) == ["fur", "fur"] and got[2:4] == [[], []] and got[1] == ["a", "b", "c", "d", "½"]


def test_gate_sees_what_a_search_finds(spark):
    words = " ".join(f"word{i}" for i in range(60))
    stored = [("n1", "semantic", "p", "T", words), ("n2", "semantic", "q", "T", words), ("n3", "procedural", "p", "T", words), ("n4", "semantic", "p", "T", "else entirely"), ("n5", "semantic", "p", "T", words + " more")]
    rows = spark.createDataFrame(stored, "note_id string, type string, scope string, title string, body string")
    rows = rows.withColumns({"status": F.when(F.col("note_id") == "n5", "arquivado"), "agent": F.lit(None).cast("string"), "profile": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "text": batch_search.dedup_query(F.col("title"), F.col("body"))})
    vectors = embed.hash_embed(rows.select(F.col("note_id").alias("id"), "text")).withColumnRenamed("id", "note_id")
    chunks = rows.join(vectors, "note_id").select(F.concat("note_id", F.lit("#0")).alias("chunk_id"), "note_id", F.lit(0).alias("ordinal"), "text", "embedding")
    new = spark.createDataFrame([("c1", "semantic", "p", "T", words + " extra"), ("c2", "semantic", "q", " ", "else entirely"), ("c3", "semantic", None, "T", words), ("n1", "semantic", "p", "T", words)], "note_id string, type string, scope string, title string, body string")
    new = new.withColumn("text", batch_search.dedup_query(F.col("title"), F.col("body")))
    asked = new.join(embed.hash_embed(new.select(F.col("note_id").alias("id"), "text")).withColumnRenamed("id", "note_id"), "note_id")
    got = {r.note_id: r.similar for r in batch_search.near_notes(asked, chunks, rows).collect()}
    assert got == {"c1": ["n1"]}
    assert {r.note_id: r.similar for r in batch_search.near_notes(asked, chunks, rows, 1.0).collect()} == {}
    assert np.dot(embed.hash_vector(f"T\n\n{words} extra"), embed.hash_vector(f"T\n\n{words}")) > 0.92
    assert gate.ATOMIC_CHARS and new.where(F.length("text") > 2000).count() == 0
