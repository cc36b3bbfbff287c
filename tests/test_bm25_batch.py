import collections
import itertools
import math

import pytest
from oracle import SF, connection
from pyspark.sql import functions as F

from lodestack.operators import lexical
from lodestack.plans import queries as core, tables as tb
from lodestack.workspace import cut


def test_ties_keep_the_lowest_ids_before_the_cut(spark):
    """Equal parts of a sum in every order; their sums differ in the last bit."""
    terms = ["t1", "t2", "t3", "t4", "t5"]
    rows = [(i, t, n, 15) for i, order in enumerate(itertools.permutations((1, 2, 3, 4, 5))) for t, n in zip(terms, order, strict=True)]
    index = spark.createDataFrame(rows, "chunk_id long, term string, tf int, length int")
    lengths = spark.range(400).select(F.col("id").alias("chunk_id"), F.lit(15).alias("length"))
    asked = spark.createDataFrame([(0, t) for t in terms], "query_id long, term string")
    got = lexical.bm25_batch(index, lengths, asked, 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3]


def test_whole_texts_are_asked(spark):
    """Brute force with every token of every query text."""
    tok = dict(connection().execute(f"{tb.views('tok')} SELECT doc_id, t FROM tok").fetchall())
    tf = {i: collections.Counter(t) for i, t in tok.items()}
    df = collections.Counter(w for c in tf.values() for w in c)
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    idf = {w: max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for w, d in df.items()}
    want = {}
    for q in (i for i in tok if i % 100 == 0):
        scores = [(math.fsum(k * idf[w] * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * len(tok[i]) / avg)) for w, k in tf[q].items() if w in tf[i]), i) for i in tok if tf[q].keys() & tf[i].keys()]
        want |= {(q, i): s for s, i in sorted(scores, key=lambda x: (-round(x[0], 9), x[1]))[:5]}
    got = {(r.query_id, r.chunk_id): r.score for r in core.QUERIES["bm25_batch_whole"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6) and any(len(tok[q]) > 5 for q, _ in want)


def test_slugs_read_whole_texts(spark):
    longest = max(len(r.slug) for r in core.QUERIES["slugs_whole"](spark, SF).collect())
    assert longest > 60


@pytest.mark.parametrize("blocks", [(4096, 1024), (2, 3)])
def test_blocks_of_any_size_find_the_same(spark, blocks):
    """Terms that most chunks hold and terms of few, copies, an empty text, in one block and in many."""
    texts = [" ".join(f"w{j % (1 + i % 7)}" for j in range(5 + i % 4)) + f" only{i // 2}" for i in range(40)] + ["", "nothing else"]
    held = cut(lexical.bags(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3), ["chunk_id"]))
    asked = held.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), "terms", F.col("tfs").alias("times"))
    counts = [collections.Counter(t.split()) for t in texts]
    df, n, words = collections.Counter(w for c in counts for w in c), len(texts), sum(c.total() for c in counts)
    want = {}
    for q in range(0, n, 5):
        scores = [(math.fsum(k * max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() * n / words)) for w, k in counts[q].items() if w in c), i) for i, c in enumerate(counts) if counts[q].keys() & c.keys()]
        want |= {(q, i): (pytest.approx(s), r + 1) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-round(x[0], 9), x[1]))[:4])}
    got = lexical.bm25_bags(held, asked, n, words, 4, *blocks).collect()
    assert {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in got} == want and len(got) == len(want)
    assert lexical.bm25_bags(held, asked.limit(0), n, words, 4, *blocks).count() == 0


@pytest.mark.parametrize("name", ["bm25_batch", "bm25_batch_whole"])
def test_scores_are_not_joined(spark, name):
    """Pairs of queries and chunks never become rows of a join: only the best of each task leave it."""
    plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" not in plan
