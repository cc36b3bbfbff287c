"""Inverted lists and stored links against the plain operators."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import adjacency, graph, ivf, vector
from lodestack.plans import queries as core

SF = "/root/testdata/sf0.01"
EDGES = "source string, target string, relation string, origin string"


def top(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.cos, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return core._vectors(spark, SF).select("id", "embedding")


def test_recall_and_exact_mode(spark, vectors, tmp_path):
    path = str(tmp_path / "ivf")
    lists = ivf.write_ivf(vectors, path)
    assert 10 < lists < 30 and spark.read.parquet(f"{path}/vectors").count() == vectors.count()
    asked = vectors.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = top(vector.cosine_topk_batch(vectors, asked, 10))
    exact = top(ivf.search_ivf(spark, path, asked, 10, probes=2, exact=True))
    assert exact == want
    near = {x[:1] + x[2:3] for x in top(ivf.search_ivf(spark, path, asked, 10, probes=lists * 2 // 3))}
    recall = len(near & {x[:1] + x[2:3] for x in want}) / len(want)
    assert recall >= 0.9, recall


def test_clusters_are_told_apart(spark, tmp_path):
    """Where the data has clusters, an exact search leaves most lists unread."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(600)] + [(700, [0.0] * 16), (701, [0.0] * 16)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = str(tmp_path / "ivf")
    ivf.write_ivf(v, path, 24)
    asked = v.where("id < 12 or id = 700").select(F.col("id").alias("query_id"), "embedding")
    got = top(ivf.search_ivf(spark, path, asked, 5, probes=2, exact=True))
    assert got == top(vector.cosine_topk_batch(v, asked, 5))
    lists = ivf._lists(spark, path)
    more = ivf._probes(asked.where("query_id < 12").withColumn("floor", F.lit(0.9)), lists, 2, True).count()
    assert more < 12 * len(lists.numbers) / 3
    # ties go to the lower id, blocks do not matter
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id long, embedding array<double>")
    ivf.write_ivf(same, path, 3)
    assert [r.id for r in ivf.search_ivf(spark, path, same.limit(1).withColumnRenamed("id", "query_id"), 4, exact=True).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_blocks_of_a_list(spark, vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "ivf")
    ivf.write_ivf(vectors, path, 4, sample=50)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    whole = top(ivf.search_ivf(spark, path, asked, 7, probes=1))
    monkeypatch.setattr(ivf, "ROW_BLOCK", 20)
    monkeypatch.setattr(ivf, "QUERY_BLOCK", 3)
    assert top(ivf.search_ivf(spark, path, asked, 7, probes=1)) == whole
    assert ivf.search_ivf(spark, path, asked.limit(0), 7, exact=True).count() == 0
    empty = str(tmp_path / "none")
    ivf.write_ivf(vectors.limit(0), empty)
    with pytest.raises(ValueError):
        ivf.search_ivf(spark, path, asked, 0)


def test_stored_links(spark, tmp_path):
    rows = [("a", "b", "r", "o"), ("b", "c", "z", "o"), ("b", "c", "q", "o"), ("a", "x", "r", "o"), ("x", "c", "r", "o"), ("c", "a", "r", "o2"), ("far", "off", "r", "o")]
    rows += [("hub", f"n{i}", "r", "o") for i in range(50)]
    e = spark.createDataFrame(rows, EDGES)
    path = str(tmp_path / "links")
    adjacency.write_adjacency(e, path)
    full = lambda df: sorted(map(str, df.collect()))
    for ids in (["b", "lonely"], ["hub", "a"], []):
        seeds = spark.createDataFrame([(i,) for i in ids], "note_id string")
        for hops in (0, 1, 2):
            assert full(adjacency.expand_stored(spark, path, seeds, hops)) == full(graph.expand(e, seeds, hops))
    # many queries at once: each as if alone
    sets = {1: ["a"], 2: ["b", "hub"], 3: ["c", "a"], 4: ["nobody"]}
    seeds = spark.createDataFrame([(q, n) for q, ns in sets.items() for n in ns], "query_id long, note_id string")
    got = adjacency.expand_stored(spark, path, seeds, 2).collect()
    for q, ns in sets.items():
        alone = graph.expand(e, spark.createDataFrame([(n,) for n in ns], "note_id string"), 2)
        assert sorted((r.note_id, r.hops, r.path, r.relations) for r in got if r.query_id == q) == sorted((r.note_id, r.hops, r.path, r.relations) for r in alone.collect())
    with pytest.raises(ValueError):
        adjacency.expand_stored(spark, path, seeds, 3)
    # a hop needs its frontier's folders only
    b = spark.createDataFrame([("b",)], "note_id string")
    bucket = b.select(adjacency._bucket(F.col("note_id"), adjacency.BUCKETS)).first()[0]
    others = [d for d in os.listdir(path) if d.startswith("bucket=") and d != f"bucket={bucket}"]
    assert others
    for d in others:
        shutil.rmtree(os.path.join(path, d))
    assert {r.note_id for r in adjacency.expand_stored(spark, path, b, 1).collect()} == {"a", "b", "c"}
