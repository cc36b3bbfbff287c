import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import adjacency


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_counts_what_is_expanded(spark, tmp_path, monkeypatch, hops):
    """In one turn and in several; paths that sort otherwise as lists than as strings, parallel links, loops, a seed without links."""
    r = random.Random(hops)
    nodes = ["a", "a0", "a>b", "b", "b1", "c", "d10", "d1", "e", "f", "g"]
    links = [(r.choice(nodes), r.choice(nodes), r.choice("xy"), "o") for _ in range(16)]
    path = str(tmp_path / "links")
    adjacency.write_adjacency(spark.createDataFrame(links, "source string, target string, relation string, origin string"), path, 4)
    seeds = spark.createDataFrame([(q, n) for q in range(6) for n in r.sample(nodes, 2)] + [(9, "alone")], "query_id long, note_id string")
    want = adjacency.expand_stored(spark, path, seeds, hops, 3, 4).groupBy("query_id", "hops").agg(F.count("*").alias("reached"), F.min(F.array_join("path", ">")).alias("least_path"))
    rows = lambda df: sorted((r.query_id, r.hops, r.reached, r.least_path) for r in df.collect())
    stored, kept = [], adjacency.cut
    monkeypatch.setattr(adjacency, "cut", lambda df: stored.append(df := kept(df)) or df)
    whole = rows(adjacency.reach_stored(spark, path, seeds, hops, 3, 4))
    turns = len(stored)
    assert whole == rows(want) and max(h for _, h, *_ in whole) == hops
    stored.clear()
    assert rows(adjacency.reach_stored(spark, path, seeds.union(seeds.select(F.col("query_id") + 100, "note_id")), hops, 3, 4, 1)) == sorted(whole + [(q + 100, *x) for q, *x in whole])
    assert len(stored) > turns or hops == 1
    with pytest.raises(ValueError):
        adjacency.reach_stored(spark, path, seeds, 0)
