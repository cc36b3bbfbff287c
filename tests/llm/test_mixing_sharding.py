import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string"


def docs(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 7}" if i % 5 else None) for i in range(400)]
    rows += [(i, "hot " * 30, "s3") for i in range(1000, 1400)] + [(7, None, "s1"), (None, "a b", "s2"), (None, "a b", "s2"), (5, "", "empty")]
    return spark.createDataFrame(rows, SCHEMA)


def fill(sizes, weights, cap=3.0):
    """Water-filling by repeated clamping."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    rest = float(total)
    while True:
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= over


def test_mix_plan(spark):
    plan = mixing.plan_mix(docs(spark)).toPandas()
    assert len(plan) == 804
    plan["source"] = plan.source.fillna("~")
    sizes = plan.groupby("source")["size"].sum().to_dict()
    weights = dict(zip(sorted(sizes), itertools.cycle((5.0, 2.0, 1.0))))
    want = fill(sizes, weights)
    for source, rows in plan.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[source]) and rows.source_size.iloc[0] == sizes[source]
        assert abs(rows.taken.sum() - want[source]) <= max(2, 0.02 * want[source])
    assert (plan.taken == plan["size"] * plan.copies).all() and (plan.copies <= 3).all()
    again = mixing.plan_mix(docs(spark).repartition(7)).toPandas()
    key = ["unit", "copies"]
    assert sorted(map(tuple, plan[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_mix_rows(spark):
    d = docs(spark).withColumns({"unit": F.lit(1), "size": F.lit("x"), "_copy": F.lit(0)})
    out = mixing.mix(d)
    assert out.columns == d.columns
    plan = mixing.plan_mix(d)
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.plan_mix(d.limit(0)).count() == 0
    given = spark.createDataFrame([("s1", 1.0)], "source string, weight double")
    taken = mixing.plan_mix(d, given).where("taken > 0").select("source").distinct().collect()
    assert [r.source for r in taken] == ["s1"]


def smallest(sizes, most):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                n, room = n + 1, mid
            room -= s
        low, high = (low, mid) if n <= most else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_shards_are_minimax(spark, shards):
    d = docs(spark)
    got = sharding.shard(d, shards).toPandas()
    text = got.text.fillna("")
    assert (got["size"] == text.str.encode("utf-8").str.len() + 16).all()
    assert list(got.text_crc32) == [zlib.crc32(t.encode()) for t in text]
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert got.groupby(text)["shard"].nunique().max() == 1
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    # the order of groups is the unsigned hash of their text
    units = d.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
    ordered = [r.s for r in sorted(units, key=lambda r: r.k % (1 << 64))]
    assert got.groupby("shard")["size"].sum().max() == smallest(ordered, shards)


def test_shard_cuts_with_many_groups(spark):
    d = spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    d = d.union(spark.range(9000).select(F.col("id") + 50000, F.lit("hot group")))
    rows = d.withColumn("key", F.xxhash64("text")).withColumn("size", F.octet_length("text") + 16).groupBy("key").agg(F.sum("size").alias("size"))
    cuts = sharding.balanced_cuts(rows, 16)
    ordered = sorted((r.key % (1 << 64), r["size"]) for r in rows.collect())
    sizes = [sum(s for k, s in ordered if lo <= k < hi) for lo, hi in zip([0, *cuts], [*cuts, 1 << 64])]
    assert max(sizes) == smallest([s for _, s in ordered], 16) and len(cuts) <= 15


def test_no_rows_to_shard(spark):
    assert sharding.shard(docs(spark).limit(0), 40).count() == 0
    clash = docs(spark).withColumns({"slot": F.lit("x"), "shard": F.lit("y"), "_run": F.lit(2)}).drop("_run")
    out = sharding.shard(clash, 3)
    assert out.columns.count("slot") == 1 and dict(out.dtypes)["slot"] == "bigint"
