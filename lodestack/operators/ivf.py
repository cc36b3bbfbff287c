"""A vector index of inverted lists: centroids, vectors stored by their nearest, searches that read a few lists.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, those of the least hashes);
every vector is indexed.  A list knows the largest angle between its centroid and its
vectors, so no vector in it is nearer to a query than the query's angle to the centroid
less that.  An exact search probes some lists, and then all whose bound does not rule out
a place among the k best so far; it gives what ``vector.cosine_topk_batch`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..workspace import cut
from .vector import _best, _unit

#: Rows that centroids are fitted on, rounds of fitting, and most lists: what the driver sees is no more.
SAMPLE, ROUNDS, MOST_LISTS = 10_000, 8, 1024
#: Rows of a list that meet a block of queries in one task.
ROW_BLOCK, QUERY_BLOCK = 16384, 2048
#: What bounds are widened by, for the noise of their sums.
SLACK = 1e-7


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; a list that runs empty keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, size, out=centres, where=size > 0)
    return centres


@dataclass(frozen=True)
class Lists:
    """Centroids, radii (angles) and sizes of the lists of a stored index, in order of their numbers."""

    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def write_ivf(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> int:
    """Store ``vectors`` (id, embedding) below ``path`` by lists; how many lists there are.

    Without ``lists`` there are about as many as the root of the rows.  Zero vectors lie
    with the first centroid at a right angle.
    """
    n = vectors.count()
    lists = min(lists or max(int(n**0.5), 1), MOST_LISTS)
    some = vectors.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
    centres = fit(_unit(pd.Series([r["embedding"] for r in some])), lists) if some else np.zeros((1, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = _unit(batch.column("embedding")) @ shared.value.T
                nearest = np.argmax(cos, axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(cos)), nearest], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle), pa.array(nearest.astype(np.int32))], ["id", "embedding", "angle", "list"])

    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = rows.mapInArrow(assign, f"id {vectors.schema['id'].dataType.simpleString()}, embedding array<double>, angle double, list int").hint("rebalance", "list")
    dealt.sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors") if n else None
    found = stored.groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect() if n else []
    table = [(r["list"], centres[r["list"]].tolist(), r["radius"], r["n"]) for r in found]
    vectors.sparkSession.createDataFrame(table, "list int, centre array<double>, radius double, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return len(table)


def _lists(spark: SparkSession, path: str) -> Lists:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    return Lists(np.array([r["list"] for r in rows], np.int32), np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows]))


def _probes(queries: DataFrame, lists: Lists, most: int, floors: bool) -> DataFrame:
    """query_id, embedding, list: the ``most`` lists of the highest bounds or, with ``floors``, all others whose bound reaches the query's ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast(lists)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows or not len(known.numbers):
                continue
            angle = np.arccos(np.clip(_unit(batch.column("embedding")) @ known.centres.T, -1, 1))
            bound = np.cos(np.clip(angle - known.radii - SLACK, 0, np.pi))
            order = np.argsort(-bound, axis=1, kind="stable")
            at = np.repeat(np.arange(len(bound)), len(known.numbers))
            rank, which = np.tile(np.arange(len(known.numbers)), len(bound)), order.ravel()
            wanted = rank < most
            if floors:
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                wanted = ~wanted & (bound[at, which] >= floor[at] - SLACK)
            at, which = at[wanted], which[wanted]
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(rows), batch.column("embedding").take(rows), pa.array(known.numbers[which])], ["query_id", "embedding", "list"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInArrow(choose, f"query_id {kind}, embedding array<double>, list int")


def _meet(spark: SparkSession, path: str, probes: DataFrame, lists: Lists, n_queries: int, k: int) -> DataFrame:
    """query_id, id, cos: k best of each probed block of a list for each query that probes it."""
    probes = cut(probes)
    wanted = [r[0] for r in probes.select("list").distinct().collect()]
    stored = spark.read.parquet(f"{path}/vectors")
    rows = stored.where(F.col("list").isin(*wanted) if wanted else F.lit(False))
    blocks = F.create_map(*[F.lit(x) for number, n in zip(lists.numbers.tolist(), lists.sizes.tolist(), strict=True) for x in (number, -(-n // ROW_BLOCK))])
    q_blocks = max(-(-n_queries // QUERY_BLOCK), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = probes.withColumn("x", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("y", each(blocks[F.col("list")]))
    right = rows.select("id", "embedding", "list", F.pmod(F.xxhash64("id"), blocks[F.col("list")]).cast("int").alias("y")).withColumn("x", each(F.lit(q_blocks)))
    schema = f"query_id {probes.schema['query_id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, cos double"

    def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({"query_id": asked.query_id[:0], "id": found.id[:0], "cos": np.array([], np.float64)})
        ids = found.id.to_numpy()
        at, cos = _best(_unit(asked.embedding) @ _unit(found.embedding).T, ids, k)
        return pd.DataFrame({"query_id": np.repeat(asked.query_id.to_numpy(), at.shape[1]), "id": ids[at].ravel(), "cos": cos.ravel()})

    return left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInPandas(best, schema)


def search_ivf(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, id, cos, rank: the k most similar of the vectors stored below ``path`` for each query (query_id, embedding).

    ``probes`` lists are searched for each query; ``exact`` goes on with all that can still
    hold one of the k best.  Ties go to the lower id.
    """
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be positive")
    asked = cut(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")))
    lists, n = _lists(spark, path), asked.count()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    ranked = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    first = ranked(_meet(spark, path, _probes(asked, lists, probes, False), lists, n, k))
    if not exact:
        return first
    first = cut(first)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("cos")).otherwise(-2.0).alias("floor"))
    again = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))).select("query_id", "embedding", "floor")
    more = _meet(spark, path, _probes(again, lists, probes, True), lists, n, k)
    return ranked(first.drop("rank").unionByName(more))
