"""Links stored from both ends by a hash of the node, and expansion that reads the frontier's folders only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workspace import cut, shuffles_dropped
from .graph import undirected

#: Folders that links are dealt to.
BUCKETS = 256


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def write_adjacency(edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store ``edges`` (source, target, relation, origin) from both ends below ``path``.

    Folders are brought together by size, so a node with very many links is spread over
    several files.
    """
    rows = undirected(edges).withColumn("bucket", _bucket(F.col("here"), buckets)).hint("rebalance", "bucket")
    with shuffles_dropped(edges.sparkSession):
        rows.sortWithinPartitions("bucket", "here", "there").write.mode("overwrite").partitionBy("bucket").parquet(path)


def steps_from(spark: SparkSession, path: str, nodes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """here, there, relation, origin of the links of ``nodes`` (here); other nodes' folders are not read."""
    wanted = [r[0] for r in nodes.select(_bucket(F.col("here"), buckets).alias("b")).distinct().collect()]
    rows = spark.read.schema("here string, there string, relation string, origin string, bucket int").parquet(path)
    return rows.where(F.col("bucket").isin(*wanted) if wanted else F.lit(False)).drop("bucket")


def expand_stored(spark: SparkSession, path: str, seeds: DataFrame, hops: int, most: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """note_id, seed, hops, path, relations as ``graph.expand`` gives them, from stored links.

    ``seeds`` is (note_id) or, for many queries at once, (query_id, note_id): each query
    is then expanded from its own seeds, and query_id comes first.  Every hop reads the
    folders of its frontier, which is written out once.
    """
    if not 0 <= hops <= most:
        raise ValueError(f"hops must be between 0 and {most}")
    own = [c for c in ("query_id",) if c in seeds.columns]
    none = F.array().cast("array<string>")
    reached = cut(seeds.select(*own, "note_id").distinct().select(*own, "note_id", F.lit(0).alias("hops"), F.array("note_id").alias("path"), none.alias("relations")))
    frontier = reached
    for hop in range(1, hops + 1):
        steps = steps_from(spark, path, frontier.select(F.col("note_id").alias("here")).distinct(), buckets)
        chain = F.struct(F.array_append("path", F.col("there")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"), "origin")
        chains = frontier.join(steps, F.col("note_id") == F.col("here")).select(*own, "there", chain.alias("chain"))
        fresh = chains.join(reached.select(*own, F.col("note_id").alias("there")), [*own, "there"], "left_anti")
        frontier = cut(fresh.groupBy(*own, "there").agg(F.min("chain").alias("c")).select(*own, F.col("there").alias("note_id"), F.lit(hop).alias("hops"), "c.path", "c.relations"))
        reached = reached.union(frontier)
    return reached.select(*own, "note_id", F.col("path")[0].alias("seed"), "hops", "path", "relations")


#: Chains that are followed at once, however few links there are.
CHAINS = 10_000_000


def reach_stored(spark: SparkSession, path: str, seeds: DataFrame, hops: int, most: int = 2, buckets: int = BUCKETS, chains: int = CHAINS) -> DataFrame:
    """query_id, hops, reached, least_path: how many notes each query reaches by each hop, and the least of their paths joined by ``>``.

    That is ``expand_stored`` of (query_id, note_id) seeds, counted, but what the last hop
    reaches is never stored, and its chains carry the number of the path that they go on
    from, in place of the path.  Queries take turns: as many at once as there are chains
    for every link, so that disk grows with the links, however many queries there are.
    """
    if not 1 <= hops <= most:
        raise ValueError(f"hops must be between 1 and {most}")
    told = lambda c: F.array_join(c, ">")
    with shuffles_dropped(spark):
        near = cut(expand_stored(spark, path, seeds, hops - 1, most, buckets).select("query_id", "note_id", "hops", "path"))
        out = cut(near.groupBy("query_id", "hops").agg(F.count("*").alias("reached"), F.min(told("path")).alias("least_path")))
        # numbers in the order of the paths of a query
        ends = near.where(F.col("hops") == hops - 1).orderBy("query_id", "path").select("query_id", F.col("note_id").alias("here"), told("path").alias("path"), F.monotonically_increasing_id().alias("number"))
        ends = cut(ends)
        steps = steps_from(spark, path, ends.select("here").distinct(), buckets).select("here", "there")
        often = steps.groupBy("here").agg(F.count("*").alias("_n")).join(ends.groupBy("here").agg(F.count("*").alias("_m")), "here")
        total = often.agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]
        turns = max(-(-total // max(spark.read.parquet(path).count(), chains)), 1)
        for turn in range(turns):
            mine = F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn
            further = ends.where(mine).join(steps, "here").select("query_id", "there", "number")
            known = near.where(mine).select("query_id", F.col("note_id").alias("there"), F.lit(-1).cast("long").alias("number"))
            first = further.union(known).groupBy("query_id", "there").agg(F.min("number").alias("number")).where("number >= 0")
            each = first.groupBy("number").agg(F.count("*").alias("n"), F.min("there").alias("there"))
            whole = each.join(ends.where(mine).select("query_id", "number", "path"), "number").groupBy("query_id").agg(F.sum("n").alias("reached"), F.min(F.concat("path", F.lit(">"), "there")).alias("least_path"))
            out = out.union(cut(whole.select("query_id", F.lit(hops).alias("hops"), "reached", "least_path")))
    return out
