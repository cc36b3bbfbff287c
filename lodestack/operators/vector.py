"""Brute-force vector search, near-duplicate pairs and vector table maintenance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import cosine, is_valid, l2_normalize
from ..workspace import cut, shuffles_dropped

#: Queries in one broadcast or block; rows in one block of a search and of a pair search.
QUERY_BLOCK, ROW_BLOCK, PAIR_BLOCK = 4096, 16384, 8192
#: Rows of a block that are compared with the other block at once, and how often a job of a pair search ships each row.
PAIR_STRIP, SHIPPED = 1024, 4
#: Digits of a cosine beyond which it depends on the order of its sum.
NOISE_DIGITS = 12


def cosine_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows (id, embedding, ...) most like ``query``, ties by id, with their cosine.

    Filter ``vectors`` first: the limit comes last.  k below 1 gives no rows.
    """
    scored = vectors.withColumn("cos", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    return scored.drop("embedding").orderBy(F.desc("cos"), "id").limit(max(k, 0))


def _unit(rows: pa.ChunkedArray | pd.Series) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    matrix = np.array(rows.to_pylist() if hasattr(rows, "to_pylist") else rows.to_list(), np.float64)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def _best(cos: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``cos`` (queries by rows) the columns of its k best, ties by id, and their cosines."""
    by_id = np.argsort(ids, kind="stable")
    cos = cos[:, by_id]
    order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    return by_id[order], np.take_along_axis(cos, order, axis=1)


def cosine_topk_batch(vectors: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, id, cos, rank: the k most similar rows for each query (query_id, embedding).

    Queries that fit one block are broadcast, and each task keeps a running k best for
    each of them.  More are dealt to blocks, as are the vectors, and each two
    blocks meet in one task as a matrix product; nothing passes through the driver.
    Ties in the k-th cosine go to the lower id.
    """
    asked = queries.select("query_id", "embedding")
    few = asked.limit(query_block + 1).collect()
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, cos double"
    rows = vectors.select("id", "embedding")
    if len(few) <= query_block:
        names = [r["query_id"] for r in few]
        shared = vectors.sparkSession.sparkContext.broadcast((names, _unit(pd.Series([r["embedding"] for r in few])) if few else None))

        def search(batches):
            names, wanted = shared.value
            ids, cos = None, None
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                new = batch.column("id").to_numpy(zero_copy_only=False)
                scores = wanted @ _unit(batch.column("embedding")).T
                at, scores = _best(scores, new, k)
                new = new[at]
                if ids is not None:
                    new, scores = np.concatenate([ids, new], axis=1), np.concatenate([cos, scores], axis=1)
                    order = np.stack([np.lexsort((i, -c))[:k] for i, c in zip(new, scores, strict=True)])
                    new, scores = np.take_along_axis(new, order, axis=1), np.take_along_axis(scores, order, axis=1)
                ids, cos = new, scores
            if ids is not None:
                out = pd.DataFrame({"query_id": np.repeat(np.array(names, dtype=object), ids.shape[1]), "id": ids.ravel(), "cos": cos.ravel()})
                yield pa.RecordBatch.from_pandas(out.infer_objects(), preserve_index=False)

        best = rows.mapInArrow(search, schema)
    else:
        sizes = asked.agg(F.count("*").alias("n")).join(rows.agg(F.count("*").alias("m"))).first()
        q_blocks, v_blocks = -(-sizes["n"] // query_block), max(-(-sizes["m"] // row_block), 1)
        deal = lambda df, key, own, own_n, other, other_n: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))))
        left = deal(asked, "query_id", "x", q_blocks, "y", v_blocks)
        right = deal(rows, "id", "y", v_blocks, "x", q_blocks)

        def meet(wanted: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(wanted) or not len(found):
                return pd.DataFrame({"query_id": wanted.query_id[:0], "id": found.id[:0], "cos": np.array([], np.float64)})
            ids = found.id.to_numpy()
            at, cos = _best(_unit(wanted.embedding) @ _unit(found.embedding).T, ids, k)
            return pd.DataFrame({"query_id": np.repeat(wanted.query_id.to_numpy(), at.shape[1]), "id": ids[at].ravel(), "cos": cos.ravel()})

        best = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = PAIR_BLOCK, least: bool = False) -> DataFrame:
    """a, b, kind, cos, same_scope for pairs of one kind with cosine above the threshold, a < b.

    ``vectors`` is (id, kind, scope, embedding).  Rows of a kind are dealt to blocks by
    hash and each two blocks meet in one task as a matrix product, so only true pairs
    become rows and no kind has to fit in a task.  With ``least`` a task gives only the
    pair of lowest a for each b.

    Blocks meet in rounds: in round r each meets the one r places on.  A job takes as many
    rounds as ship each row some ``SHIPPED`` times, its pairs are written and its shuffle
    files go, so that disk grows with the rows and not with their square.
    """
    spark = vectors.sparkSession
    counts = cut(vectors.groupBy("kind").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    few = F.broadcast(counts) if counts.count() <= 100_000 else counts
    schema = f"a {vectors.schema['id'].dataType.simpleString()}, b {vectors.schema['id'].dataType.simpleString()}, kind {vectors.schema['kind'].dataType.simpleString()}, cos double, same_scope boolean"
    names = ["a", "b", "kind", "cos", "same_scope"]

    def pairs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame([], columns=names)]
        if len(left) and len(right):
            other, ids, scopes = _unit(right.embedding).T, right.id.to_numpy(), right.scope.to_numpy()
            for at in range(0, len(left), PAIR_STRIP):
                strip = left.iloc[at : at + PAIR_STRIP]
                cos = _unit(strip.embedding) @ other
                i, j = np.nonzero(cos > threshold)
                a, b = strip.id.to_numpy()[i], ids[j]
                ordered = a < b
                some = ordered if key[2] == 0 else np.ones(len(a), bool)
                got = {"a": np.where(ordered, a, b)[some], "b": np.where(ordered, b, a)[some], "kind": key[0], "cos": cos[i, j][some], "same_scope": (strip.scope.to_numpy()[i] == scopes[j])[some]}
                if some.any():
                    found.append(pd.DataFrame(got))
                if least and len(found) > 1:
                    found = [found[0], pd.concat(found[1:]).sort_values("a", kind="stable").drop_duplicates("b")]
        return pd.concat(found[1:]) if len(found) > 1 else found[0]

    with shuffles_dropped(spark):
        dealt = vectors.join(few.select(F.col("kind").alias("_k"), "blocks"), F.col("kind").eqNullSafe(F.col("_k"))).drop("_k")
        dealt = cut(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
        rows = dict(counts.groupBy((F.col("blocks") / 2).cast("int")).agg(F.sum("_n")).collect())
        jobs, shipped = [], 0
        for r in range(max(rows, default=-1) + 1):
            more = sum(n for last, n in rows.items() if last >= r)
            if not jobs or shipped + 2 * more > SHIPPED * sum(rows.values()):
                jobs, shipped = [*jobs, [r, r]], 0
            jobs[-1][1], shipped = r, shipped + 2 * more
        out = spark.createDataFrame([], schema)
        for first, last in jobs:
            half = (F.col("blocks") / 2).cast("int")
            met = dealt.where(half >= first).withColumn("r", F.explode(F.sequence(F.lit(first), F.least(F.lit(last), half))))
            # half way round each two blocks would meet twice
            once = (F.col("r") == 0) | (F.col("r") * 2 != F.col("blocks")) | (F.col("x") < F.col("r"))
            left = met.withColumn("x", F.col("block")).where(once).select("kind", "x", "r", "id", "scope", "embedding")
            right = met.withColumn("x", F.pmod(F.col("block") - F.col("r"), F.col("blocks"))).where(once).select("kind", "x", "r", "id", "scope", "embedding")
            right = right.toDF(*right.columns)
            out = out.union(cut(left.groupBy("kind", "x", "r").cogroup(right.groupBy("kind", "x", "r")).applyInPandas(pairs, schema)))
    return out


def validated(vectors: DataFrame, dim: int) -> DataFrame:
    """Unit vectors; a blank id, a wrong width or a value that is not finite fails the job."""
    fine = is_valid(F.col("embedding"), dim) & F.col("id").isNotNull() & (F.trim(F.col("id").cast("string")) != "")
    checked = F.when(fine, l2_normalize(F.col("embedding"))).otherwise(F.raise_error(F.lit("invalid vector row")))
    return vectors.withColumn("embedding", checked)


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", seq: str | None = None) -> DataFrame:
    """``table`` with ``rows`` replacing those of the same key; the last of a repeated key (by ``seq``) wins.

    Without ``seq`` a repeated key fails the job: which row is the last is not known then.
    """
    if not seq:
        once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string")))).otherwise(F.first(F.struct(*rows.columns)))
        rows = rows.groupBy(key).agg(once.alias("r")).select("r.*").select(*table.columns)
    else:
        whole = F.struct(*rows.columns)
        rows = rows.groupBy(key).agg(F.max_by(whole, seq).alias("r")).select("r.*").select(*table.columns)
    return table.join(rows, key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``table`` without the rows whose key is in ``keys``."""
    return table.join(keys, key, "left_anti")


def above(score: Column, floor: float = 0.0) -> Column:
    """Only similarities above the floor count, by more than the noise of their sums; apply after the top-k cut."""
    return F.round(score, NOISE_DIGITS) > floor
