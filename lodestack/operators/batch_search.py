"""Hybrid search for many queries at once, each with its own filters.

Every step is keyed by query_id: the candidates, both pools, their extremes, the fusion
and the fold to notes.  ``same`` names the note fields in which a hit must equal its
query (type and scope, say): both halves meet on these, so a query is compared with its
own part of the corpus only.  Further filters are a map in the query's row.

Vectors and texts meet in blocks: matrix products of the ones, sums over shared terms of
the others; a hot value of the ``same`` fields is dealt to as many blocks as its rows need,
and only pools leave a block.  Statistics are of the whole corpus.  Results are those of ``hybrid.search`` without hops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CONFIDENCE, Maintenance, Retrieval
from ..functions.text import TOKEN, fold
from . import filters as flt
from .hybrid import DEAD_PENALTY, pool_size
from .lexical import K1, B, bags, idf
from .vector import NOISE_DIGITS, _best, _unit
from ..workspace import cut

FILTERS = "map<string,array<string>>"
#: Queries and vectors of one block, and queries and texts.
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
TEXT_QUERIES, TEXT_ROWS = 1024, 8192
#: Note fields that filters look at.
FIELDS = (*flt.SCALARS, "tags")


def terms_of(text: Column) -> Column:
    """Search terms of free text: distinct but for case, then folded, so accent variants count each."""
    raw = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1)))
    return F.filter(F.transform(raw, fold), lambda t: t != "")


def passes(allowed: Column) -> Column:
    """Whether a note's ``FIELDS`` pass the filters of a query; without a status filter only live notes do."""
    of = lambda key: F.element_at(allowed, F.lit(key))
    rules = [F.coalesce(F.array_contains(of(key), F.col(key)), of(key).isNull()) & (of(key).isNull() | F.col(key).isNotNull()) for key in flt.SCALARS]
    rules.append(of("status").isNotNull() | flt.live(F.col("status")))
    rules.append(of("tags").isNull() | (F.size(F.array_except(of("tags"), F.coalesce("tags", F.array().cast("array<string>")))) == 0))
    level = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), c), F.lit(0))
    floor = F.get(of("min_confidence"), F.lit(0))
    rules.append(of("min_confidence").isNull() | ((level(F.col("confidence")) > 0) & (level(F.col("confidence")) >= level(floor))))
    out = rules[0]
    for rule in rules[1:]:
        out = out & rule
    return F.coalesce(out, F.lit(False))


def _mask(allowed: dict | None, notes: pd.DataFrame) -> np.ndarray:
    """``passes`` for one query's filters and a block of notes."""
    wanted = dict(allowed or {})
    ok = np.ones(len(notes), bool)
    for key in flt.SCALARS:
        if key in wanted:
            ok &= notes[key].isin(list(wanted[key])).to_numpy()
    if "status" not in wanted:
        ok &= ~notes["status"].isin(["arquivado", "deprecado"]).to_numpy()
    if "tags" in wanted:
        need = set(wanted["tags"])
        ok &= np.array([need <= set(() if t is None else t) for t in notes["tags"]], bool)
    if "min_confidence" in wanted:
        ok &= notes["confidence"].isin(CONFIDENCE[CONFIDENCE.index(wanted["min_confidence"][0]) :]).to_numpy()
    return ok


def _blocks(asked: DataFrame, held: DataFrame, same: Sequence[str], query_block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks dealt to blocks (``_x``, ``_y``) of their ``same`` values; a hot value has as many as its rows need."""
    keys = list(same)
    count = lambda df, name, size: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    many, rows = count(asked, "_nx", query_block), count(held, "_ny", row_block)
    sizes = cut(many.join(rows, keys) if keys else many.join(rows))
    deal = lambda df, key, own, own_n, other, other_n: (df.join(sizes, keys) if keys else df.join(F.broadcast(sizes))).withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("_nx", "_ny")
    left = deal(asked, "query_id", "_x", "_nx", "_y", "_ny")
    return left.toDF(*left.columns), deal(held, "chunk_id", "_y", "_ny", "_x", "_nx")  # queries may be rows of the corpus


def _masked(scores: np.ndarray, asked: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
    """``scores`` (queries by chunks), zero where a chunk does not pass a query's filters."""
    masks: dict[str, np.ndarray] = {}
    for i, allowed in enumerate(asked.filters):
        mark = repr(sorted((k, list(v)) for k, v in dict(allowed or {}).items()))
        if mark not in masks:
            masks[mark] = _mask(allowed, found)
        scores[i, ~masks[mark]] = 0.0
    return scores


def _pools(left: DataFrame, right: DataFrame, same: Sequence[str], pool: int, name: str, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> DataFrame:
    """query_id, chunk_id and the score ``name``: each query's ``pool`` best chunks over its blocks, those above zero."""
    schema = f"query_id {left.schema['query_id'].dataType.simpleString()}, chunk_id {right.schema['chunk_id'].dataType.simpleString()}, {name} double"

    def meet(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({"query_id": asked.query_id[:0], "chunk_id": found.chunk_id[:0], name: np.array([], np.float64)})
        ids = found.chunk_id.to_numpy()
        at, best = _best(_masked(score(asked, found), asked, found), ids, pool)
        out = pd.DataFrame({"query_id": np.repeat(asked.query_id.to_numpy(), at.shape[1]), "chunk_id": ids[at].ravel(), name: best.ravel()})
        return out[out[name].round(NOISE_DIGITS) > 0]

    best = left.groupBy(*same, "_x", "_y").cogroup(right.groupBy(*same, "_x", "_y")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(name), "chunk_id"))
    return best.withColumn("_r", rank).where(F.col("_r") <= pool).drop("_r")


def dense_pools(vectors: DataFrame, queries: DataFrame, pool: int, same: Sequence[str] = (), query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, chunk_id, cos: each query's ``pool`` most similar chunks that pass its filters, those above zero.

    ``vectors`` has chunk_id, embedding and the note's ``FIELDS``, ``queries`` query_id,
    embedding, filters and the ``same`` columns.  A null in a ``same`` column finds nothing.
    """
    asked = queries.where("embedding is not null").select("query_id", "embedding", "filters", *same)
    held = vectors.where("embedding is not null").select("chunk_id", "embedding", *dict.fromkeys((*FIELDS, *same)))
    left, right = _blocks(asked, held, same, query_block, row_block)
    # rounded, so that copies tie wherever in a block they lie
    return _pools(left, right, same, pool, "cos", lambda a, b: np.round(_unit(a.embedding) @ _unit(b.embedding).T, NOISE_DIGITS))


def _bm25(average: float) -> Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]:
    """Scores of all chunks of a block for all of its queries: term by term, weights of queries times weights of chunks."""

    def score(asked: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
        flat = lambda column, kind: np.concatenate([np.asarray(x, kind) for x in column]) if len(column) else np.zeros(0, kind)
        owners = lambda column: np.repeat(np.arange(len(column)), [len(x) for x in column])
        known, q_term = np.unique(flat(asked.terms, np.int64), return_inverse=True)
        q_weight, q_of = flat(asked.weights, np.float64), owners(asked.terms)
        terms, tf, c_of = flat(found.terms, np.int64), flat(found.tfs, np.float64), owners(found.terms)
        scores = np.zeros((len(asked), len(found)))
        if not len(known) or not len(terms):
            return scores
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        held = known[at] == terms
        at, tf, c_of = at[held], tf[held], c_of[held]
        length = found.length.to_numpy(np.float64)[c_of]
        c_weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
        by_q, by_c = np.argsort(q_term, kind="stable"), np.argsort(at, kind="stable")
        q_edges = np.searchsorted(q_term[by_q], np.arange(len(known) + 1))
        c_edges = np.searchsorted(at[by_c], np.arange(len(known) + 1))
        for t in np.flatnonzero(np.diff(c_edges)).tolist():
            q, c = by_q[q_edges[t] : q_edges[t + 1]], by_c[c_edges[t] : c_edges[t + 1]]
            scores[np.ix_(q_of[q], c_of[c])] += np.outer(q_weight[q], c_weight[c])
        return scores

    return score


def sparse_pools(held: DataFrame, queries: DataFrame, df: DataFrame, pool: int, n: int, words: int, same: Sequence[str] = (), query_block: int = TEXT_QUERIES, row_block: int = TEXT_ROWS) -> DataFrame:
    """query_id, chunk_id, score: each query's ``pool`` best chunks by BM25 that pass its filters.

    ``held`` is the ``bags`` (chunk_id, length, terms, tfs) of ``n`` chunks with ``words``
    tokens in all, beside their note's ``FIELDS``; ``df`` (t, _df) says how many chunks
    hold each term.  Terms meet as 64-bit hashes, block by block; a chunk is shuffled as
    one row and its scores never are, but for the pools.
    """
    keys = list(same)
    each = queries.select("query_id", F.explode(terms_of(F.col("text"))).alias("term")).select("query_id", F.xxhash64("term").alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("times"))
    weighed = each.join(df, "t").select("query_id", F.struct("t", (idf(F.lit(float(n)), F.col("_df")) * F.col("times")).alias("w")).alias("p"))
    own = weighed.groupBy("query_id").agg(F.collect_list("p").alias("p")).select("query_id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))
    asked = cut(queries.select("query_id", "filters", *keys).join(own, "query_id"))
    left, right = _blocks(asked, held, same, query_block, row_block)
    return _pools(left, right, same, pool, "score", _bm25(words / n if n and words else 1.0))


def fuse_pools(dense: DataFrame, sparse: DataFrame, weights: Retrieval = Retrieval()) -> DataFrame:
    """query_id, chunk_id, score, cos: both pools scaled to 0..1 within each query, weighted and united."""
    mine = Window.partitionBy("query_id")

    def scaled(df: DataFrame, column: str, name: str) -> DataFrame:
        lo, hi, x = F.min(column).over(mine), F.max(column).over(mine), F.col(column)
        return df.withColumn(name, F.when(hi == lo, 1.0).otherwise((x - lo) / (hi - lo)))

    left, right = scaled(dense, "cos", "_v"), scaled(sparse, "score", "_b").drop("score")
    both = left.join(right, ["query_id", "chunk_id"], "full_outer")
    zero = F.lit(0.0)
    score = F.coalesce("_v", zero) * weights.vector_weight + F.coalesce("_b", zero) * weights.bm25_weight
    return both.select("query_id", "chunk_id", score.alias("score"), F.coalesce("cos", zero).alias("cos"))


def search_many(chunks: DataFrame, notes: DataFrame, queries: DataFrame, k: int = 8, same: Sequence[str] = (), settings: Retrieval = Retrieval(), index: tuple[DataFrame, int, int] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, note_id, score, similarity, best_chunk, rank: the k best notes of every query.

    ``chunks`` is (chunk_id, note_id, ordinal, text, embedding), ``notes`` (note_id and the
    ``FIELDS``), ``queries`` (query_id, text, embedding, the ``same`` columns and perhaps
    ``filters``, a map of what ``filters.apply`` takes).  ``index`` gives stored postings
    with their number of chunks and of tokens, and spares the texts.  ``vectors`` (chunk_id,
    embedding) may be a table of their own, so that texts are not joined to get them.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if "filters" not in queries.columns:
        queries = queries.withColumn("filters", F.lit(None).cast(FILTERS))
    held = chunks.select("chunk_id", "note_id", "embedding") if vectors is None else chunks.select("chunk_id", "note_id").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    fields = notes.select("note_id", *dict.fromkeys((*FIELDS, *same)))
    pool = pool_size(k)
    dense = dense_pools(held.join(fields, "note_id"), queries, pool, same)
    if index is None:
        # texts are cut into tokens once
        texts = cut(bags(chunks, ["chunk_id", "note_id"]))
        df = texts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("_df"))
        n, words = texts.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    else:
        rows, n, words = index
        df = rows.groupBy(F.xxhash64("term").alias("t")).agg(F.count("*").alias("_df"))
        texts = rows.groupBy("chunk_id", "length").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "tf")).alias("p"))
        texts = texts.select("chunk_id", "length", F.col("p.t").alias("terms"), F.col("p.tf").alias("tfs")).join(chunks.select("chunk_id", "note_id"), "chunk_id")
    sparse = sparse_pools(texts.join(fields, "note_id").drop("note_id"), queries, df, pool, n, words, same)
    found = fuse_pools(dense, sparse, settings).join(chunks.select("chunk_id", "note_id", "ordinal"), "chunk_id")
    folded = found.groupBy("query_id", "note_id").agg(F.max("score").alias("score"), F.max_by("chunk_id", F.struct("score", -F.col("ordinal"))).alias("best_chunk"), F.max("cos").alias("similarity"))
    live = notes.select("note_id", flt.live(F.col("status")).alias("_live"))
    scored = folded.join(live, "note_id").withColumn("score", F.when(F.col("_live"), F.col("score")).otherwise(F.col("score") * DEAD_PENALTY)).drop("_live")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "note_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def near_notes(candidates: DataFrame, chunks: DataFrame, notes: DataFrame, threshold: float = Maintenance().dedup_similarity, k: int = 5, settings: Retrieval = Retrieval(), index: tuple[DataFrame, int, int] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(note_id, similar) for the gate: of a candidate's k best hits in its type and scope, those more alike than the threshold.

    ``candidates`` has note_id, type, scope, text (``dedup_query``) and its embedding; a
    note is not its own copy.  Unlike ``gate.near_copies`` this sees k hits only, as a
    write does.
    """
    asked = candidates.select(F.col("note_id").alias("query_id"), "type", "scope", "text", "embedding")
    hits = search_many(chunks, notes, asked, k, ("type", "scope"), settings, index, vectors)
    near = hits.where((F.col("similarity") > threshold) & (F.col("note_id") != F.col("query_id")))
    return near.groupBy(F.col("query_id").alias("note_id")).agg(F.array_sort(F.collect_set("note_id")).alias("similar"))


#: Characters of a candidate that the gate searches for.
DEDUP_CHARS = 2000


def dedup_query(title: Column, body: Column) -> Column:
    """Title and body as the text that near copies are looked for with."""
    whole = F.concat(F.coalesce(F.trim(title), F.lit("")), F.lit("\n\n"), F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""))
    return F.substring(F.regexp_replace(whole, r"^\s+|\s+$", ""), 1, DEDUP_CHARS)
