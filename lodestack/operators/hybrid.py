"""Hybrid retrieval: two scored lists, normalised, fused, folded to notes, expanded along links."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from . import filters as flt
from .graph import expand, via
from .lexical import bm25, bm25_stored, query_terms, top
from .vector import above, cosine_topk
from ..config import Retrieval
from ..functions.text import excerpt
from ..workspace import cut

HOP_DECAY, DEAD_PENALTY = 0.5, 0.5
#: What a hit shows of its note.
HIT_FIELDS = ("title", "scope", "type", "status", "agent", "profile", "confidence", "tags")


def pool_size(k: int) -> int:
    """Candidates of each half; scores are normalised over these, so k matters."""
    return max(5 * k, 40)


def min_max(scores: DataFrame, column: str, pooled: bool = False) -> DataFrame:
    """``column`` scaled to 0..1 over the list; all equal, or alone, is 1.

    The extremes are one broadcast row, for which ``scores`` is computed a second
    time.  A list that is ``pooled``, cut to a few rows, is scaled in one task instead.
    """
    lo, hi = F.min(column), F.max(column)
    if pooled:
        everything = Window.partitionBy(F.lit(0))
        ranged = scores.withColumns({"_lo": lo.over(everything), "_hi": hi.over(everything)})
    else:
        ranged = scores.join(F.broadcast(scores.agg(lo.alias("_lo"), hi.alias("_hi"))))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return ranged.withColumn(column, scaled).drop("_lo", "_hi")


def fuse(vector: DataFrame, lexical: DataFrame, weights: Retrieval = Retrieval()) -> DataFrame:
    """chunk_id, score, cos over the union of (chunk_id, cos) and (chunk_id, score); a missing half is 0.

    Both are pools of candidates, cut to ``pool_size`` before.
    """
    left = min_max(vector.select("chunk_id", "cos", F.col("cos").alias("v")), "v", pooled=True)
    right = min_max(lexical.select("chunk_id", F.col("score").alias("b")), "b", pooled=True)
    both = left.join(right, "chunk_id", "full_outer")
    score = F.coalesce("v", F.lit(0.0)) * weights.vector_weight + F.coalesce("b", F.lit(0.0)) * weights.bm25_weight
    return both.select("chunk_id", score.alias("score"), F.coalesce("cos", F.lit(0.0)).alias("cos"))


def fold_to_notes(chunks: DataFrame) -> DataFrame:
    """note_id, score, best_chunk, similarity from (note_id, chunk_id, ordinal, score, cos).

    The best chunk is that of the highest score, the first in a tie; similarity is
    the highest cosine, of whichever chunk.
    """
    return chunks.groupBy("note_id").agg(F.max("score").alias("score"), F.max_by("chunk_id", F.struct("score", -F.col("ordinal"))).alias("best_chunk"), F.max("cos").alias("similarity"))


def penalise(notes: DataFrame) -> DataFrame:
    """Archived and deprecated notes count half."""
    return notes.withColumn("score", F.when(flt.live(F.col("status")), F.col("score")).otherwise(F.col("score") * DEAD_PENALTY))


def spread(seeds: DataFrame, reached: DataFrame, direct: DataFrame, statuses: DataFrame) -> DataFrame:
    """note_id, score, hops, path for seeds and what links reach from them.

    A reached note scores its seed's score halved at every hop, or its direct score
    if that is higher.  Seeds stay seeds, and notes that are not live never come in.
    """
    new = reached.where("hops > 0").join(seeds.select(F.col("note_id").alias("seed"), F.col("score").alias("_s")), "seed")
    new = new.join(statuses.where(flt.live(F.col("status"))).select("note_id"), "note_id", "left_semi").join(seeds.select("note_id"), "note_id", "left_anti")
    new = new.join(direct.select("note_id", F.col("score").alias("_d")), "note_id", "left")
    score = F.greatest(F.col("_s") * F.pow(F.lit(HOP_DECAY), F.col("hops")), F.coalesce("_d", F.lit(0.0)))
    return seeds.select("note_id", "score", F.lit(0).alias("hops"), F.array("note_id").alias("path")).union(new.select("note_id", score.alias("score"), "hops", "path"))


def search(chunks: DataFrame, notes: DataFrame, edges: DataFrame, query: str, vector: list[float], k: int = 8, filters: Mapping[str, Any] | None = None, hops: int | None = None, settings: Retrieval = Retrieval(), index: str | None = None) -> DataFrame:
    """The k best notes for a query, with scores, how links led to them, fields and an excerpt.

    ``chunks`` is (chunk_id, note_id, ordinal, text, embedding), ``notes`` (note_id,
    type, scope, agent, profile, status, confidence, tags, title).  Filters reach
    both scans before their cuts.  Texts are joined to the k winners only.  A chunk
    without an embedding (null) is found by its words alone.  ``index`` is the path of
    a stored index of the chunks, which spares their texts being read and cut.
    """
    allowed = flt.apply(notes, filters).select("note_id")
    kept = chunks.join(allowed, "note_id", "left_semi")
    pool = pool_size(k)
    dense = cosine_topk(kept.where("embedding is not null").select(F.col("chunk_id").alias("id"), "embedding"), vector, pool).where(above(F.col("cos"))).withColumnRenamed("id", "chunk_id")
    if index is None:
        marked = chunks.select("chunk_id", "text", "note_id").join(allowed.withColumn("_ok", F.lit(True)), "note_id", "left")
        scores = bm25(marked, query, F.col("_ok"))
    else:
        scores = bm25_stored(chunks.sparkSession, index, query, kept)
    sparse = top(scores, pool)
    found = fuse(dense, sparse, settings).join(chunks.select("chunk_id", "note_id", "ordinal"), "chunk_id")
    # a pool of notes, used four times below, so written once
    direct = penalise(fold_to_notes(found).join(notes.select("note_id", "status"), "note_id"))
    direct = cut(direct)
    seeds = direct.orderBy(F.desc("score"), "note_id").limit(k)
    hops = settings.hops_default if hops is None else hops
    reached = expand(edges, seeds.select("note_id"), hops, settings.hops_max)
    # a note may be reached from several seeds; the best score counts
    all_hits = spread(seeds, reached, direct, notes.select("note_id", "status"))
    hits = all_hits.orderBy(F.desc("score"), "note_id").limit(k)
    hits = hits.join(direct.select("note_id", "best_chunk", "similarity"), "note_id", "left").join(notes.select("note_id", *HIT_FIELDS), "note_id")
    # the best chunk, or the opening one of a note that links led to
    choice = F.struct(F.coalesce(F.col("chunk_id") != F.col("best_chunk"), F.lit(True)), "ordinal", "chunk_id")
    texts = hits.select("note_id", "best_chunk").join(chunks.select("note_id", "chunk_id", "ordinal", "text"), "note_id").groupBy("note_id").agg(F.min_by("text", choice).alias("text"))
    shown = hits.join(texts, "note_id", "left").withColumn("excerpt", excerpt(F.col("text"), query_terms(query)))
    chain = F.when(F.col("hops") > 0, via(F.col("path"))).alias("via")
    link = F.concat(F.lit("[["), "note_id", F.lit("]]")).alias("wikilink")
    return shown.select("note_id", link, F.round("score", 6).alias("score"), F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"), "hops", "path", chain, *HIT_FIELDS, "excerpt").orderBy(F.desc("score"), "note_id")


def accesses(hits: DataFrame, at: dt.datetime) -> DataFrame:
    """ts, kind, ids: the access record of one search's hits, for ``logs.write_access``; no hits, no record."""
    ids = hits.agg(F.array_sort(F.collect_set("note_id")).alias("ids")).where(F.size("ids") > 0)
    return ids.select(F.lit(at.isoformat()).alias("ts"), F.lit("search").alias("kind"), "ids")
