"""Registered queries: each operator on the star-schema tables, with the DuckDB SQL it must equal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import Maintenance
from ..functions import dates as dx, text as tx, vectors as vx
from ..operators import boards, chunk, embed, filters, gate, graph, hybrid, index, lexical, maintain, vector, write
from ..sources.notes import file_names
from ..workspace import cut
from . import tables as tb, upkeep  # noqa: F401  (registers its queries)
from .consolidate import consolidate
from .registry import ORACLES, QUERIES, TODAY, TODAY_SQL as _TODAY, query  # noqa: F401

TEXT = "the that with für"
TERMS = lexical.query_terms(TEXT)
K = 10


# ------------------------------------------------------------------- lexical


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def _bm25_sql(terms: list[str], where: str = "true", name: str = "score") -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    parts = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)), 1e-6) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg)) ELSE 0 END" for i in range(len(terms)))
    any_ = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    return f"{tb.SQL['tok']}, counted AS (SELECT doc_id, len(t) AS len, {tf} FROM tok), stats AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM counted), bm AS (SELECT doc_id AS chunk_id, {parts} AS {name} FROM counted, stats WHERE ({any_}) AND doc_id IN (SELECT doc_id FROM documents WHERE {where}))"


@query(f"WITH {_bm25_sql(TERMS)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT {K}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top(lexical.bm25(_docs(spark, sf), TEXT), K).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql(TERMS)} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf), TEXT).withColumn("score", F.round("score", 6))


_KEEP = "lang = 'en' AND source IN ('src1', 'src2', 'src3')"


@query(f"WITH {_bm25_sql(TERMS, _KEEP)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT {K}")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.top(lexical.bm25(_docs(spark, sf), TEXT, F.expr(_KEEP)), K).withColumn("score", F.round("score", 6))


_FOLD = lexical.query_terms("für fur élé")


@query(f"WITH {_bm25_sql(_FOLD)} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_accent_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Accent variants of a query word count twice."""
    return lexical.bm25(_docs(spark, sf), "für fur élé").withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql(TERMS)} SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT {K}")
def bm25_stored_topk(spark: SparkSession, sf: str) -> DataFrame:
    """bm25_topk from a stored index, which is made once for each session."""
    return lexical.top(lexical.bm25_stored(spark, tb.lexical_index(spark, sf), TEXT), K).withColumn("score", F.round("score", 6))


@query(f"WITH {_bm25_sql(TERMS, _KEEP)} SELECT chunk_id, round(score, 6) AS score FROM bm")
def bm25_stored_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from a stored index, of some sources in one language."""
    return lexical.bm25_stored(spark, tb.lexical_index(spark, sf), TEXT, _docs(spark, sf).where(_KEEP)).withColumn("score", F.round("score", 6))


_BATCH = """, p AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM tok), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, term, count(*) AS times FROM (SELECT doc_id, unnest(t) AS term FROM tok WHERE doc_id % 100 = 0) GROUP BY ALL),
s AS (SELECT query_id, tf.doc_id AS chunk_id, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 5"""


@query(tb.views("tok") + _BATCH)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document's whole text as a query against all documents."""
    # texts are cut into tokens once
    held = cut(lexical.bags(_docs(spark, sf), ["chunk_id"]))
    asked = held.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "terms", F.col("tfs").alias("times"))
    n, words = held.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    found = lexical.bm25_bags(held, asked, n, words, 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(tb.views("tok") + _BATCH)
def bm25_batch_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``bm25_batch`` under its earlier name."""
    return bm25_batch(spark, sf)


# -------------------------------------------------------------------- vectors

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", vx.doubles(F.col("embedding")).alias("embedding"))


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return _vectors(spark, sf).where("id = 7").first()["embedding"]


@query(f"SELECT b.vec_id AS id, b.label, round({_COS}, 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY {_COS} DESC, id LIMIT {K}")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector.cosine_topk(_vectors(spark, sf), _query_vector(spark, sf), K).withColumn("cos", F.round("cos", 6))


@query(f"SELECT b.vec_id AS id, b.label, round({_COS}, 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.label IN (1, 2) ORDER BY {_COS} DESC, id LIMIT {K}")
def cosine_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return vector.cosine_topk(_vectors(spark, sf).where(F.col("label").isin(1, 2)), _query_vector(spark, sf), K).withColumn("cos", F.round("cos", 6))


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT query_id, id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM s QUALIFY rank <= {K}")
def cosine_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector against all."""
    v = _vectors(spark, sf)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vector.cosine_topk_batch(v, asked, K).withColumn("cos", F.round("cos", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, a.label AS kind, round({_COS}, 6) AS cos, a.vec_id % 5 = b.vec_id % 5 AS same_scope FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).select("id", F.col("label").alias("kind"), (F.col("id") % 5).alias("scope"), "embedding")
    return vector.similar_pairs(v, 0.3).withColumn("cos", F.round("cos", 6))


@query("SELECT vec_id AS id, [round(x / sqrt(list_dot_product(e, e)), 6) for x in e] AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("id", vx.rounded(vx.l2_normalize(F.col("embedding")), 6).alias("unit"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 3 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 4")
def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth row replaced, another tenth deleted."""
    v = _vectors(spark, sf).select("id", "label")
    fresh = v.where("id % 10 = 3").withColumn("label", F.col("label") + 100)
    return vector.delete(vector.upsert(v, fresh), v.where("id % 10 = 4").select("id"))


# --------------------------------------------------------------------- hybrid


def _halves(spark: SparkSession, sf: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    pool = hybrid.pool_size(K)
    scores = lexical.bm25_stored(spark, tb.lexical_index(spark, sf), TEXT) if stored else lexical.bm25(_docs(spark, sf), TEXT)
    dense = vector.cosine_topk(_vectors(spark, sf).select("id", "embedding"), _query_vector(spark, sf), pool).where(vector.above(F.col("cos")))
    return dense.withColumnRenamed("id", "chunk_id"), lexical.top(scores, pool)


_HALVES = f"""WITH {_bm25_sql(TERMS)}, sparse AS (SELECT chunk_id, score FROM bm ORDER BY score DESC, chunk_id LIMIT 50),
cosines AS (SELECT b.vec_id AS chunk_id, {_COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 7 ORDER BY cos DESC, chunk_id LIMIT 50),
dense AS (SELECT * FROM cosines WHERE cos > 0),
v AS (SELECT chunk_id, cos, CASE WHEN max(cos) OVER () = min(cos) OVER () THEN 1 ELSE (cos - min(cos) OVER ()) / (max(cos) OVER () - min(cos) OVER ()) END AS v FROM dense),
b AS (SELECT chunk_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS b FROM sparse),
fused AS (SELECT coalesce(v.chunk_id, b.chunk_id) AS chunk_id, coalesce(v, 0) * 0.6::DOUBLE + coalesce(b, 0) * 0.4::DOUBLE AS score, coalesce(cos, 0) AS cos FROM v FULL JOIN b ON v.chunk_id = b.chunk_id)"""


@query(f"{_HALVES} SELECT chunk_id, round(score, 6) AS score, round(cos, 6) AS cos FROM fused")
def minmax_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid.fuse(*_halves(spark, sf)).withColumns({"score": F.round("score", 6), "cos": F.round("cos", 6)})


@query(f"{_HALVES} SELECT chunk_id // 10 AS note_id, round(max(score), 6) AS score, arg_max(chunk_id, (score, -chunk_id)) AS best_chunk, round(max(cos), 6) AS similarity FROM fused GROUP BY 1")
def hybrid_fold_max_by(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbouring documents as the chunks of a note."""
    rows = hybrid.fuse(*_halves(spark, sf)).withColumn("note_id", F.expr("chunk_id div 10")).withColumn("ordinal", F.col("chunk_id"))
    return hybrid.fold_to_notes(rows).withColumns({"score": F.round("score", 6), "similarity": F.round("similarity", 6)})


_NOTES = tb.SQL["notes"]


_SEARCH = f"{_HALVES}, {_NOTES} SELECT note_id, round(CASE WHEN status = 'ativo' THEN score ELSE score / 2 END, 6) AS score, status FROM fused JOIN notes ON doc_id = chunk_id ORDER BY CASE WHEN status = 'ativo' THEN score ELSE score / 2 END DESC, note_id LIMIT {K}"


def _searched(spark: SparkSession, sf: str, stored: bool) -> DataFrame:
    notes = tb.notes(spark, sf).select("doc_id", "note_id", "status")
    found = hybrid.fuse(*_halves(spark, sf, stored)).join(notes, F.col("chunk_id") == F.col("doc_id"))
    return hybrid.penalise(found).orderBy(F.desc("score"), "note_id").limit(K).select("note_id", F.round("score", 6).alias("score"), "status")


@query(_SEARCH)
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: documents as one-chunk notes, both halves fused, penalised and cut."""
    return _searched(spark, sf, False)


@query(_SEARCH)
def hybrid_search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship over a stored index, which is made once for each session."""
    return _searched(spark, sf, True)


@query()
def hybrid_search_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search over all documents, those without a vector too, with filters and one hop along the citations."""
    notes = tb.notes(spark, sf)
    v = _vectors(spark, sf).select(F.col("id").alias("doc_id"), "embedding")
    chunks = notes.join(v, "doc_id", "left").select(F.concat("note_id", F.lit("#0")).alias("chunk_id"), "note_id", F.lit(0).alias("ordinal"), F.col("body").alias("text"), "embedding")
    return hybrid.search(chunks, notes, tb.citations(spark, sf), TEXT, _query_vector(spark, sf), K, {"min_confidence": "medium"})


# -------------------------------------------------------------------- filters


@query(f"WITH {_NOTES} SELECT note_id FROM notes WHERE list_has_all(tags, ['en', 'src1']) AND status = 'ativo'")
def tags_conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply(tb.notes(spark, sf), {"tags": ["en", "src1"]}).select("note_id")


@query(f"WITH {_NOTES} SELECT note_id, confidence FROM notes WHERE confidence IN ('medium', 'high') AND status = 'ativo'")
def confidence_floor(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply(tb.notes(spark, sf), {"min_confidence": "medium"}).select("note_id", "confidence")


@query(f"WITH {_NOTES} SELECT note_id, status FROM notes WHERE scope IN ('src1', 'src2') AND type = 'semantic' AND status IN ('arquivado', 'ativo')")
def scalar_filters(spark: SparkSession, sf: str) -> DataFrame:
    return filters.apply(tb.notes(spark, sf), {"scope": ["src1", "src2"], "type": "semantic", "status": ["arquivado", "ativo"]}).select("note_id", "status")


@query(f"WITH {_NOTES} SELECT note_id FROM notes WHERE list_has_any(tags, ['de', 'src1']) AND scope IN ('src1', 'src2')")
def metadata_any(spark: SparkSession, sf: str) -> DataFrame:
    """Filters on any column, lists by any of their values."""
    return filters.metadata(tb.notes(spark, sf), {"tags": ["de", "src1"], "scope": ["src1", "src2"], "profile": None}).select("note_id")


@query("""WITH n AS (SELECT 'd' || doc_id AS note_id, CASE WHEN doc_id % 10 = 0 THEN source || '-2' ELSE source END AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY note_id) AS r FROM n)
SELECT note_id, name || CASE WHEN r = 1 THEN '' WHEN ends_with(name, '-2') OR name || '-2' NOT IN (SELECT name FROM n) THEN '-' || r ELSE '-' || (r + 1) END || '.md' AS file FROM r""")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as wanted names, of which some are numbered already."""
    name = F.when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("-2"))).otherwise(F.col("source"))
    return file_names(tb.notes(spark, sf).join(tb.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("note_id", name.alias("name"))).select("note_id", "file")


_KINDS = "['Episodic', 'Semantic', 'Procedural', 'Research']"


@query(f"""WITH n AS (SELECT doc_id, {_KINDS}[doc_id % 4 + 1] AS outer_, {_KINDS}[doc_id // 4 % 4 + 1] AS inner_, CASE WHEN doc_id % 5 = 0 THEN 'procedural' END AS tag FROM documents)
SELECT doc_id, coalesce(tag, lower(inner_)) AS tag_first, lower({_KINDS}[least(doc_id % 4, doc_id // 4 % 4) + 1]) AS folder_first, lower(outer_) AS folder_only, tag AS lower_case FROM n""")
def type_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Types by folder and tag under each rule."""
    d, kinds = F.col("doc_id"), F.array(*map(F.lit, ("Episodic", "Semantic", "Procedural", "Research")))
    outer, inner = F.get(kinds, (d % 4).cast("int")), F.get(kinds, (F.floor(d / 4) % 4).cast("int"))
    tags = F.when(d % 5 == 0, F.array(F.lit("mem/procedural"), "lang")).otherwise(F.array("lang"))
    kind = lambda folders, rule: maintain.type_of(folders, tags, rule, "vault")
    whole = F.array(F.lit("vault"), outer, "source", inner, "lang")
    return tb.table(spark, sf, "documents").select("doc_id", *[kind(whole, r).alias(r) for r in ("tag_first", "folder_first", "folder_only")], kind(F.array(F.lower(outer), F.lower(inner)), "tag_first").alias("lower_case"))


@query(f"WITH {_NOTES} SELECT note_id, round(CASE WHEN status = 'ativo' THEN doc_id::DOUBLE ELSE doc_id / 2.0 END, 6) AS score FROM notes")
def status_penalty(spark: SparkSession, sf: str) -> DataFrame:
    rows = tb.notes(spark, sf).select("note_id", "status", F.col("doc_id").cast("double").alias("score"))
    return hybrid.penalise(rows).select("note_id", F.round("score", 6).alias("score"))


@query(f"WITH {_NOTES} SELECT note_id, title FROM notes WHERE type = 'semantic' AND contains(lower(concat_ws(' ', title, note_id, agent, scope)), 'the')")
def browser_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.browse(tb.notes(spark, sf), "the", type="semantic").select("note_id", "title")


# ----------------------------------------------------------------- text, chunks

_EXC = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, {_EXC} AS t FROM documents), p AS (SELECT *, least(nullif(instr(lower(t), 'with'), 0), nullif(instr(lower(t), 'ing'), 0)) - 1 AS pos FROM f)
SELECT doc_id, CASE WHEN pos IS NULL THEN substr(t, 1, 240) || CASE WHEN length(t) > 240 THEN '…' ELSE '' END
ELSE CASE WHEN greatest(pos - 80, 0) > 0 THEN '…' ELSE '' END || substr(t, greatest(pos - 80, 0)::INT + 1, 240) || CASE WHEN greatest(pos - 80, 0) + 240 < length(t) THEN '…' ELSE '' END END AS excerpt FROM p""")
def excerpt_window(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", tx.excerpt(F.col("text"), ["with", "ing"]).alias("excerpt"))


@query(f"WITH {_NOTES} SELECT note_id, concat_ws(' | ', 'scope: ' || nullif(trim(scope), ''), 'title: ' || nullif(trim(title), ''), 'tags: ' || array_to_string(tags, ', ')) AS prefix FROM notes")
def context_prefix(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf)
    return n.select("note_id", tx.context_prefix(F.col("scope"), F.col("title"), F.col("tags"), F.array().cast("array<string>")).alias("prefix"))


@query(r"SELECT doc_id, len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"))


_SLUG = "SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'nota') AS slug FROM documents"


@query(_SLUG)
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query(_SLUG)
def slugs_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``slugs`` under its earlier name."""
    return slugs(spark, sf)


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.table(spark, sf, "documents")
    return d.groupBy(index.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "documents").select("doc_id", index.content_hash(F.col("text")).alias("hash"))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_notes(tb.titled(tb.bodies(spark, sf, busy=True)))


@query()
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return embed.hash_embed(tb.spread(tb.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")))


# ----------------------------------------------------------------------- graph


@query(f"{tb.views('edges', 'steps')} SELECT here, there, relation, origin FROM steps")
def edges_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.undirected(tb.edges(spark, sf))


@query(f"{tb.views('edges', 'steps')} SELECT here AS note_id, list_sort(list_distinct(list(there))) AS neighbours FROM steps GROUP BY 1")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(tb.edges(spark, sf))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return tb.table(spark, sf, "part").where("p_partkey in (1, 2, 3)").select(F.concat(F.lit("p"), "p_partkey").alias("note_id"))


_H0 = "h0 AS (SELECT 'p' || p_partkey AS note_id, 0 AS hops, ['p' || p_partkey] AS path FROM part WHERE p_partkey IN (1, 2, 3))"
_H1 = "h1 AS (SELECT there AS note_id, 1 AS hops, min(list_append(path, there)) AS path FROM h0 JOIN steps ON here = note_id WHERE there NOT IN (SELECT note_id FROM h0) GROUP BY 1)"
_H2 = "h2 AS (SELECT there AS note_id, 2 AS hops, min(list_append(path, there)) AS path FROM h1 JOIN steps ON here = note_id WHERE there NOT IN (SELECT note_id FROM h0) AND there NOT IN (SELECT note_id FROM h1) GROUP BY 1)"


@query(f"{tb.views('edges', 'steps')}, {_H0}, {_H1} SELECT note_id, path[1] AS seed, hops, array_to_string(path, '>') AS path FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1)")
def expand_1hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand(tb.edges(spark, sf), _seeds(spark, sf), 1).drop("relations").withColumn("path", F.array_join("path", ">"))


@query(f"{tb.views('edges', 'steps')}, {_H0}, {_H1}, {_H2} SELECT note_id, path[1] AS seed, hops, array_to_string(path, '>') AS path FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)")
def expand_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand(tb.edges(spark, sf), _seeds(spark, sf), 2).drop("relations").withColumn("path", F.array_join("path", ">"))


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.winners(tb.opening_words(spark, sf))


@query(f"{tb.views('words')} SELECT note_id, min(path) AS path, count(*) > 1 AS ambiguous FROM words GROUP BY 1")
def ambiguous_winner(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(spark, sf).select("note_id", "path", "ambiguous")


_RESOLVED = tb.views("links", "words", "ids", "resolved")


@query(f"{_RESOLVED} SELECT source, raw, target FROM resolved")
def resolve_case_insensitive(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolve(tb.page_links(spark, sf), _ids(spark, sf)).select("source", "raw", "target")


@query(f"{_RESOLVED} SELECT raw AS target, count(*) AS refs FROM resolved WHERE target IS NULL GROUP BY 1")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ghosts(graph.split_links(graph.resolve(tb.page_links(spark, sf), _ids(spark, sf)))[1])


@query(f"{_RESOLVED} SELECT (SELECT count(*) FROM ids) AS nodes, (SELECT count(*) FROM ids WHERE ambiguous) AS ambiguous, (SELECT count(*) FROM resolved WHERE target IS NULL) AS broken, (SELECT count(*) FROM resolved WHERE target = source) AS self_links, (SELECT count(*) FROM (SELECT DISTINCT source, target FROM resolved WHERE target IS NOT NULL AND target <> source)) AS edges")
def graph_health(spark: SparkSession, sf: str) -> DataFrame:
    ids = _ids(spark, sf)
    made, dropped = graph.split_links(graph.resolve(tb.page_links(spark, sf), ids))
    return graph.health(ids, made, dropped)


@query(f"{tb.views('edges', 'steps')}, g AS (SELECT substr(here, 1, 1) AS type, here AS note_id, count(*) AS degree FROM steps GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY type ORDER BY degree DESC, note_id) <= 5")
def graph_hubs(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.edges(spark, sf)
    kinds = graph.undirected(e).select(F.col("here").alias("note_id")).distinct().withColumn("type", F.substring("note_id", 1, 1))
    return graph.hubs(e, kinds)


# ----------------------------------------------------------------- maintenance


@query(f"WITH {tb.SQL['seen']} SELECT note_id, seen FROM seen", dates=("seen",))
def access_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.last_seen(tb.access(spark, sf))


@query(f"{tb.views('notes', 'seen')} SELECT note_id, seen AS last_accessed, seen IS NOT NULL AS stamped FROM notes LEFT JOIN seen USING (note_id)", dates=("last_accessed",))
def access_stamp(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.stamp(tb.notes(spark, sf), maintain.last_seen(tb.access(spark, sf))).select("note_id", "last_accessed", "stamped")


_DEP = "dep AS (SELECT target AS note_id, list_sort(list_distinct(list(source))) AS successors FROM citations WHERE target IN (SELECT note_id FROM notes WHERE type = 'procedural' AND status = 'ativo') GROUP BY 1)"


@query(f"{tb.views('notes', 'citations')}, {_DEP} SELECT note_id, successors FROM dep")
def deprecated_sources(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.deprecations(tb.citations(spark, sf), tb.notes(spark, sf))


_DECAY = f"gone AS (SELECT note_id, type, scope, coalesce(modified, created) AS last_reference FROM notes WHERE status = 'ativo' AND {_TODAY} - coalesce(modified, created) > 90 AND note_id NOT IN (SELECT note_id FROM dep))"


@query(f"{tb.views('notes', 'citations')}, {_DEP}, {_DECAY} SELECT * FROM gone", dates=("last_reference",))
def decay(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf)
    return maintain.decayed(n, TODAY, 90, maintain.deprecations(tb.citations(spark, sf), n).select("note_id"))


@query(f"WITH {_NOTES} SELECT note_id, scope, last_tested, {_TODAY} - coalesce(last_tested, created) AS days_stale FROM notes WHERE type = 'procedural' AND status = 'ativo' AND {_TODAY} - coalesce(last_tested, created) > 180", dates=("last_tested",))
def stale_items(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.stale(tb.notes(spark, sf), TODAY, 180)


@query(f"{tb.views('notes', 'citations')} SELECT DISTINCT source AS doc, target AS cited, status AS state, NULL::VARCHAR AS successor FROM citations JOIN notes ON note_id = target WHERE status <> 'ativo'")
def dead_citations(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf)
    return maintain.dead_citations(tb.citations(spark, sf), n, maintain.dead_notes(n))


@query(f"{tb.views('notes', 'citations')} SELECT target AS note_id, CASE WHEN type IS NULL THEN 'missing' WHEN type = 'episodic' THEN 'keep' ELSE 'archive' END AS action FROM citations LEFT JOIN notes ON note_id = target")
def supersede_plan(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.supersede_plan(tb.citations(spark, sf).select(F.col("target").alias("note_id")), tb.notes(spark, sf))


@query("""WITH s AS (SELECT doc_id, doc_id % 3 AS mtime, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT doc_id, doc_id % 3 + (doc_id % 2) AS mtime, sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 <> 0)
SELECT 'd' || coalesce(s.doc_id, c.doc_id) AS path, CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN s.doc_id IS NULL THEN 'new' WHEN s.mtime = c.mtime THEN 'unchanged' WHEN s.hash = c.hash THEN 'touched' ELSE 'changed' END AS action FROM s FULL JOIN c ON s.doc_id = c.doc_id""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two states of the documents, with some removed, added, touched and changed."""
    d = tb.table(spark, sf, "documents")
    path, i = F.concat(F.lit("d"), "doc_id").alias("path"), F.col("doc_id")
    state = d.where(i % 5 != 0).select(path, (i % 3).alias("mtime"), index.content_hash(F.col("text")).alias("hash"))
    new = F.concat("text", F.when(i % 7 == 0, "!").otherwise(""))
    now = d.where(i % 11 != 0).select(path, (i % 3 + i % 2).alias("mtime"), index.content_hash(new).alias("hash"))
    return index.snapshot_diff(state, now)


@query()
def consolidate_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf)
    v = _vectors(spark, sf).select("id", F.col("label").alias("kind"), (F.col("id") % 5).alias("scope"), "embedding")
    return consolidate(n, tb.access(spark, sf), tb.citations(spark, sf), v, n, TODAY, Maintenance(), dry_run=True).report()


@query()
def consolidate_real_run(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf)
    v = _vectors(spark, sf).select("id", F.col("label").alias("kind"), (F.col("id") % 5).alias("scope"), "embedding")
    return consolidate(n, tb.access(spark, sf), tb.citations(spark, sf), v, n, TODAY).notes.groupBy("type", "status").agg(F.count("*").alias("notes"))


# ----------------------------------------------------------------- gate and lint

_RULES = """SELECT note_id, unnest(list_filter([
  CASE WHEN type = 'research' THEN 'type_disabled' END, CASE WHEN scope NOT IN (SELECT 'src' || i FROM range(18) r(i)) THEN 'scope_unknown' END,
  CASE WHEN agent = 'a9' THEN 'agent_unknown' END, CASE WHEN profile = 'writer' AND agent <> 'a9' AND doc_id % 2 = 1 THEN 'profile_unknown' END,
  CASE WHEN scope = 'src3' THEN 'denylist_tags' END, CASE WHEN type = 'procedural' THEN 'evidence_missing' END,
  CASE WHEN type IN ('semantic', 'procedural') THEN 'reusable' END, CASE WHEN type IN ('semantic', 'procedural') AND length(body) > 4000 THEN 'atomic' END,
  CASE WHEN type IN ('semantic', 'procedural') AND confidence = 'high' THEN 'confidence_unverified' END], lambda x: x IS NOT NULL)) AS "check" FROM notes"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _proposed(tb.notes(spark, sf))


def _proposed(notes: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return notes.withColumns({"source": F.lit("import"), "keys": none, "supersedes": none, "evidence": none, "merge": F.lit(False)})


@query(f"WITH {_NOTES} {_RULES}")
def gate_rules(spark: SparkSession, sf: str) -> DataFrame:
    return gate.long_form(gate.evaluate(_candidates(spark, sf), tb.MANIFEST)).select("note_id", "check")


@query(f"WITH {_NOTES}, r AS ({_RULES}) SELECT \"check\", count(*) AS notes FROM r GROUP BY 1")
def gate_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gate.totals(gate.evaluate(_candidates(spark, sf), tb.MANIFEST)).select("check", "notes")


@query(f"""WITH {_NOTES}, r AS (SELECT note_id, unnest(list_filter([CASE WHEN scope IN ('src18', 'src19') THEN 'scope_unknown' END, CASE WHEN agent = 'a9' THEN 'agent_unknown' END,
  CASE WHEN profile = 'writer' AND agent <> 'a9' AND doc_id % 2 = 1 THEN 'profile_unknown' END, CASE WHEN scope = 'src3' THEN 'denylist_tags' END, CASE WHEN type = 'episodic' THEN 'episodic_agent_mismatch' END], lambda x: x IS NOT NULL)) AS "check" FROM notes) SELECT "check", count(*) AS notes FROM r GROUP BY 1""")
def lint_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf).withColumns({"keys": F.array().cast("array<string>"), "malformed": F.lit(False)})
    return gate.totals(gate.lint(n, tb.MANIFEST)).select("check", "notes")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates in order of doc_id, each compared with those before it."""
    d = F.col("doc_id")
    texts = tb.bodies(spark, sf).select(F.concat(F.lit("d"), d).alias("note_id"), d.alias("seq"), tb.type_of_language().alias("type"), F.col("source").alias("scope"), F.col("text").alias("body"))
    brief = tb.brief_notes(spark, sf, broad=gate.too_broad(F.coalesce("text", F.lit(""))))
    return gate.evaluate(_proposed(brief), tb.MANIFEST, gate.near_copies(texts, every=False))


@query()
def gate_rules_near(spark: SparkSession, sf: str) -> DataFrame:
    """gate_rules with the duplicate check, which its SQL leaves out."""
    return gate.long_form(_judged(spark, sf)).select("note_id", "check")


@query()
def gate_totals_near(spark: SparkSession, sf: str) -> DataFrame:
    return gate.totals(_judged(spark, sf)).select("check", "notes")


@query(f"""{tb.views('notes', 'citations')}, r AS (SELECT note_id, unnest(list_filter([CASE WHEN scope IN ('src18', 'src19') THEN 'scope_unknown' END, CASE WHEN agent = 'a9' THEN 'agent_unknown' END,
  CASE WHEN profile = 'writer' AND agent <> 'a9' AND doc_id % 2 = 1 THEN 'profile_unknown' END, CASE WHEN scope = 'src3' THEN 'denylist_tags' END, CASE WHEN type = 'episodic' THEN 'episodic_agent_mismatch' END,
  CASE WHEN type IN ('semantic', 'procedural') AND note_id NOT IN (SELECT source FROM citations UNION ALL SELECT target FROM citations) THEN 'orphan_note' END], lambda x: x IS NOT NULL)) AS "check" FROM notes) SELECT "check", count(*) AS notes FROM r GROUP BY 1""")
def lint_summary_linked(spark: SparkSession, sf: str) -> DataFrame:
    """lint_summary with orphans looked for among the citations."""
    n = tb.notes(spark, sf).withColumns({"keys": F.array().cast("array<string>"), "malformed": F.lit(False)})
    cited = tb.citations(spark, sf)
    linked = cited.select(F.col("source").alias("note_id")).union(cited.select("target"))
    return gate.totals(gate.lint(n, tb.MANIFEST, linked)).select("check", "notes")


# ------------------------------------------------------------------------ boards


@query(f"WITH {_NOTES} SELECT CASE WHEN grouping(type) = 0 THEN 'type' WHEN grouping(scope) = 0 THEN 'scope' WHEN grouping(status) = 0 THEN 'status' ELSE 'total' END AS axis, coalesce(type, scope, status) AS value, count(*) AS notes FROM notes GROUP BY GROUPING SETS ((type), (scope), (status), ())")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return boards.status_counts(tb.notes(spark, sf))


_HOT = "SELECT scope, note_id, title, coalesce(modified, created) AS recency FROM notes WHERE status = 'ativo' AND type IN ('semantic', 'procedural')"


@query(f"WITH {_NOTES}, h AS ({_HOT}), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY recency DESC NULLS LAST, lower(title) DESC, note_id DESC) AS rank, greatest(count(*) OVER (PARTITION BY scope) - 15, 0) AS more FROM h) SELECT * FROM r WHERE rank <= 15", dates=("recency",))
def hot_board_top15(spark: SparkSession, sf: str) -> DataFrame:
    return boards.hot_board(tb.notes(spark, sf))


@query(f"WITH {_NOTES}, h AS ({_HOT} AND coalesce(modified, created) >= {_TODAY} - 21), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY recency DESC NULLS LAST, lower(title) DESC, note_id DESC) AS rank, greatest(count(*) OVER (PARTITION BY scope) - 15, 0) AS more FROM h) SELECT * FROM r WHERE rank <= 15", dates=("recency",))
def hot_board_window(spark: SparkSession, sf: str) -> DataFrame:
    return boards.hot_board(tb.notes(spark, sf), TODAY, 21)


@query(f"WITH {_NOTES} SELECT scope, count(*) AS entries, string_agg('- [[' || note_id || ']] — ' || title || ' · ' || concat_ws(' · ', CASE type WHEN 'semantic' THEN 'INS' ELSE 'PROC' END, agent, confidence), chr(10) ORDER BY lower(title), note_id) AS lines FROM notes WHERE status = 'ativo' AND type IN ('semantic', 'procedural') GROUP BY 1")
def index_map(spark: SparkSession, sf: str) -> DataFrame:
    return boards.index_map(tb.notes(spark, sf))


_LINE = "'- [[' || note_id || ']] — ' || coalesce(title, '') || ' · ' || concat_ws(' · ', CASE type WHEN 'semantic' THEN 'INS' ELSE 'PROC' END, agent, confidence)"


@query(f"WITH {_NOTES} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY lower(title) NULLS FIRST, note_id) AS entry, {_LINE} AS line FROM notes WHERE status = 'ativo' AND type IN ('semantic', 'procedural')")
def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    """index_map as a row for each line."""
    return boards.index_lines(tb.notes(spark, sf))


@query(f"{tb.views('notes', 'seen')} SELECT scope, max(seen) AS latest FROM notes JOIN seen USING (note_id) GROUP BY 1", dates=("latest",))
def active_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.active_scopes(tb.notes(spark, sf), maintain.last_seen(tb.access(spark, sf)))


@query("SELECT epoch_us(moment) AS micros, kind, what FROM (SELECT ts AS moment, event_type AS kind, 'e' || event_id AS what FROM events UNION ALL SELECT o_orderdate, 'order', 'o' || o_orderkey FROM orders) ORDER BY moment DESC, kind, what LIMIT 25")
def activity_feed_top25(spark: SparkSession, sf: str) -> DataFrame:
    e = tb.table(spark, sf, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.concat(F.lit("e"), "event_id").alias("what"))
    o = tb.table(spark, sf, "orders").select(F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.concat(F.lit("o"), "o_orderkey").alias("what"))
    return boards.activity_feed(e, o).select(F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), "kind", "what")


@query(f"WITH {_NOTES} SELECT note_id, round(exp(-greatest({_TODAY} - created, 0) / 14.0::DOUBLE), 6) AS fresh FROM notes")
def freshness_decay(spark: SparkSession, sf: str) -> DataFrame:
    return tb.notes(spark, sf).select("note_id", F.round(dx.freshness(F.date_diff(F.lit(TODAY), "created")), 6).alias("fresh"))


@query("SELECT o_orderkey, isoyear(d) || '-W' || lpad(week(d)::VARCHAR, 2, '0') AS week, strftime(d, '%Y-%m') AS month, year(d) || CASE WHEN month(d) <= 6 THEN '-H1' ELSE '-H2' END AS half_year, year(d)::VARCHAR AS year, (year(d) - year(d) % 5) || '-' || (year(d) - year(d) % 5 + 4) AS five_years FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = tb.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", *dx.period_labels(F.col("d")))


@query(f"WITH {_NOTES} SELECT note_id, created FROM notes ORDER BY created DESC, note_id LIMIT 30 OFFSET 30", dates=("created",))
def browser_page(spark: SparkSession, sf: str) -> DataFrame:
    return boards.page(tb.notes(spark, sf), 1).select("note_id", "created")


@query(f"WITH {_NOTES} SELECT type, count(*) AS notes FROM notes WHERE status = 'ativo' GROUP BY 1")
def count_active_types(spark: SparkSession, sf: str) -> DataFrame:
    return boards.count_active_types(tb.notes(spark, sf))


@query(f"WITH {_NOTES} SELECT day::DATE AS day, count(note_id) AS notes FROM (SELECT unnest(range(DATE '2024-03-01', DATE '2024-04-01', INTERVAL 1 DAY)) AS day) LEFT JOIN notes ON created = day GROUP BY 1", dates=("day",))
def month_days(spark: SparkSession, sf: str) -> DataFrame:
    return boards.month_days(tb.notes(spark, sf), dt.date(2024, 3, 1))


# ------------------------------------------------------------------------ writing

_PLAN = """, fine AS (SELECT * FROM notes WHERE type IN ('semantic', 'episodic') AND scope IN (SELECT 'src' || i FROM range(18) t(i)) AND scope <> 'src3' AND agent <> 'a9' AND NOT coalesce(profile = 'writer' AND doc_id % 2 = 1, false)),
r AS (SELECT note_id, type, tags, CASE type WHEN 'semantic' THEN 'Semantic' ELSE 'Episodic/' || agent END AS folder,
  '2024-10-01_' || CASE type WHEN 'semantic' THEN 'INS' ELSE 'MEM' END || '_' || coalesce(nullif(trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'nota') AS name FROM fine),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY note_id) AS n FROM r)
SELECT note_id, folder, name || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS file, array_to_string(['mem/' || type] || tags, ',') AS some_tags FROM k"""


@query(f"WITH {_NOTES}{_PLAN}")
def write_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Where the accepted candidates would be stored."""
    return _placed(gate.evaluate(_candidates(spark, sf), tb.MANIFEST))


@query()
def write_plan_near(spark: SparkSession, sf: str) -> DataFrame:
    """write_plan without near copies, which its SQL leaves in."""
    return _placed(_judged(spark, sf))


def _placed(judged: DataFrame) -> DataFrame:
    plan = write.plan_writes(judged, F.lit(TODAY), required=["vault"])
    kind = F.filter("all_tags", lambda t: t.startswith("mem/") | ~(t.startswith("agent/") | (t == "vault")))
    return plan.select("note_id", "folder", "file", F.array_join(kind, ",").alias("some_tags"))


@query(f"WITH {_NOTES} SELECT '[[d' || c_custkey || '|x]]' AS ref, note_id, title, note_id IS NOT NULL AS found FROM customer LEFT JOIN notes ON note_id = 'd' || c_custkey")
def note_get(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' numbers as wikilinks to notes, some of which do not exist."""
    refs = tb.table(spark, sf, "customer").select(F.concat(F.lit("[[d"), "c_custkey", F.lit("|x]]")).alias("ref"))
    return write.get(tb.notes(spark, sf).select("note_id", "title"), refs)


from . import stored  # noqa: E402,F401  (registers its queries, which use the SQL above)
