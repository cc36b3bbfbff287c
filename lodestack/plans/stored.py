"""Registered queries of indexes that change and of searches by many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vectors as vx
from ..operators import adjacency, batch_search, index, ivf, segments
from ..workspace import fresh_path
from . import index_run, queries as core, tables as tb
from .registry import query

# ---------------------------------------------------------------- index runs


def _version(spark: SparkSession, sf: str, second: bool) -> DataFrame:
    """path, mtime, content of the documents as notes; the second time some are new, changed, touched or gone."""
    d, last = F.col("doc_id"), F.col("doc_id") % 10
    text = F.coalesce("text", F.lit(""))
    docs = tb.table(spark, sf, "documents").where(last != (4 if second else 6))
    changed = F.when((last == 3) & F.lit(second), F.concat(text, F.lit("\n\nchanged"))).otherwise(text)
    content = F.concat(F.lit("---\nscope: "), F.coalesce("source", F.lit("")), F.lit("\n---\n"), changed)
    mtime = F.timestamp_seconds(F.lit(1_704_067_200) + d + F.when(F.lit(second) & last.isin(3, 5), 3600).otherwise(0))
    return docs.select(F.concat(F.lit("vault/Semantic/d"), d, F.lit(".md")).alias("path"), mtime.alias("mtime"), content.cast("binary").alias("content"))


def _run(spark: SparkSession, sf: str, path: str, second: bool) -> index_run.Report:
    notes = _version(spark, sf, second)
    read = lambda paths: notes.join(paths, "path", "left_semi").select("path", "content")
    hashed = notes.select("path", index.content_hash(F.col("content")).alias("hash"))
    hashes = lambda paths: hashed.join(paths, "path", "left_semi")
    return index_run.run(spark, path, notes.select("path", "mtime"), read, index_run.NO_VECTORS, hashes=hashes)


_STATE = """SELECT 'd' || doc_id AS note_id, 'vault/Semantic/d' || doc_id || '.md' AS path,
  sha256('---' || chr(10) || 'scope: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || coalesce(text, '') || CASE WHEN doc_id % 10 = 3 THEN chr(10) || chr(10) || 'changed' ELSE '' END) AS hash,
  1704067200 + doc_id + CASE WHEN doc_id % 10 IN (3, 5) THEN 3600 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 <> 4"""


@query(_STATE)
def index_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of an index of words after a run over all documents and one over what has changed since."""
    path = fresh_path(spark, "index")
    _run(spark, sf, path, False)
    _run(spark, sf, path, True)
    state = segments.state(spark, segments.open_index(spark, path))
    return state.select("note_id", "path", "hash", F.unix_timestamp("mtime").alias("mtime"))


@query("""SELECT false AS full_run, count(*) FILTER (doc_id % 10 IN (3, 6)) AS indexed, count(*) FILTER (doc_id % 10 = 5) AS touched,
  count(*) FILTER (doc_id % 10 NOT IN (3, 4, 5, 6)) AS unchanged, count(*) FILTER (doc_id % 10 = 4) AS removed, 0 AS ambiguous FROM documents""")
def index_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """What the second of these runs reports."""
    path = fresh_path(spark, "index")
    _run(spark, sf, path, False)
    r = _run(spark, sf, path, True)
    row = (r.full, r.indexed, r.touched, r.unchanged, r.removed, r.ambiguous)
    return spark.createDataFrame([row], "full_run boolean, indexed long, touched long, unchanged long, removed long, ambiguous long")


# ------------------------------------------------------------ changed postings

_CHANGED_TOK = r"tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS t FROM (SELECT doc_id, text || CASE WHEN doc_id % 10 = 3 THEN ' the new text' ELSE '' END AS text FROM documents WHERE doc_id % 10 <> 4))"


def _changed_index(spark: SparkSession, sf: str) -> segments.Stored:
    """All documents as one-chunk notes; a tenth is then replaced and another dropped."""
    path = fresh_path(spark, "segments")
    rows = tb.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("note_id"), "text")
    segments.upsert(spark, path, rows.drop("doc_id"))
    segments.upsert(spark, path, rows.where("doc_id % 10 = 3").drop("doc_id").withColumn("text", F.concat("text", F.lit(" the new text"))))
    return segments.delete(spark, path, rows.where("doc_id % 10 = 4").select("note_id"))


@query(f"WITH {core._bm25_sql(core.TERMS).replace(tb.SQL['tok'], _CHANGED_TOK)} SELECT chunk_id, round(score, 6) AS score FROM bm")
def segment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over an index whose postings have been replaced and dropped in later segments."""
    found = segments.bm25(spark, _changed_index(spark, sf), core.TEXT)
    return found.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_CHANGED_TOK}, p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM tok) SELECT term, count(*) AS chunks FROM p GROUP BY term")
def segment_terms(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the chunks that count hold each term."""
    return segments.postings(spark, _changed_index(spark, sf)).groupBy("term").agg(F.count("*").alias("chunks"))


# -------------------------------------------------------------- batched search


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as notes of one chunk, the notes, and the vectors that have a document's number."""
    docs = tb.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("note_id"), F.lit(0).alias("ordinal"), "text")
    v = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), vx.doubles(F.col("embedding")).alias("embedding"))
    return docs, tb.notes(spark, sf), v


def _asked(docs: DataFrame, notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every hundredth document as a query in its own type and scope; some take dead notes too, some want labels."""
    q = docs.where("chunk_id % 100 = 0").join(vectors, "chunk_id", "left").join(notes.select("note_id", "type", "scope"), "note_id")
    kind = F.col("chunk_id") / 100 % 3
    own = F.when(kind == 1, F.create_map(F.lit("status"), F.array(F.lit("ativo"), F.lit("deprecado")))).when(kind == 2, F.create_map(F.lit("min_confidence"), F.array(F.lit("low"))))
    return q.select(F.col("chunk_id").alias("query_id"), "note_id", "text", "embedding", "type", "scope", own.cast(batch_search.FILTERS).alias("filters"))


_POOLS = f"""WITH {tb.SQL['notes']}, {tb.SQL['tok']}, tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len(t)) / count(*)::DOUBLE AS avg FROM tok), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT doc_id AS query_id, type, scope, doc_id // 100 % 3 AS kind FROM notes WHERE doc_id % 100 = 0),
raw AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}\\x{{0300}}-\\x{{036F}}]+)'))) AS w FROM documents WHERE doc_id % 100 = 0),
wanted AS (SELECT query_id, strip_accents(w) AS term, count(*) AS times FROM raw GROUP BY ALL),
pairs AS (SELECT query_id, n.doc_id FROM q JOIN notes n ON n.type = q.type AND n.scope = q.scope WHERE CASE WHEN kind = 1 THEN status IN ('ativo', 'deprecado') WHEN kind = 2 THEN status = 'ativo' AND confidence IN ('low', 'medium', 'high') ELSE status = 'ativo' END),
b AS (SELECT query_id, doc_id, sum(times * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) AS b FROM pairs JOIN wanted USING (query_id) JOIN tf USING (doc_id, term) JOIN df USING (term), stats GROUP BY query_id, doc_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) <= POOL),
v AS (SELECT query_id, doc_id, {core._COS} AS cos FROM pairs JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) <= POOL),
vs AS (SELECT *, min(cos) OVER (PARTITION BY query_id) AS lo, max(cos) OVER (PARTITION BY query_id) AS hi FROM v WHERE cos > 0),
bs AS (SELECT *, min(b) OVER (PARTITION BY query_id) AS lo, max(b) OVER (PARTITION BY query_id) AS hi FROM b),
fused AS (SELECT query_id, doc_id, coalesce(CASE WHEN vs.hi = vs.lo THEN 1 ELSE (cos - vs.lo) / (vs.hi - vs.lo) END, 0) * 0.6::DOUBLE + coalesce(CASE WHEN bs.hi = bs.lo THEN 1 ELSE (b - bs.lo) / (bs.hi - bs.lo) END, 0) * 0.4::DOUBLE AS score, coalesce(cos, 0) AS cos FROM vs FULL JOIN bs USING (query_id, doc_id)),
hits AS (SELECT query_id, note_id, CASE WHEN status = 'ativo' THEN score ELSE score / 2 END AS s, cos FROM fused JOIN notes USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, note_id) <= BEST)"""


@query(_POOLS.replace("POOL", "40").replace("BEST", "8") + " SELECT query_id, note_id, round(s, 6) AS score, round(cos, 6) AS similarity FROM hits")
def hybrid_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document, with its whole text, vector and filters, against all documents of its type and scope."""
    docs, notes, vectors = _corpus(spark, sf)
    hits = batch_search.search_many(docs, notes, _asked(docs, notes, vectors), 8, ("type", "scope"), vectors=vectors)
    return hits.select("query_id", "note_id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


_GATE = _POOLS.replace("POOL", "40").replace("BEST", "5").replace("doc_id // 100 % 3 AS kind", "0 AS kind").replace("regexp_extract_all(lower(text)", "regexp_extract_all(lower(substr(trim(trim(substr(text, 1, 40), ' ') || chr(10) || chr(10) || trim(text, ' \t\n\v\f\r'), ' \t\n\v\f\r'), 1, 2000))")


@query(_GATE + " SELECT 'd' || query_id AS note_id, list(note_id ORDER BY note_id) AS similar FROM hits WHERE cos > 0.25::DOUBLE AND note_id <> 'd' || query_id GROUP BY query_id")
def gate_near_search(spark: SparkSession, sf: str) -> DataFrame:
    """Near copies that a write of every hundredth document finds: its five best hits, those above a cosine."""
    docs, notes, vectors = _corpus(spark, sf)
    asked = _asked(docs, notes, vectors).withColumn("text", batch_search.dedup_query(F.substring("text", 1, 40), F.col("text")))
    return batch_search.near_notes(asked, docs, notes, 0.25, vectors=vectors)


# --------------------------------------------------------------- stored links


def _links(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "links")
    adjacency.write_adjacency(tb.edges(spark, sf), path)
    return path


@query(f"{tb.views('edges', 'steps')}, {core._H0}, {core._H1}, {core._H2} SELECT note_id, path[1] AS seed, hops, array_to_string(path, '>') AS path FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)")
def expand_2hop_stored(spark: SparkSession, sf: str) -> DataFrame:
    """expand_2hop from stored links."""
    found = adjacency.expand_stored(spark, _links(spark, sf), core._seeds(spark, sf), 2)
    return found.drop("relations").withColumn("path", F.array_join("path", ">"))


@query(f"""{tb.views('edges', 'steps')}, q0 AS (SELECT p_partkey AS query_id, 'p' || p_partkey AS note_id, 0 AS hops, ['p' || p_partkey] AS path FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT p_partkey, 's' || (p_partkey // 100 % 7 + 1), 0, ['s' || (p_partkey // 100 % 7 + 1)] FROM part WHERE p_partkey % 100 = 0),
q1 AS (SELECT query_id, there AS note_id, 1 AS hops, min(list_append(path, there)) AS path FROM q0 JOIN steps ON here = note_id WHERE (query_id, there) NOT IN (SELECT query_id, note_id FROM q0) GROUP BY 1, 2),
q2 AS (SELECT query_id, there AS note_id, 2 AS hops, min(list_append(path, there)) AS path FROM q1 JOIN steps ON here = note_id WHERE (query_id, there) NOT IN (SELECT query_id, note_id FROM q0 UNION ALL SELECT query_id, note_id FROM q1) GROUP BY 1, 2)
SELECT query_id, hops, count(*) AS reached, min(array_to_string(path, '>')) AS least_path FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1 UNION ALL SELECT * FROM q2) GROUP BY 1, 2""")
def expand_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth part, with a supplier beside it, as the seeds of a query of its own: how much each hop reaches."""
    own = F.col("p_partkey").alias("query_id")
    parts = tb.table(spark, sf, "part").where("p_partkey % 100 = 0")
    seeds = parts.select(own, F.concat(F.lit("p"), "p_partkey").alias("note_id")).union(parts.select(own, F.concat(F.lit("s"), F.expr("p_partkey div 100 % 7 + 1"))))
    return adjacency.reach_stored(spark, _links(spark, sf), seeds, 2)


# --------------------------------------------------------------- inverted lists


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {core._COS} AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT query_id, id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM s QUALIFY rank <= {core.K}")
def ivf_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector against an index of all by inverted lists, exactly."""
    v = core._vectors(spark, sf).select("id", "embedding")
    path = fresh_path(spark, "ivf")
    ivf.write_ivf(v, path)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return ivf.search_ivf(spark, path, asked, core.K, exact=True).withColumn("cos", F.round("cos", 6))
