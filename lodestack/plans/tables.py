"""Notes, access log, links and snapshots as views of the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Agent, Frontmatter, Manifest, Scopes
from ..operators.lexical import write_index
from ..workspace import fresh_path

MANIFEST = Manifest(
    scopes=Scopes(known=tuple(f"src{i}" for i in range(18))),
    agents=tuple(Agent(f"a{i}", ("reader",) if i % 2 else ("writer", "reader")) for i in range(9)),
    frontmatter=Frontmatter(denylist_tags=("src3",)),
    research_enabled=False,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files are too few to keep them busy."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def notes(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """Documents as notes: source is the scope, language the type, labels give status and confidence.

    ``busy`` deals them to all cores, for work that costs more than a shuffle.
    """
    labels = table(spark, sf_dir, "labels")
    return _as_notes(bodies(spark, sf_dir, busy).join(labels, "doc_id", "left"))


def brief_notes(spark: SparkSession, sf_dir: str, **taken: Column) -> DataFrame:
    """``notes`` without bodies but with what is ``taken`` from ``text``, so that no text is shuffled to the labels."""
    docs = bodies(spark, sf_dir).select("doc_id", "lang", "source", F.substring("text", 1, 40).alias("text"), *[c.alias(name) for name, c in taken.items()])
    return _as_notes(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left"), *taken).drop("body")


def bodies(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """The documents; what needs no labels reads these, so that no text is shuffled to them."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs) if busy else docs


def titled(docs: DataFrame) -> DataFrame:
    """note_id, scope, title, tags, body of documents."""
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("note_id"), F.col("source").alias("scope"), F.substring("text", 1, 40).alias("title"), F.array("lang", "source").alias("tags"), F.col("text").alias("body"))


def _as_notes(docs: DataFrame, *more: str) -> DataFrame:
    d, day = F.col("doc_id"), lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % n).cast("int"))
    kind = type_of_language()
    status = F.when(F.col("toxic") == 1, "arquivado").when(F.col("quality") == 0, "deprecado").otherwise("ativo")
    return docs.select(
        "doc_id",
        F.concat(F.lit("d"), d).alias("note_id"),
        F.concat(F.lit("vault/"), "source", F.lit("/d"), d, F.lit(".md")).alias("path"),
        kind.alias("type"),
        F.col("source").alias("scope"),
        status.alias("status"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("confidence"),
        F.substring("text", 1, 40).alias("title"),
        F.concat(F.lit("a"), d % 10).alias("agent"),
        F.when(d % 3 == 0, "writer").alias("profile"),
        F.array("lang", "source").alias("tags"),
        day(300).alias("created"),
        F.when(d % 2 == 0, day(200)).alias("modified"),
        F.lit(None).cast("date").alias("last_accessed"),
        F.when(d % 4 != 0, day(250)).alias("last_tested"),
        F.col("text").alias("body"),
        *more,
    )


def type_of_language() -> Column:
    return F.when(F.col("lang") == "en", "semantic").when(F.col("lang") == "de", "procedural").when(F.col("lang") == "fr", "episodic").otherwise("research")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accesses to the notes of their users' numbers."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("kind"), F.array(F.concat(F.lit("d"), "user_id")).alias("ids"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part comes from which supplier, by return flag and line status."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("origin")).distinct()


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as each other's successors: every seventh replaces the one before it."""
    d = table(spark, sf_dir, "documents").where("doc_id % 7 = 0 and doc_id > 0")
    return d.select(F.concat(F.lit("d"), "doc_id").alias("source"), F.concat(F.lit("d"), F.col("doc_id") - 1).alias("target"), F.lit("supersedes").alias("relation"), F.lit("supersedes").alias("origin"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pages state, by their names."""
    p = table(spark, sf_dir, "pages")
    raw = F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"/]+)"'), F.lit(1)))
    return p.select(F.concat(F.lit("page"), "page_id").alias("source"), raw.alias("raw"), F.lit("wikilink").alias("relation"), F.lit("wikilink").alias("origin"))


def opening_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their first word: ids that links may name, not unique."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.regexp_extract("text", r"^(\S+)", 1).alias("note_id"), F.concat(F.lit("d"), "doc_id").alias("path"))


_stored: dict[tuple[str, str], str] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the stored index of the documents, made once for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = fresh_path(spark, "lexical")
        write_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), path)
        _stored[key] = path
    return _stored[key]


#: The same views for DuckDB.
SQL = {
    "notes": """notes AS (SELECT d.doc_id, 'd' || d.doc_id AS note_id, 'vault/' || source || '/d' || d.doc_id || '.md' AS path,
  CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'procedural' WHEN 'fr' THEN 'episodic' ELSE 'research' END AS type, source AS scope,
  CASE WHEN toxic = 1 THEN 'arquivado' WHEN quality = 0 THEN 'deprecado' ELSE 'ativo' END AS status,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS confidence, substr(text, 1, 40) AS title, 'a' || d.doc_id % 10 AS agent,
  CASE WHEN d.doc_id % 3 = 0 THEN 'writer' END AS profile, [lang, source] AS tags,
  DATE '2024-01-01' + (d.doc_id % 300)::INT AS created, CASE WHEN d.doc_id % 2 = 0 THEN DATE '2024-01-01' + (d.doc_id % 200)::INT END AS modified,
  NULL::DATE AS last_accessed, CASE WHEN d.doc_id % 4 <> 0 THEN DATE '2024-01-01' + (d.doc_id % 250)::INT END AS last_tested, text AS body
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "seen": "seen AS (SELECT 'd' || user_id AS note_id, max(ts)::DATE AS seen FROM events GROUP BY 1)",
    "edges": "edges AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_returnflag AS relation, l_linestatus AS origin FROM lineitem)",
    "steps": "steps AS (SELECT source AS here, target AS there, relation, origin FROM edges UNION ALL SELECT target, source, relation, origin FROM edges)",
    "citations": "citations AS (SELECT 'd' || doc_id AS source, 'd' || (doc_id - 1) AS target FROM documents WHERE doc_id % 7 = 0 AND doc_id > 0)",
    "links": """links AS (SELECT 'page' || page_id AS source, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS raw FROM pages)""",
    "words": "words AS (SELECT regexp_extract(text, '^(\\S+)', 1) AS note_id, 'd' || doc_id AS path FROM documents)",
    "ids": "ids AS (SELECT note_id, count(*) > 1 AS ambiguous FROM words GROUP BY 1)",
    "resolved": """resolved AS (SELECT l.source, l.raw, coalesce(e.note_id, o.other) AS target FROM links l LEFT JOIN ids e ON e.note_id = regexp_replace(l.raw, '\\.md$', '')
  LEFT JOIN (SELECT lower(note_id) AS low, min(note_id) AS other FROM ids GROUP BY 1 HAVING count(*) = 1 AND NOT bool_or(ambiguous)) o ON o.low = lower(regexp_replace(l.raw, '\\.md$', '')))""",
    "tok": "tok AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM documents)",
}


def views(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
