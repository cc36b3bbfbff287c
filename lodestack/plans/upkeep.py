"""Queries of upkeep: gate fields, links, logs, reports, proposals and derived documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Frontmatter
from ..functions import dates as dx, text as tx, vectors as vx
from ..operators import boards, filters, gate, graph, index, maintain, vector, write
from ..sources import logs
from . import tables as tb
from .registry import TODAY, TODAY_SQL, query

_NOTES = tb.SQL["notes"]


def _no_strings() -> Column:
    return F.array().cast("array<string>")


# -------------------------------------------------------------------------- gate

_FIELDS = f"""WITH {_NOTES} SELECT note_id, unnest(list_filter([
  CASE WHEN doc_id % 13 = 0 OR scope IS NULL THEN 'scope_missing' END, CASE WHEN doc_id % 17 = 0 THEN 'agent_missing' END,
  CASE WHEN doc_id % 7 = 0 THEN 'confidence_invalid' END, CASE WHEN doc_id % 11 = 0 THEN 'denylist_keys' END,
  CASE WHEN type IN ('semantic', 'procedural') AND doc_id % 5 = 0 THEN 'source_missing' END,
  CASE WHEN type = 'procedural' AND doc_id % 3 <> 0 THEN 'evidence_missing' END,
  CASE WHEN type IN ('semantic', 'procedural') AND confidence = 'high' AND doc_id % 7 <> 0 AND doc_id % 3 <> 0 THEN 'confidence_unverified' END], lambda x: x IS NOT NULL)) AS "check" FROM notes"""


@query(_FIELDS)
def gate_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with blank, missing and denied fields; the checks of those fields."""
    d = F.col("doc_id")
    changed = {
        "scope": F.when(d % 13 == 0, " ").otherwise(F.col("scope")),
        "agent": F.when(d % 17 != 0, F.col("agent")),
        "confidence": F.when(d % 7 == 0, "certain").otherwise(F.col("confidence")),
        "source": F.when(d % 5 == 0, "  ").otherwise("import"),
        "keys": F.when(d % 11 == 0, F.array(F.lit("title"), F.lit("password"))).otherwise(_no_strings()),
        "evidence": F.when(d % 3 == 0, F.array(F.lit(" "), F.lit("[[d1]]"))).otherwise(F.array(F.lit(" "))),
        "supersedes": _no_strings(),
        "merge": F.lit(False),
    }
    manifest = replace(tb.MANIFEST, frontmatter=Frontmatter(denylist_keys=("password",)))
    found = gate.long_form(gate.evaluate(tb.notes(spark, sf).withColumns(changed), manifest))
    checks = ("scope_missing", "agent_missing", "confidence_invalid", "denylist_keys", "source_missing", "evidence_missing", "confidence_unverified")
    return found.where(F.col("check").isin(*checks)).select("note_id", "check")


_COPIES = "k AS (SELECT *, first_value(note_id) OVER (PARTITION BY type, scope, md5(body) ORDER BY doc_id) AS head FROM notes WHERE type IN ('semantic', 'procedural'))"


@query(f"WITH {_NOTES}, {_COPIES} SELECT note_id, head AS similar, doc_id % 4 = 0 AS decided FROM k WHERE note_id <> head AND scope IN (SELECT 'src' || i FROM range(18) t(i)) AND doc_id % 4 <> 0")
def gate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates rejected as copies of an earlier note; those that name what they supersede pass."""
    n = tb.notes(spark, sf)
    keys = [F.col("type"), F.col("scope"), index.content_hash(F.col("body")).alias("hash")]
    firsts = n.where(F.col("type").isin(*gate.KNOWLEDGE)).groupBy(*keys).agg(F.min_by("note_id", "doc_id").alias("head"))
    near = n.select("note_id", *keys).join(firsts, ["type", "scope", "hash"]).where("note_id <> head").select("note_id", F.array("head").alias("similar"))
    d = F.col("doc_id")
    c = n.withColumns({"source": F.lit("import"), "keys": _no_strings(), "evidence": _no_strings(), "merge": F.lit(False), "supersedes": F.when(d % 4 == 0, F.array(F.lit("d1")))})
    judged = gate.evaluate(c, tb.MANIFEST, near).where(F.exists("findings", lambda f: f["check"] == "duplicate"))
    return judged.select("note_id", F.col("similar")[0].alias("similar"), gate.has_content("supersedes").alias("decided"))


# ------------------------------------------------------------------------- links

_LINKING = "SELECT 'd' || doc_id AS source, unnest([source, lang, 'd1', 'd2']) AS raw, unnest(['wikilink', 'wikilink', 'supersedes', 'supersedes']) AS relation FROM documents"


@query(f"{_LINKING} WHERE source IS NOT NULL AND lang IS NOT NULL")
def authored_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links in bodies and fields, among code, headings of the same note and blanks."""
    d = tb.table(spark, sf, "documents").where("source is not null and lang is not null")
    body = F.concat(F.lit("See [["), "source", F.lit("|x]] and `[[code]]`\n```\n[[fenced]]\n```\n![["), "lang", F.lit("#h]] [[#own]]"))
    notes = d.select(F.concat(F.lit("d"), "doc_id").alias("note_id"), body.alias("body"), F.array(F.lit("[[d1|y]]"), F.lit(" d2 "), F.lit(" ")).alias("supersedes"))
    return graph.authored(notes).select("source", "raw", "relation")


_IDS = "ids AS (SELECT 'p' || p_partkey AS note_id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)"


@query(f"""{tb.views('edges')}, {_IDS}, w AS (SELECT DISTINCT 'p' || c_custkey AS source, CASE WHEN c_custkey % 5 = 0 THEN 'p' || c_custkey ELSE 's' || (c_nationkey + 1) END AS target, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'R' END AS relation, 'F' AS origin FROM customer)
SELECT * FROM w WHERE source <> target AND trim(relation) <> '' AND source IN (SELECT note_id FROM ids) AND target IN (SELECT note_id FROM ids) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = w.source AND e.target = w.target AND e.relation = w.relation AND e.origin = w.origin)""")
def new_links(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed links, some of which are there, join a note with itself, name no note or no relation."""
    c, part, supplier = (tb.table(spark, sf, t) for t in ("customer", "part", "supplier"))
    own = F.concat(F.lit("p"), "c_custkey")
    target = F.when(F.col("c_custkey") % 5 == 0, own).otherwise(F.concat(F.lit("s"), F.col("c_nationkey") + 1))
    proposed = c.select(own.alias("source"), target.alias("target"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise("R").alias("relation"), F.lit("F").alias("origin"))
    ids = part.select(F.concat(F.lit("p"), "p_partkey").alias("note_id")).union(supplier.select(F.concat(F.lit("s"), "s_suppkey")))
    return graph.new_links(tb.edges(spark, sf), proposed, ids)


@query(f"""{tb.views('edges', 'steps')}, o AS (SELECT 'p' || p_partkey AS note_id FROM part)
SELECT there AS note_id, '[[' || min(here) || ']] → [[' || there || ']]' AS via FROM steps WHERE here IN (SELECT note_id FROM o) AND there NOT IN (SELECT note_id FROM o) GROUP BY there""")
def via_paths(spark: SparkSession, sf: str) -> DataFrame:
    """How notes were reached from all parts, as it is shown."""
    seeds = tb.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("note_id"))
    reached = graph.expand(tb.edges(spark, sf), seeds, 1).where("hops > 0")
    return reached.select("note_id", graph.via(F.col("path")).alias("via"))


# -------------------------------------------------------------------------- logs


@query("SELECT 'd' || user_id AS note_id, max(ts)::DATE AS seen FROM events WHERE event_id % 10 <> 0 GROUP BY 1", dates=("seen",))
def access_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses as JSON lines, every tenth of them torn."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = tb.table(spark, sf, "events").select("event_id", F.to_json(F.struct(stamp.alias("ts"), F.col("event_type").alias("kind"), F.array(F.concat(F.lit("d"), "user_id")).alias("ids"))).alias("line"))
    lines = e.select(F.when(F.col("event_id") % 10 == 0, F.substring("line", 1, 20)).otherwise(F.col("line")).alias("value"))
    return maintain.last_seen(logs.parse_access(lines))


_ACTIONS = "CASE event_id % 3 WHEN 0 THEN 'write' WHEN 1 THEN 'reject' ELSE 'get' END"


@query(f"SELECT count(*) FILTER (a = 'write') AS accepted, count(*) FILTER (a = 'reject') AS rejected FROM (SELECT {_ACTIONS} AS a FROM events WHERE event_id % 8 <> 0)")
def action_log_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Actions as JSON lines with other fields, every eighth line without a time."""
    i = F.col("event_id")
    action = F.when(i % 3 == 0, "write").when(i % 3 == 1, "reject").otherwise("get")
    line = F.to_json(F.struct(F.when(i % 8 != 0, F.col("ts").cast("string")).alias("ts"), action.alias("action"), F.col("value").alias("extra")))
    return boards.activity_stats(logs.parse_actions(tb.table(spark, sf, "events").select(line.alias("value"))))


@query("SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag ELSE 'related' END AS relation, 'x' AS agent FROM lineitem")
def link_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Links as JSON lines; one without a relation is related."""
    relation = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_returnflag"))
    record = F.struct(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), relation.alias("relation"), F.lit("x").alias("agent"))
    lines = tb.table(spark, sf, "lineitem").select(F.to_json(record).alias("value"))
    return logs.parse_links(lines).select("source", "target", "relation", "agent")


# ------------------------------------------------------------------------ reports


@query("""SELECT 'd' || doc_id AS doc, unnest([source, 'B']) AS section, unnest([lang, '[[d' || doc_id || ']]']) AS item FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def board_items(spark: SparkSession, sf: str) -> DataFrame:
    """What rendered boards list, read back from their lines."""
    d = tb.table(spark, sf, "documents").where("source is not null and lang is not null")
    link = F.concat(F.lit("  * [[d"), "doc_id", F.lit("]]"))
    text = F.array(F.lit("# Board"), F.concat(F.lit("## "), "source"), F.concat(F.lit("- "), "lang"), F.lit("plain - text"), F.lit("### B "), link)
    return boards.parse_board(d.select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.posexplode(text).alias("line_no", "text")))


@query("SELECT o_orderkey, floor((epoch(TIMESTAMP '2024-10-01 12:00:00') - epoch(o_orderdate)) / 86400)::BIGINT AS days FROM orders")
def report_age(spark: SparkSession, sf: str) -> DataFrame:
    o, now = tb.table(spark, sf, "orders"), F.lit("2024-10-01 12:00:00").cast("timestamp")
    return o.select("o_orderkey", boards.report_age(F.col("o_orderdate").cast("timestamp"), now).alias("days"))


_STATES = """s AS (SELECT doc_id, doc_id % 3 AS mtime, md5(text) AS hash FROM documents WHERE doc_id % 5 <> 0),
c AS (SELECT doc_id, doc_id % 3 + (doc_id % 2) AS mtime, md5(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS hash FROM documents WHERE doc_id % 11 <> 0),
diff AS (SELECT 'd' || coalesce(s.doc_id, c.doc_id) AS path, CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN s.doc_id IS NULL THEN 'new' WHEN s.mtime = c.mtime THEN 'unchanged' WHEN s.hash = c.hash THEN 'touched' ELSE 'changed' END AS action FROM s FULL JOIN c ON s.doc_id = c.doc_id)"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents, with some removed, added, touched and changed."""
    d, i, path = tb.table(spark, sf, "documents"), F.col("doc_id"), F.concat(F.lit("d"), "doc_id").alias("path")
    old = d.where(i % 5 != 0).select(path, (i % 3).alias("mtime"), index.content_hash(F.col("text")).alias("hash"))
    new = F.concat("text", F.when(i % 7 == 0, "!").otherwise(""))
    return old, d.where(i % 11 != 0).select(path, (i % 3 + i % 2).alias("mtime"), index.content_hash(new).alias("hash"))


_COUNTED = ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("new", "changed", "touched", "unchanged", "removed"))


@query(f"WITH {_STATES} SELECT {_COUNTED}, (SELECT count(*) FROM c) AS chunks FROM diff")
def index_report(spark: SparkSession, sf: str) -> DataFrame:
    old, now = _states(spark, sf)
    return index.index_report(index.snapshot_diff(old, now), now.select("path"))


@query(f"WITH {_STATES} SELECT path, 'kept' AS made FROM diff WHERE action IN ('unchanged', 'touched') UNION ALL SELECT path, 'fresh' FROM diff WHERE action IN ('new', 'changed')")
def index_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The index after a run: rows of what went or changed are gone, fresh ones are in."""
    old, now = _states(spark, sf)
    diff = index.snapshot_diff(old, now)
    fresh = now.join(index.to_index(diff), "path", "left_semi").select("path", F.lit("fresh").alias("made"))
    return index.apply_diff(old.select("path", F.lit("kept").alias("made")), diff, fresh)


@query(f"WITH {_NOTES} SELECT note_id, scope IN ('src1', 'src2') AND scope IS NOT NULL AS read_only FROM notes")
def read_only_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = tb.notes(spark, sf).select("note_id", "scope")
    return index.with_read_only(n, n.where("scope in ('src1', 'src2')")).select("note_id", "read_only")


@query("""WITH w AS (SELECT 'd' || doc_id AS path, text AS was FROM documents WHERE doc_id % 6 <> 0), r AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END AS now FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(w.path, r.path) AS path, CASE WHEN w.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'left over' ELSE 'stale' END AS state FROM w FULL JOIN r ON w.path = r.path WHERE w.path IS NULL OR r.path IS NULL OR was <> now""")
def stale_documents(spark: SparkSession, sf: str) -> DataFrame:
    d, i, path = tb.table(spark, sf, "documents"), F.col("doc_id"), F.concat(F.lit("d"), "doc_id").alias("path")
    rendered = F.when(i % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return write.stale_documents(d.where(i % 6 != 0).select(path, F.col("text").alias("body")), d.where(i % 11 != 0).select(path, rendered.alias("body")))


@query(f"WITH {_NOTES} SELECT note_id, scope, last_tested, {TODAY_SQL} - coalesce(last_tested, created) AS days_stale FROM notes WHERE type = 'procedural' AND status = 'ativo' AND {TODAY_SQL} - coalesce(last_tested, created) > 180 ORDER BY days_stale DESC, note_id LIMIT 20", dates=("last_tested",))
def stale_report_top20(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty longest untested procedures, as a report lists them."""
    return maintain.longest_untested(maintain.stale(tb.notes(spark, sf), TODAY, 180)).limit(20)


@query(f"WITH {_NOTES} SELECT scope, max(coalesce(modified, created)) AS latest FROM notes WHERE status = 'ativo' AND type IN ('semantic', 'procedural') GROUP BY 1 ORDER BY latest DESC, scope LIMIT 5", dates=("latest",))
def hot_scopes_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five scopes that come first on the board."""
    return boards.hot_scopes(boards.hot_board(tb.notes(spark, sf))).limit(5)


@query("SELECT DISTINCT source AS scope FROM documents WHERE source IS NOT NULL")
def distinct_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return boards.distinct_scopes(tb.notes(spark, sf))


@query("""WITH s AS (SELECT DISTINCT source AS scope FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'global')
SELECT scope, CASE WHEN scope = 'global' THEN 2 WHEN scope IN ('src2', 'src1') THEN 0 ELSE 1 END AS "group", CASE scope WHEN 'src2' THEN 1 WHEN 'src1' THEN 2 ELSE 0 END AS place FROM s""")
def scope_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sort keys of scopes: those of the settings, the others by name, global last."""
    s = boards.distinct_scopes(tb.notes(spark, sf)).union(spark.range(1).select(F.lit("global")))
    key = s.select("scope", boards.scope_order(F.col("scope"), ["src2", "src1"]).alias("k"))
    return key.select("scope", "k.group", F.col("k.place").cast("int").alias("place"))


# ------------------------------------------------------------------- notes, writing


@query(f"WITH {_NOTES} SELECT 'd' || c_custkey AS target, c_name AS body, 'a' || c_nationkey AS agent, 'pendente' AS status FROM customer WHERE 'd' || c_custkey IN (SELECT note_id FROM notes)")
def proposals_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as proposed changes to notes, some of which do not exist."""
    changes = tb.table(spark, sf, "customer").select(F.concat(F.lit("d"), "c_custkey").alias("target"), F.col("c_name").alias("body"), F.concat(F.lit("a"), "c_nationkey").alias("agent"))
    return write.proposals(changes, tb.notes(spark, sf))


@query("SELECT coalesce(CASE c_nationkey % 3 WHEN 0 THEN 'aceita' WHEN 1 THEN 'rejeitada' END, 'pendente') AS status, count(*) AS notes FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1")
def proposals_by_status(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    c = tb.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("d"), "c_custkey")).alias("target"), F.when(n == 0, "aceita").when(n == 1, "rejeitada").alias("status"))
    return boards.proposals(c)


@query(f"{tb.views('notes', 'citations')}, dep AS (SELECT target AS note_id, list_sort(list_distinct(list(source))) AS successors FROM citations WHERE target IN (SELECT note_id FROM notes WHERE type = 'procedural' AND status = 'ativo') GROUP BY 1) SELECT note_id, CASE WHEN successors IS NULL THEN status ELSE 'deprecado' END AS status, successors AS superseded_by FROM notes LEFT JOIN dep USING (note_id)")
def deprecated_notes(spark: SparkSession, sf: str) -> DataFrame:
    """All notes after superseded procedures were deprecated."""
    n = tb.notes(spark, sf)
    return maintain.deprecate(n, maintain.deprecations(tb.citations(spark, sf), n)).select("note_id", "status", "superseded_by")


@query(f"WITH {_NOTES} SELECT note_id, CASE WHEN status <> 'ativo' THEN 'arquivado' ELSE status END AS status FROM notes")
def archived_notes(spark: SparkSession, sf: str) -> DataFrame:
    """All notes after those that are not live were archived."""
    n = tb.notes(spark, sf).select("note_id", "status")
    return maintain.set_status(n, n.where(~filters.live(F.col("status"))), "arquivado")


@query(f"WITH {_NOTES}, p AS (SELECT note_id, body, concat_ws(' | ', 'scope: ' || nullif(trim(scope), ''), 'title: ' || nullif(trim(title), '')) AS prefix FROM notes) SELECT note_id, sha256(CASE WHEN prefix = '' THEN body ELSE prefix || chr(10) || chr(10) || body END) AS hash FROM p")
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What is embedded of each note, by its digest."""
    prefix = tx.context_prefix(F.col("scope"), F.col("title"), _no_strings(), _no_strings())
    return tb.notes(spark, sf).select("note_id", index.content_hash(tx.embed_text(prefix, F.col("body"))).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderdate::DATE END AS day FROM orders", dates=("day",))
def dates_read(spark: SparkSession, sf: str) -> DataFrame:
    """Dates out of strings: with a time, with blanks, and none."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    text = F.when(k % 3 == 0, F.concat(day, F.lit("T10:00:00Z"))).when(k % 3 == 1, "soon").otherwise(F.concat(F.lit("  "), day, F.lit(" ")))
    return tb.table(spark, sf, "orders").select("o_orderkey", dx.as_date(text).alias("day"))


@query("SELECT vec_id AS id, [round(x / sqrt(list_dot_product(e, e)), 6) for x in e] AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vectors_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as they are stored: checked and scaled."""
    v = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vx.doubles(F.col("embedding")).alias("embedding"))
    return vector.validated(v, 64).select("id", vx.rounded(F.col("embedding"), 6).alias("unit"))
