"""Links between notes: extraction, resolution, bounded expansion, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIKILINK = r"!?\[\[([^\[\]\n]+)\]\]"


def strip_code(body: Column) -> Column:
    """Without fenced blocks (an open one runs to the end) and inline code."""
    fenced = F.regexp_replace(F.concat(F.lit("\n"), body), r"(?s)\n[ \t]*(```|~~~)[^\n]*(?:\n.*?(?:\n[ \t]*\1[^\n]*(?=\n|$)|$)|$)", "\n")
    return F.regexp_replace(fenced, r"`[^`\n]*`", " ")


def wikilinks(body: Column) -> Column:
    """Link targets in reading order, repeats kept; alias and heading are cut, links within the note left out."""
    raw = F.regexp_extract_all(strip_code(F.coalesce(body, F.lit(""))), F.lit(WIKILINK), F.lit(1))
    names = F.transform(raw, lambda t: F.trim(F.regexp_extract(t, r"^([^|#]*)", 1)))
    return F.filter(names, lambda t: t != "")


def normal_target(raw: Column) -> Column:
    """The id that a link target names: brackets, alias, heading, folders and ``.md`` removed."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^!?\[\[", ""), r"\]\]$", ""))
    text = F.trim(F.trim(F.regexp_extract(text, r"^([^|#]*)", 1)), F.lit("/"))
    return F.regexp_replace(F.element_at(F.split(text, "/"), -1), r"\.md$", "")


def winners(notes: DataFrame) -> DataFrame:
    """One row of each note_id, the first by path, with whether the id is ambiguous."""
    by_id = Window.partitionBy("note_id")
    ranked = notes.withColumn("_r", F.row_number().over(by_id.orderBy("path"))).withColumn("ambiguous", F.count("*").over(by_id) > 1)
    return ranked.where("_r = 1").drop("_r")


def authored(notes: DataFrame) -> DataFrame:
    """source, raw, relation, origin for every link that notes (note_id, body, supersedes) state."""
    body = notes.select(F.col("note_id").alias("source"), F.explode(wikilinks(F.col("body"))).alias("raw"), F.lit("wikilink").alias("relation"), F.lit("wikilink").alias("origin"))
    named = F.flatten(F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), lambda s: F.when(F.contains(s, F.lit("[[")), wikilinks(s)).otherwise(F.filter(F.array(F.trim(s)), lambda x: x != ""))))
    old = notes.select(F.col("note_id").alias("source"), F.explode(named).alias("raw"), F.lit("supersedes").alias("relation"), F.lit("supersedes").alias("origin"))
    return body.union(old)


def resolve(links: DataFrame, ids: DataFrame) -> DataFrame:
    """``links`` (source, raw, ...) with target: the id itself, else the only id equal but for case, else null.

    ``ids`` is (note_id, ambiguous).  Ids that collide in lower case, and ambiguous
    ones, are not found that way.
    """
    exact = ids.select(F.col("note_id").alias("_exact"))
    lower = ids.groupBy(F.lower("note_id").alias("_lower")).agg(F.min("note_id").alias("_other"), F.count("*").alias("_n"), F.max("ambiguous").alias("_a")).where("_n = 1 and not _a").drop("_n", "_a")
    named = links.withColumn("_name", normal_target(F.col("raw")))
    found = named.join(exact, F.col("_name") == F.col("_exact"), "left").join(lower, F.lower("_name") == F.col("_lower"), "left")
    return found.withColumn("target", F.coalesce("_exact", "_other")).drop("_name", "_exact", "_lower", "_other")


def split_links(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, dropped): each (source, target, relation, origin) once; links to nothing or to oneself with the reason."""
    broken, own = F.col("target").isNull(), F.col("target") == F.col("source")
    edges = resolved.where(~broken & ~own).select("source", "target", "relation", "origin").distinct()
    dropped = resolved.where(broken | own).select("source", "raw", "relation", F.when(broken, "broken").otherwise("self").alias("reason"))
    return edges, dropped


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: here, there, relation, origin."""
    one = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "relation", "origin")
    return one.union(one.select(F.col("there").alias("here"), F.col("here").alias("there"), "relation", "origin"))


def neighbours(edges: DataFrame) -> DataFrame:
    """note_id and the sorted ids that it is linked to either way."""
    return undirected(edges).groupBy(F.col("here").alias("note_id")).agg(F.sort_array(F.collect_set("there")).alias("neighbours"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int, most: int = 2) -> DataFrame:
    """note_id, seed, hops, path, relations for everything within ``hops`` links of the seeds (note_id).

    Shortest chains win, then the least path, then the least relation and origin
    along it.  Seeds have hops 0; those without any edge are kept.  Every hop is one
    join with the frontier and one minimum for each reached note, combined map-side.
    """
    if not 0 <= hops <= most:
        raise ValueError(f"hops must be between 0 and {most}")
    reached = seeds.select("note_id").distinct().select("note_id", F.lit(0).alias("hops"), F.array("note_id").alias("path"), F.array().cast("array<string>").alias("relations"))
    frontier, steps = reached, undirected(edges)
    for hop in range(1, hops + 1):
        chains = frontier.join(steps, F.col("note_id") == F.col("here")).select("there", F.struct(F.array_append("path", F.col("there")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"), "origin").alias("chain"))
        fresh = chains.join(reached.select(F.col("note_id").alias("there")), "there", "left_anti")
        frontier = fresh.groupBy("there").agg(F.min("chain").alias("c")).select(F.col("there").alias("note_id"), F.lit(hop).alias("hops"), "c.path", "c.relations")
        reached = reached.union(frontier)
    return reached.select("note_id", F.col("path")[0].alias("seed"), "hops", "path", "relations")


def via(path: Column) -> Column:
    """``[[a]] → [[b]]``."""
    return F.array_join(F.transform(path, lambda p: F.concat(F.lit("[["), p, F.lit("]]"))), " → ")


def health(ids: DataFrame, edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row: nodes, edges, broken, self_links, ambiguous."""
    nodes = ids.agg(F.count("*").alias("nodes"), F.count_if("ambiguous").alias("ambiguous"))
    lost = dropped.agg(F.count_if(F.col("reason") == "broken").alias("broken"), F.count_if(F.col("reason") == "self").alias("self_links"))
    return nodes.join(edges.agg(F.count("*").alias("edges"))).join(lost)


def ghosts(dropped: DataFrame) -> DataFrame:
    """Targets that no note has, most wanted first."""
    return dropped.where("reason = 'broken'").groupBy(normal_target(F.col("raw")).alias("target")).agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "target")


def hubs(edges: DataFrame, notes: DataFrame, top: int = 5) -> DataFrame:
    """type, note_id, degree of the notes with most edges in each type."""
    degree = undirected(edges).groupBy(F.col("here").alias("note_id")).agg(F.count("*").alias("degree")).join(notes.select("note_id", "type"), "note_id")
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("degree"), "note_id"))
    return degree.withColumn("_r", rank).where(F.col("_r") <= top).select("type", "note_id", "degree")


_LINK = ("source", "target", "relation", "origin")


def judged_links(existing: DataFrame, proposed: DataFrame, ids: DataFrame) -> DataFrame:
    """Proposed (source, target, relation, origin), each once, with ``reason``: blank, self, unknown, known, or null if it is new.

    Links are compared with nulls equal, so what was appended is never appended again.
    """
    rows = proposed.select(*_LINK).distinct()
    known = lambda name: ids.select(F.col("note_id").alias(name), F.lit(True).alias(f"{name}_ok")).distinct()
    there = existing.select(*[F.col(c).alias(f"_{c}") for c in _LINK], F.lit(True).alias("_there")).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _LINK]
    rows = rows.join(known("source"), "source", "left").join(known("target"), "target", "left").join(there, same, "left")
    blank = F.lit(False)
    for c in ("source", "target", "relation"):
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    reason = F.when(blank, "blank").when(F.col("source") == F.col("target"), "self").when(F.col("source_ok").isNull() | F.col("target_ok").isNull(), "unknown").when(F.col("_there"), "known")
    return rows.select(*_LINK, reason.alias("reason"))


def new_links(existing: DataFrame, proposed: DataFrame, ids: DataFrame) -> DataFrame:
    """Proposed (source, target, relation, origin) that are not there yet and join two different known notes."""
    return judged_links(existing, proposed, ids).where("reason is null").select(*_LINK)
