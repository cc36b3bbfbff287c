"""Lifecycle of notes: access stamps, decay, deprecation, staleness, dead citations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from .filters import live

MEMORY_TYPES = ("semantic", "procedural")


def last_seen(access: DataFrame) -> DataFrame:
    """note_id and UTC date of its latest access, from (ts, ids); malformed records are skipped."""
    seen = access.select(F.try_to_timestamp(F.col("ts").cast("string")).alias("at"), F.explode("ids").alias("note_id"))
    return seen.where("at is not null").groupBy("note_id").agg(F.to_date(F.max("at")).alias("seen"))


def stamp(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """``notes`` with last_accessed moved forward, never back, and whether it moved."""
    joined = notes.join(seen, "note_id", "left")
    newer = F.col("seen").isNotNull() & (F.col("last_accessed").isNull() | (F.col("seen") > F.col("last_accessed")))
    return joined.withColumn("stamped", newer).withColumn("last_accessed", F.when(newer, F.col("seen")).otherwise(F.col("last_accessed"))).drop("seen")


def is_active(status: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("ativo")) == "ativo"


def reference_date() -> Column:
    return F.coalesce("last_accessed", "modified", "created")


def decayed(notes: DataFrame, today: dt.date, decay_days: int, deprecated: DataFrame | None = None) -> DataFrame:
    """note_id, type, scope, last_reference of active notes unread for more than ``decay_days``.

    Notes without any date and those about to be deprecated are left alone.
    """
    rows = notes.where(is_active(F.col("status")) & (F.date_diff(F.lit(today), reference_date()) > decay_days))
    if deprecated is not None:
        rows = rows.join(deprecated, "note_id", "left_anti")
    return rows.select("note_id", "type", "scope", reference_date().alias("last_reference"))


def deprecations(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id and sorted successors of active procedural notes that another note supersedes."""
    old = notes.where(is_active(F.col("status")) & (F.col("type") == "procedural")).select("note_id")
    named = edges.where("relation = 'supersedes'").groupBy(F.col("target").alias("note_id")).agg(F.sort_array(F.collect_set("source")).alias("successors"))
    return named.join(old, "note_id", "left_semi")


def stale(notes: DataFrame, today: dt.date, stale_days: int, excluded: DataFrame | None = None) -> DataFrame:
    """note_id, scope, last_tested, days_stale of active procedural notes not tested for more than ``stale_days``; 0 turns it off."""
    days = F.date_diff(F.lit(today), F.coalesce("last_tested", "created"))
    rows = notes.where(is_active(F.col("status")) & (F.col("type") == "procedural") & (days > stale_days) & F.lit(stale_days > 0))
    if excluded is not None:
        rows = rows.join(excluded, "note_id", "left_anti")
    return rows.select("note_id", "scope", "last_tested", days.alias("days_stale"))


def longest_untested(found: DataFrame) -> DataFrame:
    """What ``stale`` returns in the order of a report: the longest untested first, then by note_id."""
    return found.orderBy(F.desc("days_stale"), "note_id")


def dead_notes(notes: DataFrame) -> DataFrame:
    """note_id, state, successor of notes no longer alive; archived with a successor counts as superseded."""
    first = F.get("superseded_by", F.lit(0)) if "superseded_by" in notes.columns else F.lit(None).cast("string")
    state = F.when(F.col("status") == "deprecado", "deprecado").when(first.isNotNull(), "superseded").otherwise("arquivado")
    return notes.where(~live(F.col("status"))).select("note_id", state.alias("state"), first.alias("successor"))


def dead_citations(edges: DataFrame, documents: DataFrame, dead: DataFrame) -> DataFrame:
    """doc, cited, state, successor for each read-only document (note_id) that links to a dead note, once."""
    cited = edges.join(documents.select(F.col("note_id").alias("source")), "source", "left_semi").select(F.col("source").alias("doc"), F.col("target").alias("cited")).distinct()
    return cited.join(dead.withColumnRenamed("note_id", "cited"), "cited").select("doc", "cited", "state", "successor")


def set_status(notes: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """``notes`` with a new status for the note_ids of ``ids``."""
    marks = ids.select("note_id").distinct().withColumn("_hit", F.lit(True))
    return notes.join(marks, "note_id", "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def deprecate(notes: DataFrame, found: DataFrame) -> DataFrame:
    """``notes`` with the found ones deprecated and linked to their successors."""
    joined = notes.drop("superseded_by").join(found, "note_id", "left")
    hit = F.col("successors").isNotNull()
    return joined.withColumn("status", F.when(hit, "deprecado").otherwise(F.col("status"))).withColumn("superseded_by", F.col("successors")).drop("successors")


def supersede_plan(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """note_id and what superseding it does: archive, missing, or keep (episodic notes are history)."""
    found = targets.join(notes.select("note_id", "type"), "note_id", "left")
    return found.select("note_id", F.when(F.col("type").isNull(), "missing").when(F.col("type") == "episodic", "keep").otherwise("archive").alias("action"))


def active_scopes(notes: DataFrame, seen: DataFrame) -> DataFrame:
    """scope and the latest access to any of its notes."""
    return notes.join(seen, "note_id").groupBy("scope").agg(F.max("seen").alias("latest"))


#: Memory types in their order, and the folders that stand for them.
TYPE_FOLDERS = {"episodic": "Episodic", "semantic": "Semantic", "procedural": "Procedural", "research": "Research"}


def type_of(folders: Column, tags: Column, rule: str, root: str | None = None) -> Column:
    """A note's type from its folder names (nearest last, case counts) and mem/ tags.

    ``tag_first`` takes the tag, then the nearer of the two nearest folders;
    ``folder_first`` the first type, in their order, that any folder stands for, then the
    tag; ``folder_only`` the folder right below ``root``, or the topmost one.
    """
    kinds = F.array(*map(F.lit, TYPE_FOLDERS))
    known = F.create_map(*[F.lit(x) for kind, folder in TYPE_FOLDERS.items() for x in (folder, kind)])
    by_tag = F.get(F.filter(kinds, lambda k: F.array_contains(tags, F.concat(F.lit("mem/"), k))), F.lit(0))
    stands_for = lambda f: F.when(f.isNotNull(), F.element_at(known, f))
    if rule == "tag_first":
        n = F.size(folders)
        return F.coalesce(by_tag, stands_for(F.get(folders, n - 1)), stands_for(F.get(folders, n - 2)))
    if rule == "folder_first":
        return F.coalesce(F.get(F.filter(kinds, lambda k: F.array_contains(F.transform(folders, stands_for), k)), F.lit(0)), by_tag)
    if rule == "folder_only":
        place = F.lit(0) if root is None else F.nullif(F.array_position(folders, F.lit(root)), F.lit(0)).cast("int")
        return stands_for(F.get(folders, place))
    raise ValueError(f"unknown rule {rule!r}")


