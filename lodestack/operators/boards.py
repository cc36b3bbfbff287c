"""Rollups: hot boards, index maps, counts, feeds, pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from .filters import live
from .maintain import is_active
from ..workspace import fresh_path

HOT_ENTRIES, SHARD_LINES, PAGE = 15, 200, 30
_PREFIX = {"semantic": "INS", "procedural": "PROC"}


def hot_board(notes: DataFrame, today: dt.date | None = None, hot_days: int = 0, most: int = HOT_ENTRIES) -> DataFrame:
    """scope, rank, note_id, title, recency, more: each scope's latest live knowledge.

    Ties go to the later title and id.  ``more`` is how many notes of the scope are
    not shown.  With ``hot_days`` only notes touched since then count.
    """
    recency = F.coalesce("last_accessed", "modified", "created")
    rows = notes.where(live(F.col("status")) & F.col("type").isin(*_PREFIX)).withColumn("recency", recency)
    if hot_days and today:
        rows = rows.where(F.col("recency") >= F.lit(today - dt.timedelta(days=hot_days)))
    by_scope = Window.partitionBy("scope")
    rank = F.row_number().over(by_scope.orderBy(F.desc_nulls_last("recency"), F.desc(F.lower("title")), F.desc("note_id")))
    shown = rows.select("scope", "note_id", "title", "recency").withColumn("rank", rank).where(F.col("rank") <= most)
    sizes = rows.groupBy("scope").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return shown.join(sizes, "scope")


def hot_scopes(board: DataFrame) -> DataFrame:
    """scope, latest of what ``hot_board`` returns, the most recently touched scope first, ties by name."""
    return board.groupBy("scope").agg(F.max("recency").alias("latest")).orderBy(F.desc_nulls_last("latest"), "scope")


def scope_order(scope: Column, known: list[str]) -> Column:
    """Sort key: known scopes in their order, others by name, global last."""
    place = F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), scope)
    return F.struct(F.when(scope == "global", 2).when(place > 0, 0).otherwise(1).alias("group"), place.alias("place"), scope.alias("name"))


def _map_entries(notes: DataFrame) -> DataFrame:
    """scope, t, i, line of live knowledge; t and i are what lines are ordered by."""
    rows = notes.where(is_active(F.col("status")) & F.col("type").isin(*_PREFIX))
    prefix = F.when(F.col("type") == "semantic", "INS").otherwise("PROC")
    tail = F.concat_ws(" · ", prefix, "agent", "confidence")
    line = F.concat(F.lit("- [["), F.col("note_id"), F.lit("]] — "), F.coalesce("title", F.lit("")), F.lit(" · "), tail)
    return rows.select("scope", F.lower("title").alias("t"), F.col("note_id").alias("i"), line.alias("line"))


def index_lines(notes: DataFrame) -> DataFrame:
    """scope, entry (from 1), line: the map of live knowledge as a row for each note, by title then id.

    Rows are cut into ranges of that order and written out; an entry's number is its
    place in its range and the scope's rows in the ranges before, so a scope may be of any size.
    """
    spark, path = notes.sparkSession, fresh_path(notes.sparkSession, "index-lines")
    _map_entries(notes).repartitionByRange("scope", "t", "i").withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("scope", "part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("scope").alias("_scope"), F.col("part").alias("_part"), (F.sum("n").over(Window.partitionBy("scope").orderBy("part")) - F.col("n")).alias("before"))
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("scope", "part").orderBy("t", "i")))
    joined = placed.join(before, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("part") == F.col("_part")))
    return joined.select("scope", (F.col("before") + F.col("at")).alias("entry"), "line")


def index_files(lines: DataFrame, known: list[str] | None = None, shard_lines: int = SHARD_LINES) -> DataFrame:
    """path, place, entry, line of the index, from what ``index_lines`` returns.

    One file, or one for each scope if it would be longer than ``shard_lines``.
    ``place`` sorts the scopes of a file: the known ones as listed, the others, global.
    """
    sizes = lines.groupBy("scope").agg((F.count("*") + 4).alias("n")).agg(F.sum("n").alias("n"))
    sharded = (F.col("n") > shard_lines) & (F.col("scope") != "global")
    path = F.when(sharded, F.concat(F.lit("indices/"), "scope", F.lit(".md"))).otherwise("index.md")
    return lines.join(F.broadcast(sizes)).select(path.alias("path"), scope_order(F.col("scope"), known or []).alias("place"), "entry", "line")


def index_map(notes: DataFrame) -> DataFrame:
    """scope, entries, lines: the map of live knowledge, a line for each note, by title then id.

    A scope's map is one row, as a file of it is one; ``index_lines`` has no such bound.
    """
    grouped = _map_entries(notes).groupBy("scope").agg(F.count("*").alias("entries"), F.sort_array(F.collect_list(F.struct("t", "i", "line"))).alias("e"))
    return grouped.select("scope", "entries", F.array_join("e.line", "\n").alias("lines"))


def index_documents(maps: DataFrame, shard_lines: int = SHARD_LINES, known: list[str] | None = None) -> DataFrame:
    """path, place, body: one index, or a file for each scope if it would be longer than ``shard_lines``.

    ``maps`` is what ``index_map`` returns: a row for each scope.  ``place`` puts the
    known scopes first, as listed, and global last.
    """
    total = maps.agg((F.sum(F.col("entries") + 4)).alias("n"))
    path = F.when((F.col("n") > shard_lines) & (F.col("scope") != "global"), F.concat(F.lit("indices/"), "scope", F.lit(".md"))).otherwise("index.md")
    return maps.join(F.broadcast(total)).select(path.alias("path"), scope_order(F.col("scope"), known or []).alias("place"), F.concat(F.lit("## "), "scope", F.lit("\n\n"), "lines").alias("body"))


def status_counts(notes: DataFrame) -> DataFrame:
    """axis, value, notes: counts by type, scope and status and in total, in one pass."""
    rows = notes.groupingSets([["type"], ["scope"], ["status"], []], "type", "scope", "status").agg(F.count("*").alias("notes"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "scope").when(F.col("g") == 6, "status").otherwise("total")
    return rows.select(axis.alias("axis"), F.coalesce("type", "scope", "status").alias("value"), "notes")


def activity_feed(*sources: DataFrame, most: int = 25) -> DataFrame:
    """The newest ``most`` of several (at, kind, what), ties by kind and what."""
    both = sources[0]
    for more in sources[1:]:
        both = both.unionByName(more)
    return both.orderBy(F.desc("at"), "kind", "what").limit(most)


def activity_stats(actions: DataFrame) -> DataFrame:
    """One row: accepted and rejected writes."""
    return actions.agg(F.count_if(F.col("action") == "write").alias("accepted"), F.count_if(F.col("action") == "reject").alias("rejected"))


def page(notes: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One page of notes, the latest first, ties by id."""
    return notes.orderBy(F.desc("created"), "note_id").offset(number * size).limit(size)


def count_active_types(notes: DataFrame) -> DataFrame:
    return notes.where(is_active(F.col("status"))).groupBy("type").agg(F.count("*").alias("notes"))


def distinct_scopes(notes: DataFrame) -> DataFrame:
    return notes.where(F.col("scope").isNotNull()).select("scope").distinct()


def proposals(notes: DataFrame) -> DataFrame:
    """status and count of notes that propose a change to a target."""
    return notes.where(F.col("target").isNotNull()).groupBy(F.coalesce("status", F.lit("pendente")).alias("status")).agg(F.count("*").alias("notes"))


def parse_board(lines: DataFrame) -> DataFrame:
    """section, item from (doc, line_no, text) of a rendered board: bullets under their latest heading."""
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.nullif(F.regexp_extract("text", r"^##+\s+(.*\S)\s*$", 1), F.lit(""))
    rows = lines.withColumn("section", F.last(heading, ignorenulls=True).over(order))
    return rows.where(F.col("text").rlike(r"^\s*[-*]\s+")).select("doc", "section", F.regexp_extract("text", r"^\s*[-*]\s+(.*\S)\s*$", 1).alias("item"))


def report_age(generated: Column, now: Column) -> Column:
    """Whole days since a report was made."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(generated)) / 86400).cast("long")


def month_days(notes: DataFrame, first: dt.date) -> DataFrame:
    """day, notes for every day of a month, zeros too."""
    frame = notes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.last_day(F.lit(first)))).alias("day"))
    counts = notes.where((F.col("created") >= F.lit(first)) & (F.col("created") <= F.last_day(F.lit(first)))).groupBy(F.col("created").alias("day")).agg(F.count("*").alias("notes"))
    return frame.join(counts, "day", "left").fillna({"notes": 0})
