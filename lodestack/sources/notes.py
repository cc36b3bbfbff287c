"""Markdown notes as a table, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..workspace import cut

HEAD = r"(?s)^---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|$)"
_FIELDS = ("scope", "status", "confidence", "title", "agent", "profile", "source", "created", "modified", "last_accessed", "last_tested")
_LISTS = ("tags", "supersedes", "evidence")


def list_files(spark: SparkSession, folder: str, dot_folders: bool = True) -> DataFrame:
    """path, mtime, size of the Markdown files below ``folder``; contents are not read.

    Dot files are left out, and with ``dot_folders=False`` everything in a dot folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(~F.col("path").rlike(r"/\.[^/]*$"))
    return rows if dot_folders else rows.where(~F.col("path").rlike(r"/\.[^/]+/"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the Markdown files below ``folder``; byte order marks and CRLF are normalised."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r\n?", "\n")
    return files.select(F.col("_metadata.file_path").alias("path"), text.alias("text")).where(~F.col("path").rlike(r"/\.[^/]*$"))


def decoded(content: Column) -> Column:
    """A file's bytes as text without byte order mark, lines ended by LF; bytes that are no UTF-8 are replaced."""
    return F.regexp_replace(F.regexp_replace(F.decode(content, "utf-8"), "^\ufeff", ""), r"\r\n?", "\n")


def split_head(text: Column) -> tuple[Column, Column]:
    """(front matter or null, body); a head that is not closed is body."""
    has = text.rlike(HEAD)
    return F.when(has, F.regexp_extract(text, HEAD, 1)), F.when(has, F.regexp_replace(text, HEAD, "")).otherwise(text)


def _parse(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    for batch in heads:
        rows = []
        for head in batch:
            try:
                value = yaml.safe_load(head) if head else {}
                rows.append((json.dumps(value or {}, default=str), not isinstance(value or {}, dict)))
            except yaml.YAMLError:
                rows.append((None, True))
        yield pd.DataFrame(rows, columns=["json", "malformed"])


def parse_notes(files: DataFrame) -> DataFrame:
    """(path, text) -> a row for each note with its front matter in columns.

    note_id is the file's name; ``folders`` are the names above it.  Text fields are
    strings, tags, supersedes and evidence arrays (a bare value is an array of one, a
    tag string is split at commas, leading hash signs go); ``keys`` are the keys of
    the front matter, which is also there whole as ``frontmatter`` (VARIANT).  YAML
    that cannot be read, or is no mapping, gives ``malformed``.
    """
    head, body = split_head(F.col("text"))
    parse = F.pandas_udf(_parse, "json string, malformed boolean")
    rows = files.select("path", body.alias("body"), parse(F.coalesce(head, F.lit(""))).alias("y")).select("path", "body", "y.malformed", F.when(~F.col("y.malformed"), F.col("y.json")).alias("json"))
    parts = F.split("path", "/")

    def listed(name: str) -> Column:
        raw = F.get_json_object("json", f"$.{name}")
        bare = F.split(raw, ",") if name == "tags" else F.array(raw)
        # a wikilink opens like an array too
        many = F.when(raw.rlike(r"^\[(?!\[)"), F.coalesce(F.from_json(raw, "array<string>"), bare)).otherwise(bare)
        items = F.transform(many, lambda x: F.regexp_replace(F.trim(x), "^#+", "") if name == "tags" else F.trim(x))
        return F.coalesce(F.when(raw.isNotNull(), F.filter(items, lambda x: x != "")), F.array().cast("array<string>"))

    fields = [F.get_json_object("json", f"$.{n}").alias(n) for n in _FIELDS]
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>")).alias("keys")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")
    return rows.select(name.alias("note_id"), "path", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folders"), *fields, *[listed(n).alias(n) for n in _LISTS], keys, F.try_parse_json("json").alias("frontmatter"), "malformed", "body")


#: Words that YAML reads as something else than text.
_WORDS = "null|true|false|yes|no|on|off|y|n|~"


def yaml_text(value: Column) -> Column:
    """Text as YAML: bare where that is safe, else quoted."""
    text = value.cast("string")
    bare = text.rlike(r"^[\p{L}_/][\p{L}\p{N}_/., ()+-]*$") & ~text.rlike(rf"(?i)^({_WORDS})$") & ~text.rlike(r"\s$")
    return F.when(bare | text.isNull(), text).otherwise(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1))


def yaml_value(value: Column, kind: str) -> Column:
    """A column of type ``kind`` as YAML on one line; null stays null."""
    if kind.startswith("array"):
        return F.when(value.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.regexp_extract(F.to_json(F.array(x.cast("string"))), r"(?s)^\[(.*)\]$", 1)), ", "), F.lit("]")))
    return yaml_text(value) if kind == "string" else value.cast("string")


def rendered(notes: DataFrame, fields: list[str]) -> Column:
    """A note's file: the fields that are not null as front matter, in that order, and ``body`` with one newline at its end."""
    kinds = dict(notes.dtypes)
    lines = [F.concat(F.lit(f"{c}: "), yaml_value(F.col(c), kinds[c])) for c in fields]
    head = F.concat_ws("\n", *lines)
    body = F.concat(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+|\n+$", ""), F.lit("\n"))
    return F.when(head == "", body).otherwise(F.concat(F.lit("---\n"), head, F.lit("\n---\n"), body))


def patched(text: Column, fields: dict[str, Column]) -> Column:
    """``text`` with fields of its front matter set; nothing else of the file changes.

    Values are YAML on one line (``yaml_value``); a null one leaves its field alone.  A
    field that is not there goes to the end of the head, a head that is not there is made.
    A key's further lines, indented or of a list, go with it.
    """
    for key, value in fields.items():
        line = F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
        head, body = split_head(text)
        own = rf"(?m)^{key}[ \t]*:.*\n(?:(?:[ \t]+.*|-[ \t].*|[ \t]*)\n)*"
        inner = F.coalesce(head, F.lit(""))
        set_ = F.when(inner.rlike(own), F.regexp_replace(inner, F.lit(own), F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))).otherwise(F.concat(inner, line))
        text = F.when(value.isNull(), text).otherwise(F.concat(F.lit("---\n"), set_, F.lit("---\n"), body))
    return text


def render_note(fields: dict, body: str) -> str:
    """Front matter in the given order and the body, with one newline at the end."""
    import yaml

    head = yaml.safe_dump(fields, sort_keys=False, allow_unicode=True) if fields else ""
    return (f"---\n{head}---\n" if head else "") + body.strip("\n") + "\n"


def _running(rows: DataFrame, by: str, run: Column, order: list[str], what: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``what`` over the rows of ``by`` up to and with each, in the order of ``run`` and then ``order``.

    Runs are summed first and rows within their run, so that a hot ``by`` does not meet in one task.
    """
    rows = rows.withColumn("_run", run).withColumn("_what", what)
    sums = rows.groupBy(by, "_run").agg(F.sum("_what").alias("_sum"))
    before = sums.select(by, "_run", (F.sum("_sum").over(Window.partitionBy(by).orderBy("_run")) - F.col("_sum")).alias("_before"))
    upto = Window.partitionBy(by, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(before, [by, "_run"]).withColumn(name, F.col("_before") + F.sum("_what").over(upto)).drop("_before", "_run", "_what")


def file_names(notes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``notes`` (note_id, name wanted in ``name``) with unique file names: -2, -3 … behind a name that is in use.

    ``taken`` (name) are names in use before.  The first note of a name that is free
    gets it; the others of that name get the numbers from 2 on that neither a taken
    nor a wanted name has (``a-2`` may be either).  Numbered names of unlike names are
    unlike, as the last number tells them apart, so these are all that can be in use.
    Rows with one note_id are notes of their own; a null or empty name is ``nota``.
    """
    own = notes.columns
    # rows are known by a number, which is fixed by writing them out
    order = ["note_id", "_row"]
    notes = cut(notes.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("nota"))).withColumn("_row", F.monotonically_increasing_id()))
    notes = cut(notes.repartitionByRange("name", *order).withColumn("_part", F.spark_partition_id()))
    rows = _running(notes, "name", F.col("_part"), order, F.lit(1), "_k")
    wanted = notes.select("name").distinct()
    if taken is None:
        used, rows = wanted, rows.withColumn("_free", F.lit(True))
    else:
        used = wanted.union(taken.select("name")).distinct()
        rows = rows.join(taken.select("name").distinct().withColumn("_taken", F.lit(True)), "name", "left").withColumn("_free", F.col("_taken").isNull()).drop("_taken")
    # numbers in use behind a name, and how many free ones lie below each
    parts = used.select(F.regexp_extract("name", r"(?s)^(.*)-([1-9][0-9]{0,17})$", 1).alias("base"), F.regexp_extract("name", r"(?s)^(.*)-([1-9][0-9]{0,17})$", 2).try_cast("long").alias("n")).where("n >= 2")
    run = F.floor(F.col("n") / 65536)
    below = _running(parts, "base", run, ["n"], F.lit(1), "_j").select(F.col("base").alias("name"), (F.col("n") - 1 - F.col("_j")).alias("place"), F.lit(0).alias("is_note"), F.lit(None).cast("long").alias("_row"))
    plain = F.col("_free") & (F.col("_k") == 1)
    place = F.col("_k") - 1 - F.col("_free").cast("long")
    waiting = rows.where(~plain).select("name", place.alias("place"), F.lit(1).alias("is_note"), "_row")
    both = _running(below.unionByName(waiting), "name", F.floor(F.col("place") / 65536), ["place", "is_note", "_row"], 1 - F.col("is_note"), "_skipped")
    numbers = both.where("is_note = 1").select("_row", (2 + F.col("place") + F.col("_skipped")).alias("_n"))
    out = rows.join(numbers, "_row", "left")
    return out.withColumn("file", F.concat(F.concat_ws("-", "name", F.col("_n").cast("string")), F.lit(".md"))).select(*own, "file")
