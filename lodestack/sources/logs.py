"""JSON-lines logs: access and action logs are read tolerantly, link files strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import ACCESS, LINKS


def parse_access(lines: DataFrame) -> DataFrame:
    """(value) -> ts, kind, ids; torn or foreign lines are skipped."""
    rows = lines.select(F.from_json("value", ACCESS).alias("r")).select("r.*")
    return rows.where("ts is not null and ids is not null")


def read_access(spark: SparkSession, path: str) -> DataFrame:
    return parse_access(spark.read.text(path))


def write_access(records: DataFrame, path: str) -> None:
    """Append (ts, kind, ids) as JSON lines."""
    records.select("ts", "kind", "ids").write.mode("append").json(path)


def parse_actions(lines: DataFrame) -> DataFrame:
    """(value) -> ts, action, record (VARIANT with all fields); bad lines are skipped."""
    rows = lines.select(F.try_parse_json("value").alias("record"), *[c for c in lines.columns if c == "line"])
    rows = rows.select(F.try_variant_get("record", "$.ts", "string").alias("ts"), F.try_variant_get("record", "$.action", "string").alias("action"), "record", *[c for c in lines.columns if c == "line"])
    return rows.where("ts is not null and action is not null")


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """``parse_actions`` of the files at ``path``, with ``line``: the order of the lines in the files by name."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line"))
    return parse_actions(lines)


def tail_actions(actions: DataFrame, n: int) -> DataFrame:
    """The last n actions: by their lines, where ``read_actions`` gave these, else by time and then as written."""
    order = ["line"] if "line" in actions.columns else ["ts", "action", F.to_json("record")]
    return actions.orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order]).limit(max(n, 0))


def parse_links(lines: DataFrame) -> DataFrame:
    """(value) -> source, target, relation, created, agent; a line that is no link record fails the job."""
    record = F.from_json("value", LINKS)
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(x.split()[0]) for x in LINKS.split(", ")]))
    fine = (F.size(extra) == 0) & record["a"].isNotNull() & record["b"].isNotNull()
    checked = F.when(F.coalesce(fine, F.lit(False)), record).otherwise(F.raise_error(F.concat(F.lit("not a link record: "), "value")))
    rows = lines.where(F.trim("value") != "").select(checked.alias("r"))
    return rows.select(F.col("r.a").alias("source"), F.col("r.b").alias("target"), F.coalesce("r.relation", F.lit("related")).alias("relation"), "r.created", "r.agent")
