"""Mixing sources to target weights by capped water-filling.

A mix shares the corpus' total size among sources by weight, but no source may
be used for more than ``max_epochs`` passes.  Sources that would exceed that are
clamped at their cap and what they leave over is shared again among the others,
by weight, until nobody is above.  Each source's target is then met by whole
passes over all of its documents plus one seeded fractional pass.

Scale: one pass counts words; everything after works on (source, size, hash)
rows.  Only per-source and per-(source, hash bucket) aggregates meet in one
task, never the documents of a source, so one source may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .workspace import column_of, cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
_BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    """Words of ``text`` as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the cycle is dealt to sources by code point, null last.

    The global rank is a range-partitioned sort plus per-partition offsets; the
    only single-task step sees one row per partition.
    """
    placed = cut(sources.select("source").distinct().repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last()))
    rank = placed.withColumn("_r", within).join(F.broadcast(offsets), "_p").withColumn("_r", F.col("_r") + F.col("_before") - 1)
    return rank.select("source", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_r") % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(sizes: DataFrame, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) -> the same plus target.

    Each round is one small aggregate: what the clamped sources use up leaves a
    smaller rest for the open ones, whose level (size per unit of weight) can
    only rise, so a clamped source stays clamped and the loop ends.
    A total of zero gives targets of zero.
    """
    rows = sizes.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        used, weight, n = rows.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == clamped or not weight:
            break
        level, clamped = (total - (used or 0.0)) / weight, n
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)).cast("double")).drop("cap")


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Per document, how often the mix takes it.

    ``docs`` needs doc_id, text and source; other columns are ignored.
    ``weights`` is (source, weight); by default 5, 2, 1 dealt by code point.
    Returns doc_id, source, unit (the content hash that identifies a row), size,
    source_size, target, copies and taken = size * copies.

    Whole passes: floor(target / source_size) copies of everything.  Fractional
    pass: documents in seeded hash order while they fit; the gap that the first
    misfit leaves is filled greedily, largest first, with the lowest-hashed
    document of each quarter-octave size class.  Rows with equal doc_id and text
    share a hash and are taken together.  Null text has size 0, a null source is
    a source, an empty table gives no rows; a document of size 0 gets the whole
    passes only.  The result depends on content and seed alone.
    """
    unit = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = cut(docs.select("doc_id", "source", unit.alias("unit"), word_count(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = ranked_weights(sizes) if weights is None else weights
    sizes = sizes.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    targets = cut(water_fill(cut(sizes.fillna({"weight": 0.0})), max_epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(F.lit(0)).cast("long")
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target", whole.alias("whole"), F.round(F.col("target") - whole * F.col("source_size")).cast("long").alias("part"))
    same_source = F.col("source").eqNullSafe(F.col("_s"))

    # The source's prefix sums by hash bucket give the bucket where the part ends.
    bucket = F.shiftrightunsigned("unit", 64 - _BUCKET_BITS)
    ordered = Window.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(ordered) - F.col("in_bucket")).join(targets, same_source).where((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("in_bucket")))
    edge = sums.select("_s", F.col("bucket").alias("_b"), "before", "part")
    # Within that bucket, the last hash that still fits.
    units = rows.withColumn("bucket", bucket).join(edge, same_source & (F.col("bucket") == F.col("_b"))).groupBy("source", "unit", "before", "part").agg(F.sum("size").alias("size"))
    order_key = F.expr(f"unit & {(1 << (64 - _BUCKET_BITS)) - 1}")
    units = units.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy(order_key)))
    fits = F.col("upto") <= F.col("part")
    last = units.groupBy("source").agg(F.max(F.when(fits, order_key)).alias("last"), (F.first("part") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before"))).alias("gap"))
    cuts = targets.join(edge.select(F.col("_s").alias("_e"), "_b"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e")
    cuts = cut(cuts.join(last, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source"))
    first_pass = rows.withColumn("bucket", bucket).join(cuts, same_source).drop("_s")
    # No bucket holds the end: the part is the whole source (or nothing, at part 0).
    chosen = F.when(F.col("_b").isNull(), F.col("part") >= F.col("source_size")).otherwise((F.col("bucket") < F.col("_b")) | ((F.col("bucket") == F.col("_b")) & (order_key <= F.coalesce(F.col("last"), F.lit(-1)))))
    first_pass = first_pass.withColumn("chosen", chosen & (F.col("part") > 0) & (F.col("size") > 0)).drop("bucket", "_b", "last")

    # The rest of the gap: one document for each size class, greedily from the largest.
    spare = first_pass.where(~F.col("chosen") & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))).groupBy("source", "unit", "gap").agg(F.sum("size").alias("size")).where("size <= gap")
    best = spare.groupBy("source", "gap", F.floor(F.log2("size") * 4).alias("class")).agg(F.min(F.struct("unit", "size")).alias("pick"))
    picks = best.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct(F.col("pick.size"), F.col("pick.unit"))), asc=False).alias("picks"))
    start = F.struct(F.col("gap").alias("left"), F.expr("array()").cast("array<long>").alias("units"))
    filled = F.aggregate("picks", start, lambda acc, p: F.when(p["size"] <= acc["left"], F.struct((acc["left"] - p["size"]).alias("left"), F.array_append(acc["units"], p["unit"]).alias("units"))).otherwise(acc))
    extra = picks.select(F.col("source").alias("_s"), F.explode(filled["units"]).alias("_u"))
    out = first_pass.join(extra, same_source & (F.col("unit") == F.col("_u")), "left")
    copies = F.col("whole") + F.when(F.col("chosen") | F.col("_u").isNotNull(), 1).otherwise(0)
    return out.select("doc_id", "source", "unit", "size", "source_size", "target", copies.cast("int").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of ``docs`` repeated as ``plan_mix`` says, with its own columns."""
    plan = plan_mix(docs, weights, max_epochs, seed).where("copies > 0")
    key, unit, source, copies, copy = (free_name(docs, x) for x in ("_key", "_unit", "_from", "_copies", "_copy"))
    plan = plan.groupBy(F.col("unit").alias(unit), F.col("source").alias(source)).agg(F.max("copies").alias(copies))
    keyed = docs.withColumn(key, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")))
    taken = keyed.join(plan, (F.col(key) == F.col(unit)) & F.col("source").eqNullSafe(F.col(source)))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*map(column_of, docs.columns))
