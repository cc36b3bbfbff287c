"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by the hash of their text.  The
smallest capacity for which a greedy left-to-right fill needs at most
``n_shards`` shards is found by binary search, and the order is cut there.

The groups are never gathered.  The hash range is summed in intervals (radix
prefixes), a bounded histogram that the driver may hold.  It bounds the best
capacity from both sides; only intervals in which a cut can fall for a capacity
between the bounds are split further, until every one of those is one group.
The binary search over that histogram then gives the exact answer.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from .workspace import column_of, cut, free_name

#: Prefix bits of the first histogram, and of each refinement.
FIRST_BITS, MORE_BITS = 12, 4
#: Rows of one shard are numbered in this many independent runs.
RUNS = 1024


def greedy_cuts(sums: list[int], capacity: int, most: int) -> list[int] | None:
    """First positions of a greedy fill's shards; None if ``most`` shards of ``capacity`` are not enough.

    ``sums`` are the prefix sums of the sizes, from 0.
    """
    starts, at = [], 0
    while at < len(sums) - 1:
        if len(starts) == most:
            return None
        starts.append(at)
        after = bisect_right(sums, sums[at] + capacity) - 1
        if after == at:
            return None
        at = after
    return starts


def smallest_capacity(sums: list[int], most: int) -> int:
    """Binary search for the least capacity that ``greedy_cuts`` can do with."""
    low, high = -(-sums[-1] // most), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sums, mid, most) is None:
            low = mid + 1
        else:
            high = mid
    return low


@dataclass(frozen=True)
class Interval:
    """Keys that share their first ``bits`` bits."""

    prefix: int
    bits: int
    size: int
    single: bool
    largest: int

    @property
    def first_key(self) -> int:
        return self.prefix << (64 - self.bits)


def _to_split(parts: list[Interval], n_shards: int) -> list[Interval]:
    """The intervals in which a cut can fall at some capacity that may be the best one."""
    sums = [0, *accumulate(p.size for p in parts)]
    low = max(-(-sums[-1] // n_shards), *(p.largest for p in parts))
    if large := [p for p in parts if not p.single and p.size > low // 16]:
        return large
    high = smallest_capacity(sums, n_shards)
    # Greedy fills end later if they start later or have more room, so the least
    # capacity, cutting before an interval, and the most, cutting within it, bound every cut.
    windows, least, most = [], 0, 0
    while least < len(parts) and most < sums[-1]:
        least = max(least, bisect_right(sums, sums[least] + low) - 1)
        most = min(most + high, sums[-1])
        inside = min(bisect_right(sums, most) - 1, len(parts) - 1)
        if parts[inside].single and most < sums[-1]:
            most = sums[inside]
        windows.append((bisect_right(sums, sums[least]) - 1, inside))
    wanted = {i for a, b in windows for i in range(a, b + 1) if i < len(parts) and not parts[i].single}
    return [parts[i] for i in sorted(wanted)]


def balanced_cuts(units: DataFrame, n_shards: int) -> list[int]:
    """First keys (unsigned) of the shards after the first, for ``units`` (key long, size), a row for each key."""

    def summed(rows: DataFrame, bits: int) -> list[Interval]:
        sums = rows.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest"))
        return [Interval(r["prefix"] % (1 << bits), bits, r["size"], r["n"] == 1, r["largest"]) for r in sums.collect()]

    parts = summed(units, FIRST_BITS)
    while parts and (split := _to_split(parts, n_shards)):
        gone = set(split)
        parts = [p for p in parts if p not in gone]
        for bits in {p.bits for p in split}:
            prefixes = F.array(*[F.lit(p.prefix - (1 << 64 if p.prefix >> 63 else 0)) for p in split if p.bits == bits]).cast("array<long>")
            at = units.sparkSession.range(1).select(F.explode(prefixes).alias("at"))
            parts += summed(units.join(F.broadcast(at), F.shiftrightunsigned("key", 64 - bits) == F.col("at"), "left_semi"), min(64, bits + MORE_BITS))
        parts.sort(key=lambda p: p.first_key)
    if not parts:
        return []
    parts.sort(key=lambda p: p.first_key)
    sums = [0, *accumulate(p.size for p in parts)]
    return [parts[i].first_key for i in greedy_cuts(sums, smallest_capacity(sums, n_shards), n_shards)[1:]]


def shard(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Every row of ``docs`` with its shard and slot; sizes of shards are near equal (law ``bytes``).

    Adds size (UTF-8 bytes of text plus 16; null text counts as none),
    text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard
    (always null: this law makes no promise about growth).  A column of ``docs``
    with one of these names is replaced.  Equal texts share a shard, null texts
    too.  Rows equal in doc_id and text are interchangeable in the numbering.
    With fewer groups than shards some shards stay empty.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    kept = [column_of(c) for c in docs.columns if c.lower() not in added]
    key, run = free_name(docs, "_key"), free_name(docs, "_run")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*kept, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias(key))
    units = cut(rows.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("size")))
    cuts = balanced_cuts(units, n_shards)
    # Unsigned order of the hash: flip the sign bit to compare as signed longs.
    signed = [c - (1 << 63) for c in cuts]
    flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
    number = F.size(F.filter(F.array(*map(F.lit, signed)).cast("array<long>"), lambda c: c <= flipped)) if signed else F.lit(0)
    rows = rows.withColumn("shard", number.cast("int")).withColumn(run, F.pmod(F.xxhash64("doc_id", key), F.lit(RUNS)).cast("int"))
    counts = rows.groupBy("shard", run).agg(F.count("*").alias("_n"))
    before = counts.select("shard", run, (F.sum("_n").over(Window.partitionBy("shard").orderBy(run)) - F.col("_n")).alias("slot"))
    in_run = Window.partitionBy("shard", run).orderBy("doc_id", key)
    out = rows.join(before, ["shard", run]).withColumn("slot", (F.col("slot") + F.row_number().over(in_run) - 1).cast("long"))
    return out.select(*kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
