"""A Merkle manifest of a dataset, folded from retained hash states.

Rows become leaves (SHA-256 of their fields), leaves of one group a tree in which every
``FANOUT`` consecutive nodes have one parent, and the groups' roots a tree of their own.
A parent's hash state is copied before each child goes in and the copies are retained;
what a changed child does to the root is then found by resuming, level by level, the
state before its slot with the replacement and the siblings to its right.  What lies to
the left is never hashed again.

Spark numbers the nodes by range partitioning and offsets, without a window over a group,
and hashes ``DEPTH`` levels at a time: a task holds one subtree of ``SPAN`` leaves.
Digests only are shuffled, never texts.  Above the subtrees only their roots are left,
which go through the same steps again until each group has one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .workspace import small, slices, table

FANOUT, DEPTH = 8, 4
SPAN = FANOUT**DEPTH
#: Bytes of a digest as hex text.
_HEX = 64


def field(column: Column) -> Column:
    """A value as ``length:value`` in UTF-8 bytes, null as ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def group_key(column: Column) -> Column:
    """The group as text that sorts like it, null first and unlike every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, gapless from 0 in each ``by`` by ``order``, and ``size``, the rows of ``by``.

    Rows are sorted by range partitions; only counts of a (partition, ``by``) are summed up.
    Rows that tie are told apart by a number of their own, so they need not share a task.
    """
    rows = rows.withColumn("_seq", F.monotonically_increasing_id())
    rows = table(rows, "digests")
    keys = [by, *order, "_seq"]
    dealt = rows.repartitionByRange(slices(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = table(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "digests")
    counts = table(dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_least")), "digests")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("size", F.sum("_n").over(Window.partitionBy(by)))
    place = F.col("_at") - F.col("_least") + F.col("_before")
    return dealt.join(small(offsets.drop("_n")), [by, "_part"]).withColumn("place", place).drop("_seq", "_part", "_at", "_least", "_before")


def levels(size: int) -> int:
    """Levels above ``size`` nodes until one is left."""
    out = 0
    while size > 1:
        size, out = -(-size // FANOUT), out + 1
    return out


def _levels(size: Column) -> Column:
    """``levels`` for sizes of any long, as a column."""
    return sum((F.when(size > F.lit(FANOUT**k), 1).otherwise(0) for k in range(21)), F.lit(0))


class Subtree:
    """Some levels over up to ``SPAN`` digests, with each parent's states before its slots."""

    def __init__(self, digests: list[bytes], height: int) -> None:
        self.rows = [b"".join(digests)]
        self.states: list[list] = []
        for _ in range(height):
            below, made, states = self.rows[-1], [], []
            for first in range(0, len(below), FANOUT * _HEX):
                state = hashlib.sha256()
                for at in range(first, min(first + FANOUT * _HEX, len(below)), _HEX):
                    states.append(state.copy())
                    state.update(below[at : at + _HEX])
                made.append(state.hexdigest().encode())
            self.rows.append(b"".join(made))
            self.states.append(states)

    @property
    def root(self) -> bytes:
        return self.rows[-1]

    def siblings(self, place: int) -> list[tuple[bytes, bytes]]:
        """What lies left and right of a leaf's way up, level by level."""
        out = []
        for row in self.rows[:-1]:
            run = place // FANOUT * FANOUT * _HEX
            out.append((row[run : place * _HEX], row[(place + 1) * _HEX : run + FANOUT * _HEX]))
            place //= FANOUT
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """The root with another digest at ``place``."""
        for row, states in zip(self.rows, self.states, strict=False):
            state = states[place].copy()
            state.update(digest)
            state.update(row[(place + 1) * _HEX : (place // FANOUT + 1) * FANOUT * _HEX])
            digest, place = state.hexdigest().encode(), place // FANOUT
        return digest


class Above:
    """The way from a subtree's root to the last one: a retained state and the right siblings for each level."""

    def __init__(self, way: list[tuple[bytes, bytes]]) -> None:
        self.siblings = b"".join(left + right for left, right in way)
        self.steps = [(hashlib.sha256(left), right) for left, right in way]

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


_WAY = "array<struct<l:string,r:string>>"
_PA_WAY = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each (key, subtree) of batches sorted so, as lists; at most one subtree is held."""
    held: dict[str, list] = {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = list(zip(columns["key"], columns["subtree"], strict=True))
        first = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[first]:
                continue
            if held and (held["key"][0], held["subtree"][0]) != keys[first]:
                yield held
                held = {}
            for n, values in columns.items():
                held.setdefault(n, []).extend(values[first:i])
            first = i
    if held:
        yield held


def _raise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each subtree's root."""
    for rows in _subtrees(batches):
        tree = Subtree([d.encode() for d in rows["digest"]], rows["height"][0])
        yield pa.RecordBatch.from_pylist([{"key": rows["key"][0], "place": rows["subtree"][0], "digest": tree.root.decode()}])


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way up of each node, where that of its subtree's root stands in the subtree's first row."""
    for rows in _subtrees(batches):
        top, digests = rows["way"][0], [d.encode() for d in rows["digest"][1:]]
        tree = Subtree(digests, rows["height"][-1])
        ways = [[{"l": a.decode(), "r": b.decode()} for a, b in tree.siblings(i)] + top for i in range(len(digests))]
        yield pa.RecordBatch.from_arrays([pa.array(rows["key"][1:]), pa.array(rows["place"][1:], pa.int64()), pa.array(ways, _PA_WAY)], ["key", "place", "way"])


def _prover(carried: pa.Schema):
    """For each leaf the digest of its siblings and the root that its replacement leads to, behind its own columns."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _subtrees(batches):
            above = Above([(x["l"].encode(), x["r"].encode()) for x in rows["way"][0]])
            tree = Subtree([d.encode() for d in rows["digest"][1:]], rows["height"][-1])
            proofs, roots = [], []
            for i, digest in enumerate(rows["replacement"][1:]):
                proof = hashlib.sha256(b"".join(a + b for a, b in tree.siblings(i)))
                proof.update(above.siblings)
                proofs.append(proof.hexdigest())
                roots.append(above.fold(tree.fold(i, digest.encode())).decode())
            own = [pa.array(rows[f.name][1:], f.type) for f in carried]
            yield pa.RecordBatch.from_arrays([*own, pa.array(proofs, pa.string()), pa.array(roots, pa.string())], [*carried.names, "proof_sha256", "folded_root"])

    return prove


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their subtree, each subtree in one task and in order."""
    rows = rows.withColumn("subtree", F.floor(F.col("place") / SPAN))
    return rows.repartition(slices(rows.sparkSession), "key", "subtree").sortWithinPartitions("key", "subtree", "place")


@dataclass(frozen=True)
class Tree:
    """Nodes (key, place, digest, height, ...) of every ``DEPTH``-th level; the last table has one node, the root, for each key."""

    steps: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.steps[-1].select("key", "digest")


def build(nodes: DataFrame) -> Tree:
    """The tree over each key's ``nodes`` (key, place, digest, size; other columns stay with the leaves)."""
    # an actual table: it is read for the subtrees and again for the proofs
    leaves = table(nodes.withColumn("left", _levels(F.col("size"))).withColumn("height", F.least("left", F.lit(DEPTH))), "leaves")
    steps, now = [leaves], leaves
    rounds = -(-(leaves.agg(F.max("left")).first()[0] or 0) // DEPTH)
    for _ in range(rounds):
        sizes = now.where("place = 0").select("key", F.greatest(F.col("left") - DEPTH, F.lit(0)).alias("left"))
        raised = _dealt(now.select("key", "place", "digest", "height")).mapInArrow(_raise, "key string, place long, digest string")
        raised = raised.join(sizes, "key").withColumn("height", F.least("left", F.lit(DEPTH)))
        now = table(raised, "nodes")
        steps.append(now)
    return Tree(steps)


def _with_ways(nodes: DataFrame, ways: DataFrame, extra: list[str]) -> DataFrame:
    """Each subtree's nodes behind a row with the way of its root."""
    rows = nodes.select("key", F.floor(F.col("place") / SPAN).alias("subtree"), "place", "digest", "height", F.lit(None).cast(_WAY).alias("way"), *extra)
    tops = ways.select("key", F.col("place").alias("subtree"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), F.lit(0).alias("height"), "way", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in extra])
    return rows.unionByName(tops).repartition(slices(nodes.sparkSession), "key", "subtree").sortWithinPartitions("key", "subtree", "place")


def ways_down(tree: Tree, ways: DataFrame) -> DataFrame:
    """(key, place, way) of the roots of the lowest subtrees (of the leaves where they are roots), from those of the keys' roots."""
    now = ways.select("key", F.lit(0).cast("long").alias("place"), "way")
    for nodes in reversed(tree.steps[1:-1]):
        now = table(_with_ways(nodes, now, []).mapInArrow(_lower, f"key string, place long, way {_WAY}"), "ways")
    return now


@dataclass(frozen=True)
class Manifest:
    """A tree for each group of rows and one over the groups' roots."""

    groups: Tree
    top: Tree


def manifest(rows: DataFrame, by: str, order: list[str]) -> Manifest:
    """The manifest of ``rows`` (a ``leaf`` digest, the group key ``by`` of ``group_key``, others).

    Leaves of a group ascend by ``order`` and, in ties, by digest; equal rows are leaves of
    their own.  No rows make no trees.
    """
    leaves = numbered(rows.withColumnsRenamed({by: "key", "leaf": "digest"}), "key", [*order, "digest"])
    groups = build(leaves)
    roots = groups.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    return Manifest(groups, build(numbered(roots, "key", ["group"])))


def prove(m: Manifest, replacement: str | None = None) -> DataFrame:
    """The manifest's leaves (columns of ``rows``, ``key``, ``digest``) with subroot, root, proof_sha256 and folded_root.

    ``replacement`` names the column with the digest that takes the leaf's place (null: its
    own); ``proof_sha256`` hashes all siblings from the leaf to the root, level by level.
    """
    leaves = m.groups.steps[0]
    swapped = leaves.withColumn("replacement", F.coalesce(F.col(replacement), F.col("digest")) if replacement else F.col("digest"))
    # the groups' roots are leaves of the top tree
    top = m.top.steps[0]
    start = m.top.roots.select("key", F.array().cast(_WAY).alias("way"))
    above = _with_ways(top, ways_down(m.top, start), []).mapInArrow(_lower, f"key string, place long, way {_WAY}")
    of_group = above.select("place", "way").join(top.select("place", "group", "digest"), "place")
    of_group = table(of_group.select(F.col("group").alias("key"), "way", F.col("digest").alias("subroot")), "ways")
    carried = [c for c in leaves.columns if c not in ("place", "size", "left", "height")]
    schema = leaves.select(*carried).schema
    rows = _with_ways(swapped, ways_down(m.groups, of_group), [c for c in (*carried, "replacement") if c not in ("key", "digest")])
    out = schema.add("proof_sha256", "string").add("folded_root", "string")
    proofs = rows.mapInArrow(_prover(to_arrow_schema(leaves.select(*carried).schema)), out)
    root = m.top.roots.select(F.col("digest").alias("root"))
    return proofs.join(small(of_group.select("key", "subroot")), "key").join(F.broadcast(root))
