"""N-gram Jaccard self-join of texts.

MinHash signatures over the set of word n-grams are cut into bands; documents
that share a band hash are candidates.  Documents with one n-gram set are one
node, so exact copies cost nothing beyond their sketch.

Candidates are never expanded into pairs of rows.  Each bucket gives a star of
edges; the connected candidates are dealt to blocks of bounded size by hash, and
for every two blocks one task holds both and verifies all pairs between them on
their full n-gram sets at once.  A task returns, for each node, how many documents
it is linked to and a tree edge, so output stays linear in its input whatever the
group's size.  Links of every pair are counted, none is capped or dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .grams import gram_hashes, mix, word_hashes
from .workspace import cut, free_name, small

#: Nodes and n-grams of a block, about.
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 20
#: Columns of a dense product.
_CHUNK = 4096


def choose_bands(threshold: float, recall: float = 0.9995, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach ``recall`` at ``threshold`` with ``most`` hashes."""
    found = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 33)]
    return max(((b, r) for b, r in found if b * r <= most), key=lambda x: x[1])


def _node(grams: np.ndarray) -> bytes:
    """128-bit fingerprint of a set of n-gram hashes."""
    return np.array([len(grams), np.add.reduce(mix(grams ^ np.uint64(0xA5A5))), np.bitwise_xor.reduce(mix(grams + np.uint64(0x5EED)))], ">u8")[1:].tobytes()


def _gram_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(gram_hashes(word_hashes(text or ""), n))


def _sketcher(n: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        which = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            nodes, counts, hashes = [], [], []
            for text in batch.column("text"):
                grams = _gram_set(text.as_py(), n)
                counts.append(len(grams))
                if not len(grams):
                    nodes.append(None)
                    hashes.append(None)
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(grams), 2048):
                    low = np.minimum(low, (grams[at : at + 2048, None] * times + plus).min(axis=0))
                key = np.zeros(bands, np.uint64)
                for column in low.reshape(bands, rows).T:
                    key = mix(key * np.uint64(31) + column)
                nodes.append(_node(grams))
                hashes.append(mix(key + which).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "row_key", "node", "grams", "bands"])

    return sketch


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the n-gram sets, left by right.

    N-grams in few sets are counted pair by pair, the others by matrix products.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    grams = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    length = np.diff(np.r_[first, len(grams)])
    for size in range(2, 9):
        at = first[length == size]
        if len(at):
            who = owner[at[:, None] + np.arange(size)]
            for i in range(size - 1):
                for j in range(i + 1, size):  # owners ascend, so a pair is left, right
                    ok = (who[:, i] < len(left)) & (who[:, j] >= len(left))
                    np.add.at(out, (who[ok, i], who[ok, j] - len(left)), 1)
    common = length > 8
    column = np.repeat(np.where(common, np.cumsum(common) - 1, -1), length)
    for at in range(0, int(common.sum()), _CHUNK):
        here = (column >= at) & (column < at + _CHUNK)
        has = np.zeros((len(left) + len(right), _CHUNK), np.float32)
        has[owner[here], column[here] - at] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the Jaccard threshold."""
    shared = _shared(left, right).astype(np.float64)
    either = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - shared
    return shared >= threshold * either - 1e-9


def _roots(links: np.ndarray) -> np.ndarray:
    """Least connected index for each index of a symmetric link matrix."""
    root, new = np.arange(len(links)), np.zeros(0)
    while not np.array_equal(root, new):
        new = root
        root = np.minimum(root, np.where(links, root, len(root)).min(axis=1))
        root = root[root]
    return root


def _verifier(n: int, threshold: float):
    def within(nodes: list[bytes], sets: list[np.ndarray], copies: np.ndarray):
        links = _linked(sets, sets, threshold)
        np.fill_diagonal(links, False)
        roots = _roots(links)
        return [(nodes[i], int(copies[links[i]].sum()), nodes[roots[i]]) for i in np.flatnonzero(links.any(axis=1))]

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values(["comp", "node"])
        sets = [_gram_set(t, n) for t in group["text"]]
        same = [_node(s) == k for s, k in zip(sets, group["node"], strict=True)]  # row keys may collide
        group, sets = group[same], [s for s, ok in zip(sets, same, strict=True) if ok]
        nodes, copies = list(group["node"]), group["copies"].to_numpy()
        out: list[tuple] = []
        if key[1] == key[2]:
            comp = group["comp"].to_numpy()
            edges = [0, *(np.flatnonzero(comp[1:] != comp[:-1]) + 1), len(comp)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    out += within(nodes[a:b], sets[a:b], copies[a:b])
        else:
            left, right = (np.flatnonzero(group["block"].to_numpy() == k) for k in key[1:3])
            if len(left) and len(right):
                links = _linked([sets[i] for i in left], [sets[i] for i in right], threshold)
                both = np.zeros((len(nodes), len(nodes)), bool)
                both[np.ix_(left, right)] = links
                both[np.ix_(right, left)] = links.T
                roots = _roots(both)
                out = [(nodes[i], int(copies[both[i]].sum()), nodes[roots[i]]) for i in np.flatnonzero(both.any(axis=1))]
        return pd.DataFrame(out, columns=["node", "links", "head"]).assign(settled=bool(key[3]))

    return verify


def _row_key() -> Column:
    """128 bits of doc_id and text."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.col("text"))))


def _classified(docs: DataFrame, n: int, threshold: float, recall: float, block_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` as (doc_id, row_key, node), and every node as (node, copies, least, links, root)."""
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = texts.select("doc_id", _row_key().alias("row_key"), "text").mapInArrow(_sketcher(n, bands, rows), "doc_id long, row_key binary, node binary, grams int, bands array<long>")
    sketched = cut(sketched)
    nodes = cut(sketched.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))

    banded = nodes.select("node", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    comps = components(banded.join(heads, "band").select(F.col("node").alias("a"), F.col("head").alias("b")))
    found = cut(comps.select("node", F.col("root").alias("comp")).join(nodes.drop("bands", "least"), "node"))

    # Written out first, so that the join shuffles both sides plainly and AQE may split a large component.
    sizes = found.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block_nodes), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    placed = found.join(cut(sizes), "comp")
    few, grams = found.agg(F.count("*"), F.coalesce(F.sum("grams"), F.lit(0))).first()
    packs = max(1, few // 256, grams // BLOCK_GRAMS)
    # Components of one block share packs; the others get a tile for every two blocks.
    one = F.col("blocks") == 1
    placed = placed.withColumn("block", F.when(one, 0).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int"))
    placed = placed.withColumn("home", F.when(one, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp")))
    keyed = texts.select(_row_key().alias("row_key"), "text")
    # Rows repeated in both columns share a key; one of them is read, and a hot one shrinks before the shuffle.
    if sketched.where("node is not null").join(found.select("row_key"), "row_key", "left_semi").count() > few:
        keyed = keyed.dropDuplicates(["row_key"])
    read = keyed.join(placed, "row_key")
    tiles = read.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("home", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), one.alias("settled"), "comp", "node", "block", "copies", "text")
    linked = tiles.groupBy("home", "x", "y", "settled").applyInPandas(_verifier(n, threshold), "node binary, links long, head binary, settled boolean")
    linked = cut(linked)

    counted = linked.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(F.col("settled"), F.col("head"))).alias("head"))
    tied = components(linked.where("not settled").select(F.col("node").alias("a"), F.col("head").alias("b")))
    counted = counted.join(tied, "node", "left").select("node", "links", F.coalesce("root", "head", "node").alias("root"))
    ids = nodes.select("node", "copies", "least")
    counted = cut(counted.join(ids, "node", "right").withColumn("root", F.coalesce("root", "node")))
    return sketched.select("doc_id", "row_key", "node"), counted


def ngram_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``.  n_links counts the documents that a
    document is linked to, copies included; class_id is the least doc_id that
    links lead to (null if none has an id).  A text of fewer than ``n`` words has
    one n-gram, all its words; null and wordless texts have none and are linked to
    nothing, their class is their own id.  Rows with one doc_id are separate
    documents.  Other columns are ignored.  A task compares about ``block_nodes`` texts
    with as many others.  ``recall`` is the least chance that a
    pair just at the threshold becomes a candidate; higher ones surely do.
    """
    sketched, counted = _classified(docs, n, threshold, recall, block_nodes)
    roots = counted.where("links is not null").groupBy("root").agg(F.min("least").alias("class_id"))
    known = counted.join(roots, "root", "left").select("node", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    wordless = sketched.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return sketched.where("node is not null").select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "n_links").union(wordless)


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row of each class: that with the least doc_id (rows without one come last), among several the one of the least hash.

    What counts as a row is doc_id and text together: rows of one doc_id with unlike
    texts are in classes of their own, and of full repeats one stays.  Rows without
    words are kept as they are.
    """
    key, mine = free_name(docs, "_key"), free_name(docs, "_mine")
    sketched, counted = _classified(docs, n, threshold, recall, BLOCK_NODES)
    rows = sketched.where("node is not null").groupBy("doc_id", "row_key", "node").agg(F.count("*").alias("rows"))
    rows = cut(rows.join(counted.select("node", "root"), "node").select("doc_id", "row_key", "rows", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "rows")
    first = cut(rows.groupBy("root").agg(F.min(order).alias("first")))
    others = rows.join(first, "root").where("row_key <> first.row_key").select(F.col("row_key").alias(mine))
    repeated = cut(first.where("first.rows > 1").select(F.col("first.row_key").alias(mine)))
    keyed = docs.withColumn(key, _row_key())
    same = F.col(key) == F.col(mine)
    once = keyed.join(small(others.union(repeated)), same, "left_anti")
    if not repeated.isEmpty():
        # repeats shrink before the shuffle
        once = once.union(keyed.join(small(repeated), same, "left_semi").dropDuplicates([key]))
    return once.drop(key)
