"""Benchmark decontamination by q-gram filtering and banded alignment.

A benchmark item of m characters leaks into a document if some region of it is
within k = error * m edits of the item.  Such a region keeps at least
m + 1 - q * (k + 1) of the item's q-grams, and their diagonals (place in the
document less place in the item) differ by at most k.  The bound says something only
where q <= m / (k + 1), so short items get shorter q-grams than others, down to the
whole item where no edit is allowed; there is an index for each q.  q-grams of a document
that the items have too are counted in overlapping diagonal bands, twice as wide
as the budget allows; only bands that reach the bound are aligned, with edit
distance restricted to the band.

Texts are compared in lower case with runs of white space as one blank.

Documents are scanned where they lie, without a shuffle.  The items' q-grams are
broadcast; items beyond ``BLOCK_CHARS`` characters are dealt to blocks by hash and
every block is held against all documents in turn, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Characters of benchmark items in one broadcast.
BLOCK_CHARS = 8_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram, by doubling: 2q-grams from two q-grams."""
    hashes, size = points.astype(np.uint64) + np.uint64(1), 1
    power = _MULTIPLIER.reshape(1)
    while size * 2 <= q:
        hashes = hashes[:-size] * power + hashes[size:] if len(hashes) > size else hashes[:0]
        hashes ^= hashes >> np.uint64(29)
        power, size = power * _MULTIPLIER, size * 2
    if size < q:
        step = q - size
        hashes = hashes[:-step] * power + hashes[step:] if len(hashes) > step else hashes[:0]
    return hashes * _MULTIPLIER


def budget(length: int, error: float) -> int:
    """Edits that an item of ``length`` characters may differ by."""
    return int(error * length)


def gram_size(length: int, edits: int, most: int) -> int:
    """The largest q up to ``most`` for which a region within the budget surely shares a q-gram; 0 if there is none."""
    return min(most, length // (edits + 1))


def bound(length: int, q: int, edits: int) -> int:
    """q-grams that a region within the budget shares at least."""
    return length + 1 - q * (edits + 1)


def banded_distance(item: np.ndarray, region: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int] | None:
    """(edit distance, end in region) of the best alignment of the whole item with a part of the region.

    Only cells on diagonals low..high (place in region less place in item) are
    visited; None if none is within ``edits``.  Cells outside of the region hold a
    character that matches nothing, which costs as much as leaving the item's out.
    """
    at = region.tobytes().find(item.tobytes())
    if at >= 0 and at % 4 == 0 and low <= at // 4 <= high:
        return 0, at // 4 + len(item)
    width, step = high - low + 1, np.arange(high - low + 1)
    padded = np.full(len(item) + width, np.iinfo(np.uint32).max, np.uint32)
    begin, end = max(0, low), min(len(region), low + len(padded))
    if begin < end:
        padded[begin - low : end - low] = region[begin:end]
    row = np.zeros(width, np.int64)
    for i, ch in enumerate(item.tolist()):
        new = row + (padded[i : i + width] != ch)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= step
        np.minimum.accumulate(new, out=new)
        new += step
        row = new
        if i % 16 == 15 and row.min() > edits:
            return None
    best = int(row.argmin())
    return (int(row[best]), min(len(region), low + best + len(item))) if row[best] <= edits else None


class Items:
    """Benchmark items by the size of the q-grams that find them."""

    def __init__(self, items: list[tuple[int, str]], q: int, error: float) -> None:
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in items:
            points = _points(normalise(text or ""))
            if size := gram_size(len(points), budget(len(points), error), q):
                by_size.setdefault(size, []).append((i, points))
        self.indexes = [ItemIndex(mine, size, error) for size, mine in sorted(by_size.items())]

    def leaks(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of the best alignment of each item that leaks."""
        points = _points(normalise(text))
        return [x for index in self.indexes for x in index.leaks(points)]


class ItemIndex:
    """q-grams of benchmark items (none shorter than q), sorted by hash, with a table of their leading bits in front."""

    def __init__(self, texts: list[tuple[int, np.ndarray]], q: int, error: float) -> None:
        self.q = q
        self.ids = [i for i, _ in texts]
        self.points = [t for _, t in texts]
        self.length = np.array([len(t) for _, t in texts], np.int64)
        self.edits = np.array([budget(len(t), error) for _, t in texts], np.int64)
        self.bound = np.array([bound(len(t), q, k) for (_, t), k in zip(texts, self.edits, strict=True)], np.int64)
        hashes = [qgram_hashes(t, q) for t in self.points]
        key = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order].astype(np.int32), place[order].astype(np.int32)
        self.first = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.unique = self.key[self.first]
        self.count = np.diff(np.r_[self.first, len(key)])
        self.bits = max(16, int(np.ceil(np.log2(max(len(self.unique), 1)))) + 4)
        slot = (self.unique >> np.uint64(64 - self.bits)).astype(np.int64)
        #: First hash of each slot, and most hashes in one; slot order is hash order.
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slots[slot[::-1]] = np.arange(len(slot) - 1, -1, -1, dtype=np.int32)
        self.filled = self.slots >= 0
        self.deepest = int(np.bincount(slot).max()) if len(slot) else 0

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in text, item, place in item) of every shared q-gram."""
        hashes = qgram_hashes(points, self.q)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        maybe = np.flatnonzero(self.filled[slot])
        at, wanted = self.slots[slot[maybe]].astype(np.int64), hashes[maybe]
        found = self.unique[at] == wanted if len(at) else np.zeros(0, bool)
        for deeper in range(1, self.deepest):
            rest = np.flatnonzero(~found)
            further = np.minimum(at[rest] + deeper, len(self.unique) - 1)
            same = self.unique[further] == wanted[rest]
            at[rest[same]], found[rest[same]] = further[same], True
        maybe, at = maybe[found], at[found]
        n = self.count[at]
        row = np.repeat(self.first[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        return np.repeat(maybe, n), self.item[row], self.place[row]

    def regions(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that reach their item's bound."""
        place, item, within = self.hits(points)
        # an item with fewer hits in all than its bound has no such band
        enough = np.bincount(item, minlength=len(self.ids)) >= self.bound if len(self.ids) else np.zeros(0, bool)
        keep = enough[item]
        place, item, within = place[keep], item[keep], within[keep]
        if not len(item):
            return
        stride = self.edits[item] + 1
        band = (place.astype(np.int64) - within + self.length[item]) // stride
        band, item2 = np.concatenate([band, band - 1]), np.concatenate([item, item]).astype(np.int64)
        base = int(band.min())
        span = int(band.max()) - base + 1
        keys = item2 * span + (band - base)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        owner = keys[edges[:-1]] // span
        for at in np.flatnonzero(np.diff(edges) >= self.bound[owner]).tolist():
            i, b = int(owner[at]), int(keys[edges[at]] % span) + base
            hit = order[edges[at] : edges[at + 1]] % len(place)
            # repeated q-grams hit more than once: both sides' distinct places must reach the bound
            if min(len(np.unique(place[hit])), len(np.unique(within[hit]))) >= self.bound[i]:
                first = int(b * (self.edits[i] + 1) - self.length[i])
                yield i, first, first + 2 * int(self.edits[i] + 1) - 1

    def leaks(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the text) of the best alignment of each item that leaks; the first of equals."""
        best: dict[int, tuple[int, int]] = {}
        if len(points) < self.q:
            return []
        for i, low, high in self.regions(points):
            edits = best[i][0] - 1 if i in best else int(self.edits[i])
            if edits < 0:
                continue
            start = max(0, low)
            region = points[start : max(start, high + int(self.length[i]))]
            if found := banded_distance(self.points[i], region, low - start, high - start, edits):
                best[i] = found[0], found[1] + start
        return [(self.ids[i], *best[i]) for i in sorted(best)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, row_key, item_id, distance, end for each benchmark item found in each document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; ``end`` is the end
    of the best region in the normalised text.  Items of every length are found, the
    shortest (no edit allowed) where they occur letter for letter; null and blank items
    are in no text, null texts hold none.  ``error`` is below one.  Texts of any length
    are searched whole.  Equal items
    are found alike.  Repeated documents give repeated rows.  Row keys hash doc_id
    and text.  Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text").where("text is not null")
    out = None
    for index in _blocks(benchmark, q, error, block_chars):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                found: list[tuple] = []
                for doc, key, text in zip(batch.column("doc_id"), batch.column("row_key"), batch.column("text"), strict=True):
                    found += [(doc.as_py(), key.as_py(), *x) for x in items.leaks(text.as_py())]
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "row_key", "item_id", "distance", "end"])

        part = texts.mapInArrow(search, "doc_id long, row_key long, item_id long, distance long, end long")
        out = part if out is None else out.union(part)
    return out


def _blocks(benchmark: DataFrame, q: int, error: float, block_chars: int) -> Iterator[Broadcast]:
    """The items, in broadcasts of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], q, error))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item.

    Rows are judged where they lie and pass on or not, without a shuffle or a join.
    """
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    for index in _blocks(benchmark, q, error, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            items = index.value
            for batch in batches:
                texts = batch.column(at)
                yield batch.filter(pa.array([not (t.is_valid and items.leaks(t.as_py())) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
