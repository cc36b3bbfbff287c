"""Perplexity of running text: modified Kneser-Ney over word bigrams, with words and spellings below.

A bigram's count is the number of rows whose text holds it; a text's first word follows
its language's start.  A word's count below that is the number of different words before
it, and spellings stand below words (``wordmodel``, ``spelling``).  Texts are scored with
their own row left out and with every row of the same text, so that neither a document nor
its copies vouch for it.

All bigrams of all documents are counted, none is pruned.  They go by numbers of their
words, and cross the shuffle as sorted blocks of differences, some four bytes each.  A row
that is scored was counted, so a bigram that is not stored has count 1: only what was seen
twice or more is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import wordmodel
from .grams import Words, mix, words_of
from .hash_store import HashStore, Lookup, new_folder, write_arrays, write_store
from .kneser import estimates
from .spelling import SCALE, lang_hash
from .wordmodel import salted, spaced, word_keys
from .workspace import fresh_path, join_small, open_fs, scratch, table

#: Words whose numbers are looked up at once, bigrams that a task holds while it counts, and bigrams of one bucket, about.
LOOKED_UP, HELD, BUCKET = 1 << 17, 1 << 21, 1 << 21
#: Words of more rows than this have the bigrams after them spread over all buckets.
FREQUENT = 10_000
_START = np.zeros(1, np.uint64)
_SPREAD = np.uint64(1 << 63)
_MOST = (1 << 31) - 1
_SEEN = ("total", "types", "n1", "n2", "n3", "n4")
_COUNTED = "kind int, number long, n long, types long, n1 long, n2 long, n3 long, n4 long, path string"
_FILES, _HISTORIES, _FOLLOWERS = 0, 1, 2


@dataclass(frozen=True)
class Bigrams:
    """Arrays by word key (number, spread, count of its bigrams and what they free, logp, logp_out), by bucket and bigram (n), by start (discounts) and by text (rows), in millionths."""

    words: HashStore
    pairs: HashStore
    starts: HashStore
    copies: HashStore


def text_key() -> Column:
    return F.xxhash64("text", "lang")


def _keys(texts: list[str], langs: list[str], own: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the start and of each text's words in order, one text after another, and how many each has; of no words, none (``own``: the texts' words)."""
    parts = [spaced(t) for t in texts]
    words = own if own is not None and all(a is b for a, b in zip(parts, texts, strict=True)) else words_of(parts)
    lengths = words.counts + (words.counts > 0)
    hashes = np.zeros(lengths.sum(), np.uint64)
    said = np.ones(len(hashes), bool)
    said[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    hashes[said] = words.hashes
    salts = {lang: lang_hash(lang) for lang in set(langs)}
    return salted(hashes, np.repeat(np.array([salts[lang] for lang in langs], np.uint64), lengths)), lengths


def _texts(batches: Iterator[pa.RecordBatch], count=None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows with the keys of their texts, how many each has, and what ``count`` says of them; some ``LOOKED_UP`` words at once."""
    for batch in batches:
        first, held = 0, 0
        texts: list[str] = []
        for i in range(batch.num_rows):
            texts.append(batch.column("text")[i].as_py() or "")
            held += len(texts[-1])
            if held >= 6 * LOOKED_UP or i + 1 == batch.num_rows:
                rows = batch.slice(first, len(texts))
                own = words_of(texts) if count else None
                yield rows, *_keys(texts, rows.column("lang").to_pylist(), own), count(texts, own) if count else []
                first, held, texts = i + 1, 0, []


def _pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, most of which are empty."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(block: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(block, 8 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def _bucket(pairs: np.ndarray, size: int, bits: int) -> np.ndarray:
    """By the history, or by the whole bigram where it is marked to be spread."""
    return (mix(np.where(pairs & _SPREAD, pairs, pairs // np.uint64(size))) >> np.uint64(64 - bits)).astype(np.int64)


def _together(bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which each bucket's places lie together as they were, and where each begins."""
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")  # short keys take linear time
    return order, np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))


def _count(numbers: HashStore, bits: int):
    """Blocks of the bigrams of a task's texts by bucket."""
    size = np.uint64(numbers.rows)

    def settle(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = _bucket(pairs, numbers.rows, bits)
        order, edges = _together(bucket, bits)
        rows = []
        for a, b in zip(edges, edges[1:], strict=False):
            own = order[a:b]
            rows.append((int(bucket[own[0]]), len(own), _pack(np.diff(pairs[own], prepend=np.uint64(0))), _pack(n[own])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "pairs", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, held, n = Lookup(numbers), [], 0
        for _, keys, lengths, _ in _texts(batches):
            unique, back = np.unique(keys, return_inverse=True)
            number = lookup.ranks(unique).astype(np.uint64)
            _, (often,) = lookup.find(unique)
            after = number * size | np.where(often > FREQUENT, _SPREAD, np.uint64(0))
            text = np.repeat(np.arange(len(lengths)), lengths)
            inside = np.flatnonzero(text[1:] == text[:-1])
            pairs, text = after[back[inside]] + number[back[inside + 1]], text[inside]
            # like bigrams of a text side by side
            order = np.argsort(mix(pairs ^ mix(text.view(np.uint64) + np.uint64(1))))
            pairs, text = pairs[order], text[order]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
            if new.any():
                held.append(pairs[new])
                n += len(held[-1])
            if n > HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return count


def _unite(size: int, folder: str):
    """Writes a bucket's bigrams that were seen twice or more; its sums by history and its numbers of histories by word."""

    def rows(kind: int, number: np.ndarray, n: np.ndarray, *seen: np.ndarray, path: str | None = None) -> pa.Table:
        columns = [np.full(len(number), kind, np.int32), number.astype(np.int64), n.astype(np.int64), *(seen or [np.zeros(len(number), np.int64)] * 5)]
        return pa.table([*map(pa.array, columns), pa.array([path] * len(number), pa.string())], ["kind", "number", "n", "types", "n1", "n2", "n3", "n4", "path"])

    def unite(blocks: pa.Table) -> pa.Table:
        lengths = blocks.column("n").to_pylist()
        pairs, times = ([_unpack(b.as_py(), n) for b, n in zip(blocks.column(c), lengths, strict=True)] for c in ("pairs", "times"))
        pairs = np.concatenate([np.cumsum(p, dtype=np.uint64) for p in pairs])
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        n = np.add.reduceat(np.concatenate(times)[order].view(np.int64), starts)
        pairs = pairs[starts]
        again, bucket = n > 1, blocks.column("bucket")[0].as_py()
        path = write_arrays(*open_fs(folder), bucket, [pairs[again].view(np.int64), np.minimum(n[again], _MOST).astype(np.int32)], ["key", "n"])
        history, word = np.divmod(pairs & ~_SPREAD, np.uint64(size))
        first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
        seen = [np.diff(first, append=len(history)), *(np.add.reduceat((n == i).astype(np.int64), first) for i in (1, 2, 3, 4))]
        followers, before = np.unique(word, return_counts=True)
        file = rows(_FILES, np.array([bucket]), np.array([again.sum()]), path=path)
        return pa.concat_tables([file, rows(_HISTORIES, history[first], np.add.reduceat(n, first), *seen), rows(_FOLLOWERS, followers, before)])

    return unite


def _start_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [int(word_keys(_START, lang).view(np.int64)[0]) for lang in batch.column("lang").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(keys, pa.int64())], ["lang", "key"])


def _numbered(numbers: HashStore):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(numbers)
        for batch in batches:
            unique, back = np.unique(batch.column("key").to_numpy().view(np.uint64), return_inverse=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lookup.ranks(unique)[back])], [*batch.schema.names, "number"])

    return number


def _spelt(texts: DataFrame, path: str) -> DataFrame:
    """All words of ``texts`` and the starts of their languages by key, with their spellings and the rows that hold them."""
    with scratch(texts.sparkSession):
        words = wordmodel.word_counts(texts)
        starts = words.select("lang").distinct().mapInArrow(_start_keys, "lang string, key long")
        rows = wordmodel.spelt_words(words).unionByName(starts, allowMissingColumns=True)
        return table(rows.withColumn("often", F.least(F.coalesce("n", F.lit(_MOST)), F.lit(_MOST)).cast("int")).drop("n"), path=path)


def _named(texts: DataFrame, path: str, folder: str) -> tuple[DataFrame, HashStore]:
    """Those words with number, different words before (n) and sums of the bigrams after them; the bigrams, in ``folder``."""
    with scratch(texts.sparkSession):
        rows = _spelt(texts, fresh_path(texts.sparkSession, "spelt"))
        numbers = write_store(rows.select("key", "often"), "numbers")
        observed = rows.where("spelt is not null").agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0]
        bits = max(1, (observed // BUCKET).bit_length())
        blocks = texts.select("text", "lang").mapInArrow(_count(numbers, bits), "bucket long, n long, pairs binary, times binary")
        counted = table(blocks.groupBy("bucket").applyInArrow(_unite(numbers.rows, folder), _COUNTED), "bigrams")
        files = counted.where(F.col("kind") == _FILES).select("number", "path", "n").collect()
        pairs = HashStore(folder, {r["number"]: r["path"] for r in files if r["n"]}, bits, sum(r["n"] for r in files), {})
        of = lambda kind, name: F.sum(F.when(F.col("kind") == kind, F.col(name)))
        seen = [of(_HISTORIES, a).alias(b) for a, b in zip(("n", *_SEEN[1:]), _SEEN, strict=True)]
        seen = counted.where(F.col("kind") != _FILES).groupBy("number").agg(of(_FOLLOWERS, "n").alias("n"), *seen)
        named = rows.mapInArrow(_numbered(numbers), "lang string, key long, spelt long, spelt_out long, often int, number long")
        named = named.select("lang", "key", "number", (F.col("often") > FREQUENT).cast("int").alias("spread"), "spelt", "spelt_out")
        return table(named.join(seen, "number", "left"), path=path), pairs


def model(texts: DataFrame) -> Bigrams:
    """Counts of all words and bigrams of ``texts`` (text, lang)."""
    spark = texts.sparkSession
    folders = {kind: new_folder(spark, kind) for kind in ("words", "pairs", "starts", "copies")}
    with scratch(spark):
        named, pairs = _named(texts, fresh_path(spark, "named"), folders["pairs"])
        return _stores(texts, named, pairs, folders)


def _stores(texts: DataFrame, named: DataFrame, pairs: HashStore, folders: dict[str, str]) -> Bigrams:
    discounts = table(named.groupBy("lang").agg(*estimates(*[F.sum(c) for c in _SEEN[2:]])), "discounts")
    millionths = lambda c: F.round(c * SCALE).cast("long")
    left = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + (F.col("types") - F.col("n1") - F.col("n2")) * F.col("d3")
    # a word that only ends texts is no history
    kept = ("key", "number", "spread", "followed", "freed")
    placed = join_small(named, discounts, "lang").select("lang", "n", "spelt", "spelt_out", *kept[:3], F.coalesce("total", F.lit(0)).alias("followed"), F.coalesce(millionths(left), F.lit(0)).alias("freed"))
    levels = wordmodel.word_level(placed.where("spelt is not null"))
    begun = placed.where("spelt is null").select(*kept, F.lit(0).alias("logp"), F.lit(0).alias("logp_out"))
    starts = named.where("spelt is null").select("lang", "key")
    begins = join_small(starts, discounts, "lang").select("key", *[millionths(F.col(c)).alias(c) for c in ("d1", "d2", "d3")])
    copies = table(texts.groupBy(text_key().alias("key")).agg(F.count("*").alias("n")).where("n > 1"))
    return Bigrams(
        write_store(levels.select(*kept, "logp", "logp_out").union(begun), "words", n=named.count(), folder=folders["words"]),
        pairs,
        write_store(begins, "starts", folder=folders["starts"]),
        write_store(copies, "copies", folder=folders["copies"]),
    )


def scorer(model: Bigrams, base_columns, names: tuple[str, ...]):
    """Rows of doc_id, row_key, lang, the base counts, and number, sum and squares of the log-probabilities of the text's words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [Lookup(s) for s in (model.words, model.pairs, model.starts, model.copies)]
        for rows, keys, lengths, base in _texts(batches, base_columns):
            sums = _sums(model, lookups, keys, lengths, rows.column("text_key").to_numpy().view(np.uint64))
            columns = [pa.array(c, pa.int64()) for c in (*base, *sums)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "row_key", "lang")), *columns], ["doc_id", "row_key", "lang", *names])

    return score


def _times(lookup: Lookup, pairs: np.ndarray, size: int) -> np.ndarray:
    """The counts of ascending bigrams, 1 where none is stored."""
    out, bucket = np.ones(len(pairs), np.int64), _bucket(pairs, size, lookup.store.bits)
    order, edges = _together(bucket, lookup.store.bits)
    for a, b in zip(edges, edges[1:], strict=False):
        own = order[a:b]
        if (at := int(bucket[own[0]])) in lookup.store.files:
            known, n = lookup.arrays(at)
            place = np.minimum(np.searchsorted(known, pairs[own]), len(known) - 1)
            out[own] = np.where(known[place] == pairs[own], n[place], 1)
    return out


def _sums(model: Bigrams, lookups: list[Lookup], keys: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> np.ndarray:
    words, pairs, starts, copies = lookups
    owner = np.repeat(np.arange(len(lengths)), lengths)
    unique, at = np.unique(texts, return_inverse=True)
    found, (rows,) = copies.find(unique)
    rows = np.where(found, rows, 1)[at]
    begin = np.zeros(len(lengths), np.uint64)
    begin[lengths > 0] = keys[(np.cumsum(lengths) - lengths)[lengths > 0]]
    unique, at = np.unique(begin, return_inverse=True)
    cuts = [c[at] / SCALE for c in starts.find(unique, 3)[1]]
    unique, back = np.unique(keys, return_inverse=True)
    _, (number, spread, total, left, logp, logp_out) = words.find(unique, 6)
    number = number.astype(np.uint64)
    after = number * np.uint64(model.words.rows) | spread.astype(np.uint64) << np.uint64(63)
    left, below, below_out = left / SCALE, np.exp(logp / SCALE), np.exp(logp_out / SCALE)
    out = np.zeros((3, len(lengths)), np.int64)
    places = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    for a in range(0, len(places), LOOKED_UP):
        here = places[a : a + LOOKED_UP]
        who, history, word = owner[here], back[here - 1], back[here]
        d1, d2, d3 = (c[who] for c in cuts)
        pair = after[history] + number[word]
        order = np.argsort(pair)
        n = np.empty(len(pair), np.int64)
        n[order] = _times(pairs, pair[order], model.words.rows)
        rest = n - rows[who]
        cut = lambda n: np.where(n <= 0, 0, np.where(n == 1, d1, np.where(n == 2, d2, d3)))  # noqa: B023, E731
        others, spared = total[history] - rows[who], cut(rest)
        mass = left[history] - cut(n) + spared
        lower = np.where(rest > 0, below[word], below_out[word])
        p = np.where(others > 0, (np.maximum(rest - spared, 0) + mass * lower) / np.maximum(others, 1), 0)
        said = np.rint(np.log(np.where(p > 0, p, lower)) * SCALE).astype(np.int64)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        for o, values in zip(out, (np.ones(len(here), np.int64), said, wordmodel.squared(said)), strict=True):
            o[who[first]] += np.add.reduceat(values, first)
    return out
