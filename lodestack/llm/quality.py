"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model of each language is counted by Spark over all documents
(``bigrams``: word bigrams, below them whole words in ``wordmodel`` and 5-grams of their
unfolded code points in ``spelling``) and kept as sorted hash arrays in shared files, which
the tasks that score map into memory.  What is counted and stored grows with the corpus;
the documents are scanned for words, for bigrams and for the scores, whatever the languages.

A document is rejected if its log-perplexity (mean over its words) leaves its
language's band around the median of the language's documents.  The band's unit is a
deviation that joins the spread between documents (median absolute deviation) and the
sampling noise of a text of that length (variance of one word's log-probability over
the number of words).  With labels, the band's two edges are set so that all but fixed
shares of the good documents stay; else they are ``width`` deviations away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bigrams, wordmodel
from .grams import Words, gram_hashes, mix, word_hashes, words_of
from .hash_store import HashStore, Lookup
from .workspace import column_of, free_name, join_small, shuffles_dropped, small, table

#: Shares of the good documents that fitted bands let go below and above, and how many labels a language needs for bands of its own.
LET_GO, LEAST_LABELS = (0.001, 0.004), 100
#: Words of the n-grams that judge documents.
ORDER = 2
#: Distinct words that are looked up at once.
LOOKED_UP = 1 << 20
_SYMBOLS = "#*$%&|<>"


def _dup_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeat_words(words: Words) -> np.ndarray:
    """For each text, its words in windows of five that the text holds twice or more."""
    n, counts = len(words.hashes), words.counts
    out = np.zeros(n + 1, np.int64)
    if n > 5:
        text = np.repeat(np.arange(len(counts)), counts)
        inside = np.flatnonzero(text[4:] == text[:-4])
        # a text's windows meet their like of the same text only
        grams = mix(gram_hashes(words.hashes, 5)[inside] ^ mix(text[inside].view(np.uint64) + np.uint64(1)))
        ordered = np.sort(grams)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            # most windows differ from all of these in their leading bits
            leading = np.zeros(1 << 18, bool)
            leading[twice >> np.uint64(46)] = True
            maybe = np.flatnonzero(leading[grams >> np.uint64(46)])
            again = inside[maybe[twice[np.minimum(np.searchsorted(twice, grams[maybe]), len(twice) - 1)] == grams[maybe]]]
            change = np.bincount(again, minlength=n + 1) - np.bincount(again + 5, minlength=n + 1)
            np.cumsum(np.cumsum(change[:-1]) > 0, out=out[1:])
    ends = np.cumsum(counts)
    return out[ends] - out[ends - counts]


def base_columns(texts: list[str], words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts (``words``: theirs)."""
    ends = np.cumsum(words.counts)
    held = np.concatenate([[0], np.cumsum(words.end - words.start)])
    points = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols, lines = ([f(t) for t in texts] for f in (lambda t: sum(map(t.count, _SYMBOLS)), _dup_lines))
    # bytes of words less those that continue a code point
    chars = held[ends] - held[ends - words.counts] - (words.sizes - points)
    return [words.counts, chars, np.array(symbols, np.int64), np.array(lines, np.int64), _repeat_words(words)]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """The same of one text."""
    return tuple(int(c[0]) for c in base_columns([text], words_of([text])))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Number of scored words and the sums of their logarithms (millionths) and squares (thousandths).
SUMS = ("n", "logp", "logp2")
_SCORED = "doc_id long, row_key long, lang string, " + ", ".join(f"{c} long" for c in (*BASE, *SUMS))
_PAIRS = "row_key long, key long, times long"


def _scorer(store: HashStore | None, pairs: bool = False):
    """Rows of base counts and sums; without a store the sums are 0; with ``pairs``, rows of each document's words instead."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(store) if store else None
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            first, held = 0, 0
            base: list[tuple] = []
            keys: list[np.ndarray] = []
            times: list[np.ndarray] = []
            for i, lang in enumerate(langs):
                whole = batch.column("text")[i].as_py() or ""
                own = word_hashes(whole)
                if not pairs:
                    base.append(base_counts(whole))
                parts = wordmodel.spaced(whole)
                unique, n = np.unique(wordmodel.word_keys(own if parts is whole else word_hashes(parts), lang), return_counts=True)
                keys.append(unique)
                times.append(n)
                held += len(unique)
                if held < LOOKED_UP and i + 1 < len(langs):
                    continue
                rows = slice(first, i + 1)
                doc, key = (batch.column(c).slice(first, i + 1 - first) for c in ("doc_id", "row_key"))
                if pairs:
                    owners = np.repeat(key.to_numpy(), [len(k) for k in keys])
                    yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(times))], ["row_key", "key", "times"])
                else:
                    sums = _sums(lookup, keys, times)
                    columns = [pa.array(c, pa.int64()) for c in (*zip(*base, strict=True), *sums)]
                    yield pa.RecordBatch.from_arrays([doc, key, pa.array(langs[rows], pa.string()), *columns], ["doc_id", "row_key", "lang", *BASE, *SUMS])
                first, held = i + 1, 0
                base, keys, times = [], [], []

    return score


def _sums(lookup: Lookup | None, keys: list[np.ndarray], times: list[np.ndarray]) -> list[np.ndarray]:
    lengths = np.array([len(k) for k in keys])
    out = [np.zeros(len(keys), np.int64) for _ in SUMS]
    filled = np.flatnonzero(lengths)
    if lookup is None or not len(filled):
        return out
    unique, back = np.unique(np.concatenate(keys), return_inverse=True)
    found, (logp,) = lookup.find(unique)
    n = np.concatenate(times) * found[back]
    starts = (np.cumsum(lengths) - lengths)[filled]
    for o, values in zip(out, (n, logp[back] * n, wordmodel.squared(logp)[back] * n), strict=True):
        o[filled] = np.add.reduceat(values, starts)
    return out


def lang_key(lang: str = "lang") -> Column:
    """A null language is one of its own, not the empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit(""))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text", lang_key())


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return rows.select("doc_id", _row_key().alias("row_key"), "text", lang_key().alias("lang"))


def score(docs: DataFrame, map_rows: int = wordmodel.MAP_ROWS, order: int = 1) -> DataFrame:
    """doc_id, row_key, lang, the base counts, n, logp and logp2 for each row of ``docs`` (doc_id, text, lang).

    ``order`` 1 scores words by themselves (joined beyond ``map_rows`` of them), 2 each
    word after the one before it.
    """
    texts = _texts(docs)
    if order == 2:
        keyed = texts.withColumn("text_key", bigrams.text_key())
        return keyed.mapInArrow(bigrams.scorer(bigrams.model(texts), base_columns, (*BASE, *SUMS)), _SCORED)
    if order != 1:
        raise ValueError(f"order {order} is neither 1 nor 2")
    model = wordmodel.model(texts, map_rows)
    if isinstance(model, HashStore):
        return texts.mapInArrow(_scorer(model), _SCORED)
    counted = texts.mapInArrow(_scorer(None), _SCORED).drop(*SUMS)
    joined = texts.mapInArrow(_scorer(None, pairs=True), _PAIRS).join(model, "key")
    times, logp = F.col("times"), F.col("logp")
    square = F.floor(F.pow(logp / wordmodel.SCALE, F.lit(2)) * 1000)
    sums = joined.groupBy("row_key").agg(F.sum("times").alias("n"), F.sum(logp * times).alias("logp"), F.sum(square * times).alias("logp2"))
    # rows that repeat in all columns have been added up
    rows = counted.groupBy("row_key").agg(F.count("*").alias("_rows")).join(sums, "row_key", "left")
    each = [F.expr(f"coalesce({c}, 0L) div _rows").alias(c) for c in SUMS]
    return counted.join(rows.select("row_key", *each), "row_key").select("doc_id", "row_key", "lang", *BASE, *SUMS)


def base_failed() -> Column:
    """The rules that need no model."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def assess(docs: DataFrame, width: float = 6.0, labels: DataFrame | None = None, map_rows: int = wordmodel.MAP_ROWS, order: int = ORDER) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang): doc_id, row_key, the base counts, base_failed, log_perplexity, low, high, kept.

    With ``labels`` (doc_id, quality) a language's band lets ``LET_GO`` of its good
    documents go, or of all languages' where it has fewer than ``LEAST_LABELS``; with
    too few in all, ``width`` holds.  Null text counts as empty and fails the base
    rules; a null language is a language of its own.  Texts are read whole, whatever
    their length.  ``row_key`` hashes doc_id, text and lang.  Repeated rows are judged
    alike; other columns are ignored.  ``order`` and ``map_rows`` are those of ``score``.
    """
    with shuffles_dropped(docs.sparkSession):
        judged = _bands(table(score(docs, map_rows, order), "scored"), width, labels)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).select("doc_id", "row_key", *BASE, "base_failed", "log_perplexity", "low", "high", "kept")


def _bands(scored: DataFrame, width: float, labels: DataFrame | None) -> DataFrame:
    """``scored`` with log_perplexity and the band of its language."""
    n, logp, logp2 = F.col("n"), F.col("logp") / wordmodel.SCALE, F.col("logp2") / 1000
    scored = scored.withColumn("log_perplexity", F.when(n > 0, F.try_divide(-logp, n)))
    level = F.col("log_perplexity")
    rows = scored.where(level.isNotNull())
    middle = rows.groupBy("lang").agg(F.percentile_approx(level, 0.5, 10000).alias("middle"), (F.sum(logp2) / F.sum(n) - F.pow(F.sum(logp) / F.sum(n), F.lit(2))).alias("noise"))
    spread = join_small(rows, middle, "lang").groupBy("lang", "middle", "noise").agg((1.4826 * F.percentile_approx(F.abs(level - F.col("middle")), 0.5, 10000)).alias("spread"))
    deviation = F.sqrt(F.pow("spread", F.lit(2)) + F.try_divide(F.greatest("noise", F.lit(0.0)), n))
    placed = join_small(scored, spread, "lang", "left").withColumn("deviation", deviation)
    below, above = F.lit(-width), F.lit(width)
    if labels is not None:
        good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        off = F.try_divide(level - F.col("middle"), F.col("deviation"))
        clean = placed.where(~base_failed()).join(good, "doc_id").select("lang", off.alias("off")).where("off is not null")
        edges = F.percentile_approx("off", [LET_GO[0], 1 - LET_GO[1]], 10000).alias("edges")
        # a row for each language, and one (null) for all
        fitted = clean.rollup("lang").agg(edges, F.count("*").alias("labels")).where(F.col("labels") >= LEAST_LABELS).select("lang", "edges")
        fitted = table(fitted, "edges")
        every = fitted.where("lang is null").select(F.col("edges").alias("every")).first()
        placed = join_small(placed, fitted.where("lang is not null"), "lang", "left")
        if every:
            low, high = every[0]
            below, above = (F.coalesce(F.col("edges")[i], F.lit(float(x))) for i, x in enumerate((low, high)))
    edge = lambda x: F.col("middle") + x * F.col("deviation")
    return placed.withColumn("low", F.least(edge(below), F.col("middle") - 0.05)).withColumn("high", F.greatest(edge(above), F.col("middle") + 0.05))


def keep_good(docs: DataFrame, width: float = 6.0, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with their own columns."""
    key, mine = free_name(docs, "_key"), free_name(docs, "_rejected")
    rejected = small(assess(docs, width, labels).where("not kept").select(F.col("row_key").alias(mine)).distinct())
    own = docs.select("*", F.col("doc_id").cast("long").alias(key)).withColumn(key, F.xxhash64(key, "text", lang_key()))
    return own.join(rejected, F.col(key) == F.col(mine), "left_anti").select(*map(column_of, docs.columns))
