"""Perplexity of words: Kneser-Ney over whole words, with spellings below.

Words are as written (no folding); a code point of a script that is written without
spaces is a word of its own.  A word's count is the number of documents that hold it.
It is scored with one of these left out, so that a document does not vouch for itself;
a word that no other document holds falls to the 5-gram model of spellings, mixed half
and half with one more kind of word in the vocabulary, so that no single word costs more
than that.

These are the lowest levels of ``bigrams``, where a word's count is the number of different
words before it.

All documents are counted and the vocabulary grows with them.  Words and spellings are
tables and then sorted hash arrays in shared files; the driver sees file names only.
Beyond ``MAP_ROWS`` words, documents' words are joined to the table instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import spelling
from .grams import distinct, mix, word_hashes, words_of
from .hash_store import HashStore, Lookup, write_store
from .kneser import discount, discounts, probability
from .spelling import SCALE, by_lang, lang_hash, pieces
from .workspace import join_small, table

#: Words that tasks map as arrays of 16 bytes a row; more are joined.
MAP_ROWS = 500_000_000
#: Words that a task holds while it counts, distinct in each of some texts of ``_CHARS`` characters; rows that it returns at once.
HELD_WORDS, _CHARS, _ROWS = 1 << 21, 1 << 20, 1 << 16
#: Thai to Burmese, Khmer, CJK and kana.
_UNSPACED = re.compile("([฀-໿က-႟ក-៿⺀-鿿豈-﫿\U00020000-\U0003ffff])")


def spaced(text: str) -> str:
    """The text with blanks around code points that are words of their own."""
    return text if text.isascii() else _UNSPACED.sub(r" \1 ", text)


def _distinct(texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The words of some texts once each: keys, how many texts hold them, a text that does, and the words."""
    words = words_of([spaced(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), words.counts)
    salts = {lang: lang_hash(lang) for lang in set(langs)}
    keys, first, back = distinct(salted(words.hashes, np.array([salts[lang] for lang in langs], np.uint64)[text]))
    held = np.sort(text * len(keys) + back)
    n = np.bincount(held[np.diff(held, prepend=-1) > 0] % max(1, len(keys)), minlength=len(keys))
    order = np.argsort(first)
    keys, n, first = keys[order], n[order], first[order]
    start, size = words.start[first], (words.end - words.start)[first]
    ends = np.cumsum(size)
    data = words.data[np.repeat(start - ends + size, size) + np.arange(size.sum())]
    return keys, n, text[first], pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def settle() -> Iterator[pa.RecordBatch]:
        keys, n, langs, words = (list(c) for c in zip(*held, strict=True))
        held.clear()
        _, first, back = distinct(np.concatenate(keys))
        n = np.bincount(back, np.concatenate(n)).astype(np.int64)
        lang, words = pa.concat_arrays(langs), pa.concat_arrays(words)
        order = np.argsort(first)  # as in the texts, which compresses better
        first, n = first[order], n[order]
        for a in range(0, len(first), _ROWS):
            rows = pa.array(first[a : a + _ROWS])
            yield pa.RecordBatch.from_arrays([lang.take(rows), words.take(rows).cast(pa.large_string()).cast(pa.string()), pa.array(n[a : a + _ROWS])], ["lang", "word", "n"])

    for batch in batches:
        langs, first, size = batch.column("lang").to_pylist(), 0, 0
        texts: list[str] = []
        for i in range(batch.num_rows):
            texts.append(batch.column("text")[i].as_py() or "")
            size += len(texts[-1])
            if size >= _CHARS or i + 1 == batch.num_rows:
                keys, n, text, words = _distinct(texts, langs[first : i + 1])
                held.append((keys, n, batch.column("lang").take(pa.array(text + first)), words))
                first, size, texts = i + 1, 0, []
                if sum(len(h[0]) for h in held) > HELD_WORDS:
                    yield from settle()
    if held:
        yield from settle()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n): how many rows of ``texts`` (text, lang) hold each word."""
    counted = texts.select("text", "lang").mapInArrow(_count, "lang string, word string, n long")
    return table(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def salted(hashes: np.ndarray, salts: np.ndarray | np.uint64) -> np.ndarray:
    """Keys of word hashes in languages (``lang_hash``)."""
    return mix(hashes * np.uint64(0xD1342543DE82EF95) + salts)


def word_keys(hashes: np.ndarray, lang: str) -> np.ndarray:
    return salted(hashes, lang_hash(lang))


def _spell(store: HashStore):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(store)
        for batch in batches:
            counts = batch.column("n").to_numpy()
            for lang, rows in by_lang(batch):
                words = batch.column("word").take(pa.array(rows)).to_pylist()
                for a, b in pieces(words):
                    all_, out = spelling.spelt(words[a:b], lang, lookup)
                    keys = word_keys(word_hashes(" ".join(words[a:b])), lang).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (b - a)), pa.array(keys), pa.array(counts[rows[a:b]]), pa.array(all_), pa.array(out)], ["lang", "key", "n", "spelt", "spelt_out"])

    return spell


def spelt_words(words: DataFrame) -> DataFrame:
    """``words`` (lang, word, n) by key, with the log-probabilities (millionths) of their spellings, also without one observation."""
    store = spelling.store(spelling.train(words.select("lang", "word")))
    return words.mapInArrow(_spell(store), "lang string, key long, n long, spelt long, spelt_out long")


def word_level(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, n, spelt, spelt_out and others) with ``logp`` and ``logp_out`` (one observation left out), in millionths."""
    stats = join_small(rows, discounts(rows), "lang").groupBy("lang", "d1", "d2", "d3").agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"))).alias("left"), F.count("*").alias("types"))
    placed = join_small(rows, stats, "lang")
    n, rest, total = F.col("n"), F.col("n") - 1, F.greatest(F.col("total") - 1, F.lit(1))
    novel = lambda spelt: (F.exp(spelt / SCALE) + 1 / (F.col("types") + 1)) / 2
    below = novel(F.when(rest > 0, F.col("spelt")).otherwise(F.col("spelt_out")))
    mass = F.col("left") - discount(n) + discount(rest)
    p_out = F.greatest(rest - discount(rest), F.lit(0.0)) / total + F.when(mass > 0, mass / total).otherwise(1.0) * below
    logs = [F.round(F.log(p) * SCALE).cast("int").alias(c) for c, p in (("logp", probability(novel(F.col("spelt")))), ("logp_out", p_out))]
    return placed.select(*rows.columns, *logs)


def word_logps(words: DataFrame) -> DataFrame:
    """(key, logp in millionths) of every word of ``words`` (lang, word, n), one document left out."""
    return word_level(spelt_words(words)).select("key", F.col("logp_out").alias("logp"))


def squared(logp: np.ndarray) -> np.ndarray:
    """Squares in whole thousandths."""
    return np.floor((logp / SCALE) ** 2 * 1000).astype(np.int64)


def model(texts: DataFrame, map_rows: int = MAP_ROWS) -> HashStore | DataFrame:
    """The scores of all words of ``texts`` (text, lang): mapped arrays, or a table beyond ``map_rows``."""
    logps = table(word_logps(word_counts(texts)), "logps")
    return write_store(logps, "vocabulary") if logps.count() <= map_rows else logps
