"""How likely a word's spelling is: Kneser-Ney 5-grams of code points over the distinct words of a language.

Code points are as written, none is folded.  A word is spelt after four blanks and ends
with one, which no word holds.  Counts are of distinct words, as a new word resembles
words rather than running text.  All levels are tables; only the longest n-grams are
needed to score words that were counted, and they go to sorted hash arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .grams import gram_hashes, mix, word_hashes
from .hash_store import HashStore, Lookup, write_store
from .kneser import discount, discounts, left_out, probability
from .workspace import join_small, table

ORDER = 5
#: Logarithms are kept as whole numbers of millionths, which add up alike in any order.
SCALE = 1_000_000
_PIECE = 1 << 19


def lang_hash(lang: str) -> np.uint64:
    return gram_hashes(word_hashes("x" + "_".join(lang.split())), 1)[0]


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all words as rows of code points, and where each word's begin."""
    text = "".join(f"{' ' * (ORDER - 1)}{w}" for w in words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = points != 32
    ends = np.flatnonzero(letter[ORDER - 1 :] | letter[ORDER - 2 : -1]) + ORDER - 1
    length = np.array([len(w) + 1 for w in words], np.int64)
    return np.lib.stride_tricks.sliding_window_view(points, ORDER)[ends - (ORDER - 1)], np.cumsum(length) - length


def gram_keys(grams: np.ndarray, lang: str) -> np.ndarray:
    key = np.full(len(grams), lang_hash(lang), np.uint64)
    for column in grams.T:
        key = mix(key + column)
    return key


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The rows of each language."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == code)


def pieces(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words with a bounded number of characters in all (or one word)."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w)
        if held > _PIECE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(words):
        yield start, len(words)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, rows in by_lang(batch):
            words = batch.column("word").take(pa.array(rows)).to_pylist()
            for a, b in pieces(words):
                grams, _ = windows(words[a:b])
                _, first, n = np.unique(gram_keys(grams, lang), return_index=True, return_counts=True)
                said = grams[first].tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([said[i : i + ORDER] for i in range(0, len(said), ORDER)]), pa.array(n)], ["lang", "gram", "n"])


def train(types: DataFrame) -> DataFrame:
    """(lang, gram, p, p_out) of every 5-gram of ``types`` (lang, word; distinct).

    ``p`` is the probability of the last code point after the others, ``p_out`` the
    same with one observation left out, as one word sees it that was counted itself.
    """
    counted = types.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: table(counted, "grams")}
    for order in range(ORDER - 1, 0, -1):  # how many code points come before
        shorter = F.substring("gram", 2, order)
        levels[order] = table(levels[order + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), "grams")
    lower = None
    for order in range(1, ORDER + 1):
        rows = join_small(levels[order], discounts(levels[order], F.count("*").alias("types")), "lang")
        rows = rows.withColumn("history", F.substring("gram", 1, order - 1))
        sums = table(rows.groupBy("lang", "history").agg(F.sum("n").alias("total"), F.sum(discount(F.col("n"))).alias("left")), "grams")
        rows = rows.join(sums, ["lang", "history"])
        if lower is None:
            below = below_out = 1 / (F.col("types") + 1)
        else:
            rows = rows.withColumn("tail", F.substring("gram", 2, order - 1)).join(lower, ["lang", "tail"])
            below, below_out = F.col("below"), F.col("below_out")
        level = table(rows.select("lang", "gram", probability(below).alias("p"), left_out(below, below_out).alias("p_out")), "grams")
        lower = level.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"), F.col("p_out").alias("below_out"))
    return level


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for lang, rows in by_lang(batch):
            said = "".join(batch.column("gram").take(pa.array(rows)).to_pylist())
            points = np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32)
            keys[rows] = gram_keys(points.reshape(-1, ORDER), lang)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("a"), batch.column("b")], ["key", "a", "b"])


def store(model: DataFrame) -> HashStore:
    """The model as sorted hash arrays: log-probabilities of ``p`` and ``p_out``."""
    logs = model.select("lang", "gram", *[F.round(F.log(c) * SCALE).cast("int").alias(n) for c, n in (("p", "a"), ("p_out", "b"))])
    return write_store(table(logs.mapInArrow(_keyed, "key long, a int, b int"), "spelling"), "spelling")


def spelt(words: list[str], lang: str, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (millionths) of the words' spellings, and with one observation of each n-gram left out."""
    grams, starts = windows(words)
    keys, back = np.unique(gram_keys(grams, lang), return_inverse=True)
    _, (a, b) = lookup.find(keys, 2)
    return np.add.reduceat(a[back], starts), np.add.reduceat(b[back], starts)
