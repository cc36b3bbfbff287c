r"""Spelling variants: words one edit apart, grouped by the most frequent form.

Words are counted over all documents.  Pairs at one edit are found by asymmetric
q-chunks: the shorter word (either, at equal lengths) gives two disjoint chunks, its first
and last half; the longer one its positional grams of that size.  One edit leaves one of
the chunks whole and moves it by one place at most: the first stays at its place, the last
keeps its distance to the end, so no other gram is made.  The edit is then in the other
half, which is cut into two chunks again: one of these is whole too.  Words that share
such a half and a quarter are the candidates, and each is verified by its edit distance.

Everything is DataFrame functions.  A frequent chunk is an ordinary skewed join key
between two written tables, which AQE may split.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import cut, table

#: Fewest code points of a word, and fewest occurrences.
LEAST_CHARS, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variants.
RATIO = 10
_LETTERS = r"[A-Za-zÀ-ÿ]"


def lower_ascii(text: Column) -> Column:
    """Lower-case only A to Z."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def slip(run: Column, doc_id: Column, every: int = 31) -> Column:
    """``run`` without one code point in one of ``every`` documents, chosen by a hash of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    i = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), i), F.substring(run, i + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, every: int = 31, least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of letters, a slip applied, with their occurrences.

    Shorter runs cannot become words and are never made.  Null texts have none.  Counts are
    combined before they are shuffled.
    """
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"{_LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    words = runs.select(slip(lower_ascii(F.col("run")), F.col("doc_id"), every).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def chunks(words: DataFrame, shorter: bool) -> DataFrame:
    """(word, size, side, part, gram) of ``words`` (word): half and quarter of a word of ``size`` letters.

    ``side`` says which half is whole, ``part`` which quarter of the other one.  With
    ``shorter``, the chunks of each word by its own size; else the grams that are in their
    places for words as long and for words one shorter.
    """
    m, size = F.length("word"), F.col("size")
    sizes = F.array(m) if shorter else F.array(m, m - 1)
    half = F.floor(size / 2).cast("int")
    sized = words.select("word", m.alias("m"), F.explode(sizes).alias("size")).select("*", half.alias("q"), F.floor((size - half) / 2).cast("int").alias("u"))
    m, q, u = F.col("m"), F.col("q"), F.col("u")
    v = size - q - u
    cut_at = lambda start, length: F.substring("word", start + 1, length)
    first, last = cut_at(F.lit(0), q), cut_at(m - q, q)
    made = [(0, 0, first, cut_at(q, u)), (0, 1, first, cut_at(m - v, v)), (1, 0, last, cut_at(F.lit(0), u)), (1, 1, last, cut_at(m - q - v, v))]
    each = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(part).alias("part"), F.concat(whole, more).alias("gram")) for side, part, whole, more in made])
    return sized.select("word", "size", F.explode(each).alias("c")).select("word", "size", "c.side", "c.part", "c.gram")


def near_pairs(words: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b): every two words of ``words`` (word; distinct, at least ``least_chars`` long) that one edit parts, once."""
    left = table(chunks(words, True).withColumnRenamed("word", "a"), "chunks")
    right = table(chunks(words, False).where(F.col("size") >= least_chars).withColumnRenamed("word", "b"), "chunks")
    ordered = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    found = left.join(right, ["size", "side", "part", "gram"]).where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms; a form is more frequent than its word, so there are no loops."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, least_chars: int = LEAST_CHARS) -> DataFrame:
    """word, n, form, form_n, n_near, root for each row of ``words`` (word, n; words distinct).

    A word's form is its near word of largest n, the first by code points in a tie, if that
    n is at least ``ratio`` times the word's; ``root`` follows forms to the last.
    """
    pairs = table(near_pairs(words.select("word"), least_chars), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    seen = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = seen.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), "other")).alias("best"))
    taken = F.col("best.m") >= ratio * F.col("n")
    judged = table(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, every: int = 31) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text).

    Repeated rows count again, a null doc_id is written as nothing, null and empty texts
    have no words, other columns are ignored.  Texts are read whole; a very long word makes
    a dozen keys of three quarters of its length.
    """
    return variants(table(word_counts(docs, every), "words"))
