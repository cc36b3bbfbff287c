import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import components as cc
from lodestack.llm.grams import gram_hashes, word_hashes
from lodestack.llm.ngram_join import choose_bands, keep_one, ngram_classes

SCHEMA = "doc_id long, text string"


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def brute(rows, threshold=0.8):
    """(class, links) of each row, by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    ids = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    return sorted(((d, ids(i), links[i]) for i, (d, _) in enumerate(rows)), key=key)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words))
    rows += [rows[0]] * 7 + ["", None, "  \n", "one two", "one two", "one  two", "three"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (3, rows[3]), (3, "again three another text of some words")]


@pytest.mark.parametrize("block", [2, 512])
def test_equals_all_pairs(spark, block):
    rows = corpus()
    got = ngram_classes(spark.createDataFrame(rows, SCHEMA), block_nodes=block).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == brute(rows)
    assert sum(r.n_links > 0 for r in got) > 20


def test_one_row_repeated_often(spark):
    rows = [*corpus()[:20], *[(None, "a row without id " * 3)] * 60, *[(900, "one row with an id that comes often")] * 60, (901, "one row with an id that comes often")]
    got = ngram_classes(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == brute(rows)


def roots(rows, threshold=0.8):
    """Class of each row (least index), None without words."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        new = [min([root[i], *(root[j] for j in range(len(rows)) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]))]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    return [r if s else None for r, s in zip(root, sets, strict=True)]


def test_keep_one(spark):
    """One row of each class whatever the ids; rows of one id with unlike texts are two documents."""
    rows = [*corpus(), (None, "nothing like it at all here"), (None, "nothing like it at all here"), (7000, "nothing like it at all here"), (7000, "nothing like it at all here")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "_id": F.lit(1), "text2": F.col("text"), "_KEY": F.lit(2)})
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    classes = collections.defaultdict(list)
    for row, r in zip(rows, roots(rows), strict=True):
        classes[r].append(row)
    wordless = classes.pop(None)
    assert sorted(map(str, (x for x in got if not grams(x[1])))) == sorted(map(str, wordless))
    assert len(got) == len(classes) + len(wordless)
    for mine in classes.values():
        [left] = [x for x in got if x in mine]
        assert left[0] == min((d for d, _ in mine if d is not None), default=None)
    assert (3, "again three another text of some words") in got and (7000, "nothing like it at all here") in got


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    other = list(words)
    other[::20] = ["x"] * len(other[::20])  # similarity far below
    near = [*words[:-3], "y", "z"]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(other)), (4, "a" * 2_000_000), (5, "a" * 2_000_000), (6, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_classes(none).count() == 0 and keep_one(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_hashes_follow_words():
    assert list(word_hashes("a b\ta")) == list(word_hashes("a b")) + list(word_hashes("a"))
    assert len(word_hashes(" \n")) == 0 and len(gram_hashes(word_hashes("a b"), 5)) == 1
    long = "x" * 3_000_000 + " y"
    assert list(word_hashes(long))[1] == word_hashes("y")[0]
    assert len(set(word_hashes("a aa aaa aaaa b ab ba").tolist())) == 7


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, None), (50, 45)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 45: 45, 50: 45}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0
