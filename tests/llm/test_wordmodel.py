import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import hash_store, quality as q, spelling, wordmodel as w


def discounts(counts):
    n1, n2, n3, n4 = (max(1, sum(c == i for c in counts)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    keep = lambda x, most: min(max(x, 0.05), most)
    return [0, keep(1 - 2 * y * n2 / n1, 0.95), keep(2 - 3 * y * n3 / n2, 1.95), keep(3 - 4 * y * n4 / n3, 2.95)]


class Plain:
    """The whole model of one language with dictionaries."""

    def __init__(self, texts):
        self.words = collections.Counter(x for t in texts for x in set(t.split()))
        self.levels = {5: collections.Counter(g for x in self.words for g in self.grams(x))}
        for k in (4, 3, 2, 1):
            self.levels[k] = collections.Counter(g[1:] for g in self.levels[k + 1])
        self.d = {k: discounts(c.values()) for k, c in self.levels.items()}

    @staticmethod
    def grams(word):
        said = "    " + word + " "
        return [said[i : i + 5] for i in range(len(word) + 1)]

    def char(self, gram, out):
        k = len(gram)
        if not k:
            return 1 / (len(self.levels[1]) + 1)
        level, d = self.levels[k], self.d[k]
        after = [c for g, c in level.items() if g[:-1] == gram[:-1]]
        c, total, left = level[gram], sum(after), sum(d[min(x, 3)] for x in after)
        if not out:
            return (c - d[min(c, 3)]) / total + left / total * self.char(gram[1:], False)
        below = self.char(gram[1:], c == 1)
        if total == 1:
            return below
        r = c - 1
        return max(r - d[min(r, 3)], 0) / (total - 1) + (left - d[min(c, 3)] + d[min(r, 3)]) / (total - 1) * below

    def logp(self, word):
        d = discounts(self.words.values())
        c, total = self.words[word], sum(self.words.values())
        left = sum(d[min(x, 3)] for x in self.words.values())
        spelt = math.prod(self.char(g, c == 1) for g in self.grams(word))
        novel = (spelt + 1 / (len(self.words) + 1)) / 2
        r = c - 1
        return math.log(max(r - d[min(r, 3)], 0) / (total - 1) + (left - d[min(c, 3)] + d[min(r, 3)]) / (total - 1) * novel)


def some_texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [" ".join(rng.choices(vocabulary, range(60, 0, -1), k=rng.randint(1, 12))) for _ in range(40)]


def test_the_model_equals_dictionaries(spark):
    texts = some_texts()
    plain = Plain(texts)
    docs = spark.createDataFrame([(t, lang) for t in texts for lang in ("=x", "=y")] + [("zzz", "=y"), (None, "=z")], "text string, lang string")
    counts = w.word_counts(docs).where("lang = '=x'")
    assert {r.word: r.n for r in counts.collect()} == plain.words
    chars = {r.gram: (r.p, r.p_out) for r in spelling.train(counts.select("lang", "word")).collect()}
    assert set(chars) == set(plain.levels[5])
    for g, (p, out) in chars.items():
        assert p == pytest.approx(plain.char(g, False)) and out == pytest.approx(plain.char(g, True))
    keys = {int(k): x for x in plain.words for k in w.word_keys(w.word_hashes(x), "=x").view("int64")}
    got = {keys[r.key]: r.logp / 1e6 for r in w.word_logps(counts).collect()}
    assert set(got) == set(plain.words)
    for x, logp in got.items():
        assert logp == pytest.approx(plain.logp(x), abs=2e-5)


def test_scores_of_documents(spark):
    """n and logp of each document, from the plain model."""
    texts = some_texts()
    plain = Plain(texts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in q.score(docs).collect():
        words = texts[r.doc_id].split()
        assert r.n == len(words) and r.logp / 1e6 == pytest.approx(sum(map(plain.logp, words)), abs=1e-3)


def test_nothing_is_folded(spark):
    docs = spark.createDataFrame([("Case case CASE", "xx"), ("你好 a\u00a0b", "xx"), ("Жд По \x00", "xx"), ("", "xx")], "text string, lang string")
    assert sorted(r.word for r in w.word_counts(docs).collect()) == sorted(["Case", "case", "CASE", "你", "好", "a\u00a0b", "Жд", "По", "\x00"])


def test_word_salad_of_rare_words_goes(spark):
    """Texts without the common words of their language."""
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in"], [f"{a}{b}{c}" for a in ("ma", "re", "ti", "lo") for b in ("na", "se", "vo", "ku") for c in ("ra", "li", "do", "me", "fu")]
    rare += [a + b for a in rare for b in rare[:20]]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    good = [(i, prose(rng.choice((40, 60, 80))), "en") for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choices(rare, k=60)), "en") for i in range(5)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in q.assess(docs, labels=labels).collect()}
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[1000 + i] for i in range(5))


def test_store_finds_every_key_and_no_other(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("key"), F.col("id").cast("int").alias("v"))
    store = hash_store.write_store(rows, "test", file_rows=300)
    assert store.rows == 5000 and len(store.files) > 8
    import numpy as np

    keys = np.array([r.key for r in rows.collect()], np.int64).view(np.uint64)
    order = np.argsort(keys)
    found, (values,) = hash_store.Lookup(store).find(keys[order])
    assert found.all() and values.tolist() == order.tolist()
    assert not hash_store.Lookup(store).find(np.sort(keys + np.uint64(1)))[0].any()
    none = hash_store.write_store(rows.limit(0), "test")
    assert not hash_store.Lookup(none).find(np.sort(keys))[0].any()
