import collections
import math
import random

import pytest
from test_wordmodel import Plain, discounts

from lodestack.llm import quality as q


class PlainBigrams:
    """The whole model of one language with dictionaries."""

    def __init__(self, texts):
        self.copies = collections.Counter(texts)
        self.pairs = collections.Counter(g for t in texts for g in set(self.grams(t)))
        self.d = discounts(self.pairs.values())
        self.follow = collections.defaultdict(list)
        for (a, _), n in self.pairs.items():
            self.follow[a].append(n)
        self.before = collections.Counter(b for _, b in self.pairs)
        self.cut = discounts(self.before.values())
        self.spelt = Plain(texts)

    @staticmethod
    def grams(text):
        words = ["", *text.split()]
        return list(zip(words, words[1:], strict=False))

    def word(self, w, out):
        n, total, d = self.before[w], sum(self.before.values()), self.cut
        left = sum(d[min(x, 3)] for x in self.before.values())
        rest = n - out
        spelt = math.prod(self.spelt.char(g, out and not rest) for g in Plain.grams(w))
        novel = (spelt + 1 / (len(self.before) + 1)) / 2
        return max(rest - d[min(rest, 3)], 0) / (total - out) + (left - d[min(n, 3)] + d[min(rest, 3)]) / (total - out) * novel

    def logp(self, text):
        d, k, sums = self.d, self.copies[text], []
        for a, b in self.grams(text):
            n, total, left = self.pairs[a, b], sum(self.follow[a]), sum(d[min(x, 3)] for x in self.follow[a])
            rest = n - k
            below = self.word(b, rest == 0)
            p = (max(rest - d[min(rest, 3)], 0) + (left - d[min(n, 3)] + d[min(rest, 3)]) * below) / (total - k) if total > k else 0
            sums.append(math.log(p or below))
        return sums


def some_texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(vocabulary, range(40, 0, -1), k=rng.randint(1, 25))) for _ in range(60)]
    return texts + texts[:5] + texts[:2] + ["a a a a a a", "solo"]


def test_bigrams_equal_dictionaries(spark):
    texts = some_texts()
    plain = PlainBigrams(texts)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000 + i, t + " zzz", "y") for i, t in enumerate(texts)] + [(2000, None, "x"), (2001, " \n", None)]
    got = {r.doc_id: r for r in q.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order=2).collect()}
    assert len(got) == len(rows) and got[2000].n == got[2001].n == got[2001].logp == 0
    for i, t in enumerate(texts):
        want = plain.logp(t)
        assert got[i].n == len(want) and got[i].logp / 1e6 == pytest.approx(sum(want), abs=1e-3)
        assert got[i].logp2 / 1e3 == pytest.approx(sum(x * x for x in want), abs=0.1)


def test_small_blocks_and_spread_histories_change_nothing(spark, monkeypatch):
    from lodestack.llm import bigrams as b

    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some_texts())], "doc_id long, text string, lang string")
    want = sorted(map(tuple, q.score(docs, order=2).collect()))
    for name, value in (("LOOKED_UP", 40), ("HELD", 50), ("BUCKET", 16), ("FREQUENT", 3)):
        monkeypatch.setattr(b, name, value)
    assert sorted(map(tuple, q.score(docs.repartition(5), order=2).collect())) == want


def test_words_in_reverse_order_go(spark):
    """Texts of well-spelt words in an order that the language has not."""
    rng = random.Random(5)
    vocabulary = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    follow = {w: rng.sample(vocabulary, 4) for w in vocabulary}

    def prose(n):
        said = [rng.choice(vocabulary)]
        while len(said) < n:
            said.append(rng.choice(follow[said[-1]]))
        return said

    good = [prose(rng.choice((40, 60, 80))) for _ in range(300)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(good)] + [(1000 + i, " ".join(prose(60)[::-1]), "en") for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    judged = q.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels=labels).where("not base_failed").collect()
    good, bad = ([r.kept for r in judged if (r.doc_id >= 1000) == x] for x in (False, True))
    assert len(good) > 280 and sum(good) >= len(good) - 3 and len(bad) == 10 and not any(bad)


def test_only_what_is_read_later_stays_on_disk(spark):
    """Tables that a later one has used up go at once, as do shuffle files; the session's settings stay."""
    import os

    from lodestack.llm import workspace

    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some_texts())], "doc_id long, text string, lang string")
    folder = workspace.shared_dir(spark).removeprefix("file:")
    kinds = lambda: collections.Counter(f.rsplit("-", 5)[0].rsplit("-", 1)[0] if "-" in f else f for f in os.listdir(folder))
    before, setting = kinds(), spark.conf.get(workspace._CLEANUP, None)
    assert q.assess(docs).count() == docs.count()
    new = kinds() - before
    assert new["words"] == new["pairs"] == new["scored"] == 1
    assert not set(new) & {"grams", "spelt", "spelling", "numbers", "bigrams", "table", "discounts", "scratch"}
    assert spark.conf.get(workspace._CLEANUP, None) == setting and spark.sparkContext.getLocalProperty(workspace._SCRATCH) is None


def test_scores_take_bounded_memory(spark):
    """What a task holds beyond its rows does not follow their number."""
    import tracemalloc

    import pyarrow as pa

    from lodestack.llm import bigrams as b

    texts = some_texts()
    model = b.model(spark.createDataFrame([(t, "=x") for t in texts], "text string, lang string"))
    many = [" ".join(random.Random(i).sample(texts, 40)) for i in range(1500)]
    known = pa.array([0] * len(many), pa.int64())
    batch = pa.RecordBatch.from_arrays([known, known, pa.array(many), pa.array(["=x"] * len(many)), known], ["doc_id", "row_key", "text", "lang", "text_key"])
    tracemalloc.start()
    rows = sum(r.num_rows for r in b.scorer(model, q.base_columns, (*q.BASE, *q.SUMS))(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(many) and sum(len(t.split()) for t in many) > 600_000 and peak < 64e6
