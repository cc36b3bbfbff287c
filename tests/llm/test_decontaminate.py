import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import decontaminate as dc

RNG = random.Random(4)
WORDS = ["the", "that", "tion", "ing", "ent", "with", "ou", "re", "Über", "an"]


def text(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(WORDS) for _ in range(n))


def distance(item, region):
    """Edit distance of the item to the best part of the region."""
    row = np.zeros(len(region) + 1, int)
    step = np.arange(len(region) + 1)
    other = np.array([ord(c) for c in region])
    for i, ch in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (other != ord(ch)), row[1:] + 1)])
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def mutated(item, edits):
    chars = list(item)
    for _ in range(edits):
        at, kind = RNG.randrange(len(chars)), RNG.random()
        if kind < 0.4:
            chars[at] = RNG.choice("xyzq")
        elif kind < 0.7:
            del chars[at]
        else:
            chars.insert(at, RNG.choice("xyzq"))
    return "".join(chars)


@pytest.mark.parametrize("blocks", [10**9, 300])
def test_equals_brute_force(spark, blocks):
    items = [(i, text(RNG.randint(8, 30))) for i in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for i in range(60):
        body = text(RNG.randint(0, 120))
        if i % 3 == 0:
            item = RNG.choice(items[:12])[1]
            body = f"{body} {mutated(item, RNG.randint(0, int(0.14 * len(item))))}\n {text(10)}"
        docs.append((i, body))
    docs += [(100, None), (101, ""), (7, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, r.distance) for r in dc.find_leaks(d, b, block_chars=blocks).collect())
    want, dirty = [], set()
    for i, body in docs:
        for k, item in items:
            n = dc.normalise(item or "")
            if n and body is not None and (x := distance(n, dc.normalise(body))) <= dc.budget(len(n), 0.1):
                want.append((i, k, x))
                dirty.add((i, body))
    assert got == sorted(want) and len(got) > 10
    kept = dc.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if (i, t) not in dirty)


@pytest.mark.parametrize("length", range(1, 61))
def test_items_of_every_length_are_found(length):
    """Evenly spaced edits inside the budget hide nothing; the index equals a search of all regions."""
    rng = random.Random(length)
    letters = "abcdefghijklmnop"
    for trial in range(12):
        item = "".join(rng.choice(letters) for _ in range(length))
        edits = dc.budget(length, 0.1) + (trial % 4 == 3)  # every fourth goes over
        chars = list(item)
        for e in range(edits):
            at = (2 * e + 1) * length // (2 * edits)
            chars[at] = ("#", "", chars[at] + "#")[(trial + e) % 3]
        around = ["".join(rng.choice("qrstuvwxyz") for _ in range(40)) for _ in range(2)]
        text = around[0] + "".join(chars) + around[1]
        want = distance(item, text)
        got = dc.Items([(1, item), (2, ""), (3, "  ")], 8, 0.1).leaks(text)
        if want <= dc.budget(length, 0.1):
            assert [(i, d) for i, d, _ in got] == [(1, want)]
        else:
            assert not got


def test_a_long_text_that_quotes_much_takes_linear_time(spark):
    import time

    items = [(i, text(12)) for i in range(40)]
    parts = [items[i % 40][1] + " " + text(3) for i in range(6000)]
    seconds = []
    for n in (1500, 6000):
        body, began = " ".join(parts[:n]), time.time()
        found = dc.Items(items, 8, 0.1).leaks(body)
        seconds.append(time.time() - began)
        assert {i for i, d, _ in found if d == 0} == set(range(40))
    assert seconds[1] < 10 * seconds[0] + 1
    docs = spark.createDataFrame([(1, body), (2, "z" * 1_000_000), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in dc.drop_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()] == [2, 3]


def test_empty(spark):
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(d, b).count() == 0 and dc.drop_leaks(d, b).count() == 1
    assert dc.drop_leaks(d.limit(0), b).count() == 0


def test_case_and_white_space_do_not_hide_a_leak(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank."
    d = spark.createDataFrame([(1, "x " + item.upper().replace(" ", " \n ") + " y"), (2, "nothing of it")], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in dc.find_leaks(d, b).collect()] == [(1, 5, 0)]
