"""The chain of stages against brute force, on rows of every odd kind."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_decontaminate import distance
from test_ngram_join import grams, roots

import corpus_pipeline
from lodestack.llm import decontaminate as dc, mixing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key long"


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, range(300, 0, -1), k=n)) + "."
    items = [(i, prose(14)) for i in range(4)] + [(9, None), (10, "")]
    rows = [(i, prose(rng.randint(30, 90)), "en", f"s{i % 3}") for i in range(110)]
    rows += [(200 + i, rows[i][1] + " and more", "en", "s0") for i in range(8)]  # near copies
    rows += [(300 + i, rows[20][1], "en", "s1") for i in range(12)]  # exact copies
    rows += [(400 + i, f"{prose(30)} {items[i % 4][1]} {prose(20)}", "en", "s2") for i in range(6)]  # leaks
    rows += [(500 + i, " ".join("".join(rng.choice("#$%ZQXW") for _ in range(9)) for _ in range(40)), "en", "s0") for i in range(3)]  # junk
    rows += [(600, None, "en", "s0"), (601, "", None, None), (602, "too short", "en", "s1"), (603, "over and " * 60, "en", "s1"), (None, prose(40), "en", None), (604, prose(40), None, "s2")]
    rows += [(700, prose(60_000), "en", "s2")]  # very long
    rows += [rows[0]] * 3 + [(1, prose(50), "en", "s1")]  # repeated rows, and an id with two texts
    rng.shuffle(rows)
    return [(*r, len(r[1] or ""), 5) for r in rows], items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, items = documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(500, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_the_chain_equals_its_parts(spark, folder):
    rows, items = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality.assess(docs, labels=spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [r for r in rows if verdict[r[0], len((r[1] or "").split())]]
    assert not any(r[0] in (500, 501, 502, 600, 601, 602, 603) for r in left) and sum((r[0] or 0) < 110 for r in left) > 100
    classes = collections.defaultdict(list)
    for row, root in zip(left, roots([r[:2] for r in left]), strict=True):
        classes[root].append(row)
    once = [min(mine, key=lambda r: (r[0] is None, r[0] or 0)) for mine in classes.values()]
    clean = []
    for r in once:
        text = dc.normalise(r[1])
        near = [dc.normalise(t) for _, t in items if t]
        # the very long text is drawn word by word and quotes nothing
        if r[0] == 700 or not any(distance(t, text) <= dc.budget(len(t), 0.1) for t in near):
            clean.append(r)
    assert len(once) < len(left) and len(clean) < len(once) and all(len(grams(r[1])) for r in clean)
    plan = mixing.plan_mix(spark.createDataFrame(clean, COLUMNS))
    copies = {(r.doc_id, r.source, r.size): r.copies for r in plan.collect()}
    want = collections.Counter({r: n for r in clean if (n := copies[r[0], r[3], len(r[1].split())])})
    out = corpus_pipeline.run(spark, folder)
    got = out.collect()
    assert collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r._key) for r in got) == want
    assert max(copies.values()) > 1
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_every_stage_keeps_the_columns_and_takes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), folder)
        assert none.count() == 0, name
        assert none.columns[: len(docs.columns)] == docs.columns, name
    nothing = docs.where("doc_id = 600").withColumn("lang", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, folder).columns[:2] == ["doc_id", "text"]
