import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", ["", " \n\t", "a b c d e", "a b c d e a b c d e", "x\nx\n\n \nx\r\nx", "é#ü $$ <b> c", "a " * 300, "a b c d e f " * 3 + "g"])
def test_base_counts(text):
    assert q.base_counts(text) == base(text)


def test_base_counts_of_many_texts_at_once():
    """Texts that stand side by side share no word, window or line."""
    from lodestack.llm.grams import word_hashes, words_of

    rng = random.Random(3)
    texts = ["", "a b c", "a b c d e", "a b c d e", " \n", "x" * 70_000 + " y", "é#ü\né#ü\x1f a"]
    texts += ["".join(rng.choice("ab#é \n\t") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    words = words_of(texts)
    assert list(zip(*(c.tolist() for c in q.base_columns(texts, words)), strict=True)) == [base(t) for t in texts]
    assert words.hashes.tolist() == [h for t in texts for h in word_hashes(t).tolist()]


def corpus(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    good = [(i, " ".join(rng.choices(vocab, k=rng.randint(20, 60))) + ".", "en" if i % 2 else "de") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(rng.choice("zqxvw#%$!Z") for _ in range(7)) for _ in range(30)), "en") for i in range(5)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "a short one", None), (2003, "same same same same same same " * 5, "de"), (2004, good[1][1], "en"), (1, good[1][1], "en")]
    return spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))


def test_rules_and_bands(spark):
    docs = corpus(spark)
    rows = q.assess(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].kept for i in range(300)) and not any(by_id[1000 + i].kept for i in range(5))
    assert not any(by_id[1000 + i].base_failed for i in range(5)) and by_id[2003].base_failed
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (2000, 2001, 2002))
    assert by_id[2000].log_perplexity is None and by_id[2001].log_perplexity is None
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_mapped_and_joined_models_agree(spark):
    docs = corpus(spark).union(spark.createDataFrame([(3000, "z" * 200_000 + " ab" * 50_000, "en", "clash"), (3001, None, None, "clash"), (3002, "x y", "", "clash")], "doc_id long, text string, lang string, kept string"))
    mapped, joined = (sorted(map(tuple, q.score(docs, map_rows=m).collect()), key=str) for m in (10**9, 0))
    assert mapped == joined and len(mapped) == docs.count()
    # null and empty are languages of their own
    assert {r.lang for r in q.score(docs).where("doc_id in (2001, 3001, 3002)").collect()} == {"", "="}


def test_labels_set_the_bands(spark):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000, 0), (None, 1)], "doc_id long, quality int").withColumn("lang", F.lit("clash"))
    wide, fitted = (q.assess(docs, labels=x).where("doc_id < 300").agg(F.max(F.col("high") - F.col("low")), F.count_if("kept")).first() for x in (None, labels))
    assert fitted[0] < wide[0] and fitted[1] >= 297
    few = q.assess(docs, labels=labels.limit(5)).where("doc_id < 300").agg(F.max(F.col("high") - F.col("low"))).first()
    assert few[0] == wide[0]


def test_empty(spark):
    none = corpus(spark).limit(0)
    assert q.assess(none).count() == 0 and q.keep_good(none).count() == 0
