"""The chain's first stage judges the order of words."""

import random

import corpus_pipeline


def test_texts_in_reverse_order_leave_the_chain(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    follow = {w: rng.sample(vocabulary, 6) for w in vocabulary}

    def prose(n):
        said = [rng.choice(vocabulary)]
        while len(said) < n:
            said.append(rng.choice(follow[said[-1]]))
        return said

    rows = [(i, " ".join(prose(50)), "en", "s", 0) for i in range(300)] + [(1000 + i, " ".join(prose(50)[::-1]), "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[0]
    kept = [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()]
    assert name == "quality rules" and sum(i < 1000 for i in kept) > 280 and max(kept) < 1000
