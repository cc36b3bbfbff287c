"""Pairs in rounds of blocks, and the gate's near copies without shuffled bodies."""

import itertools
import random

import numpy as np
import pytest

from lodestack.operators import gate, vector
from lodestack.plans import queries as core
from oracle import SF


@pytest.mark.parametrize("block_rows", [1, 5, 7, 100])
def test_every_pair_once(spark, monkeypatch, block_rows):
    r = random.Random(3)
    rows = [(i, r.choice(["k", "k", "m", None]), i % 3, [r.randint(-2, 2) for _ in range(4)]) for i in range(40)]
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, _, v in rows}
    want = {(a[0], b[0], a[1], a[2] == b[2]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and unit[a[0]] @ unit[b[0]] > 0.8}
    sizes, kept = [], vector.cut
    monkeypatch.setattr(vector, "cut", lambda df: sizes.append(df.columns) or kept(df))
    v = spark.createDataFrame(rows, "id long, kind string, scope int, embedding array<int>")
    got = [(r.a, r.b, r.kind, r.same_scope) for r in vector.similar_pairs(v, 0.8, block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    # what a job ships is bounded: more blocks make more jobs
    jobs = sum(c[0] == "a" for c in sizes)
    assert jobs == 1 if block_rows >= 7 else jobs > 1
    firsts = {}
    for r in vector.similar_pairs(v, 0.8, block_rows, least=True).collect():
        firsts[r.b] = min(firsts.get(r.b, r.a), r.a)
    assert firsts == {b: min(a for a, x, *_ in want if x == b) for _, b, *_ in want}


def test_one_near_copy_is_enough(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [("n1", 1, words), ("n2", 2, words + " more"), ("n3", 3, words), ("n4", 4, words + " most"), ("n5", 5, "else entirely"), ("n6", 6, words + " most")]
    notes = spark.createDataFrame([(n, s, "semantic", "p", b) for n, s, b in rows], "note_id string, seq long, type string, scope string, body string")
    got = {r.note_id: r.similar for r in gate.near_copies(notes, every=False).collect()}
    assert set(got) == {r.note_id for r in gate.near_copies(notes).collect()} == {"n2", "n3", "n4", "n6"}
    assert got["n2"] == got["n4"] == ["n1"]


@pytest.mark.parametrize("name", ["write_plan_near", "gate_rules_near", "gate_totals_near"])
def test_no_body_is_shuffled(spark, name):
    """Bodies are left behind before candidates meet labels and near copies."""
    assert "body#" not in core.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
