import itertools

import duckdb
import numpy as np
from oracle import SF

from lodestack.operators import embed, gate
from lodestack.plans import queries as core


def test_near_copies(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "semantic", "p", words), (2, "semantic", "p", words + " more"), (3, "semantic", "p", words), (4, "semantic", "q", words), (5, "procedural", "p", words), (6, "episodic", "p", words), (7, "semantic", "p", "something else entirely"), (8, "semantic", None, words)]
    notes = spark.createDataFrame([(f"n{i}", i, *r) for i, *r in rows], "note_id string, seq long, type string, scope string, body string")
    got = {r.note_id: r.similar for r in gate.near_copies(notes).collect()}
    assert got == {"n2": ["n1"], "n3": ["n1", "n2"]}


def test_registered_gates_find_every_duplicate(spark):
    """All pairs compared one by one."""
    docs = duckdb.sql(f"SELECT doc_id, CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'procedural' END AS type, source, text FROM '{SF}/documents.parquet' WHERE lang IN ('en', 'de') ORDER BY doc_id").fetchall()
    unit = {r[0]: embed.hash_vector(r[3]) for r in docs}
    late = {f"d{b[0]}" for a, b in itertools.combinations(docs, 2) if a[1:3] == b[1:3] and (a[3] == b[3] or float(np.dot(unit[a[0]], unit[b[0]])) > 0.92)}
    known = {f"d{r[0]}" for r in docs if r[2] not in ("src18", "src19")}
    got = core.QUERIES["gate_rules_near"](spark, SF)
    found = {r.note_id for r in got.where("check = 'duplicate'").collect()}
    assert found == late & known and found
    planned = {r.note_id for r in core.QUERIES["write_plan_near"](spark, SF).collect()}
    before = {r.note_id for r in core.QUERIES["write_plan"](spark, SF).collect()}
    assert planned == before - found and planned < before
