import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lodestack.config import Agent, Manifest, Scopes
from lodestack.operators import gate, segments
from lodestack.plans import index_run, write_run
from lodestack.sources import note_files, notes

MANIFEST = Manifest(scopes=Scopes(known=("p",)), agents=(Agent("x", ("tutor",)),))
SCHEMA = "note_id string, type string, scope string, agent string, profile string, confidence string, source string, title string, body string, tags array<string>, keys array<string>, supersedes array<string>, evidence array<string>, merge boolean"
NOW = dt.datetime(2024, 6, 1, 10, 30)


def row(note_id, kind, title, body="text", **more):
    base = dict(note_id=note_id, type=kind, scope="p", agent="x", profile=None, confidence="medium", source="s: 1", title=title, body=body, tags=["#own"], keys=[], supersedes=[], evidence=[], merge=False)
    return tuple((base | more).values())


def put(root, name, text):
    at = os.path.join(root, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def vault(tmp_path):
    root = str(tmp_path / "vault")
    put(root, "Semantic/old.md", "---\ntitle: Old\nstatus: ativo\n---\nwords of old\n")
    put(root, "Episodic/x/mem.md", "---\ntitle: M\n---\nhistory\n")
    put(root, "Semantic/2024-06-01_INS_same.md", "there already\n")
    return root


def test_store(spark, vault, tmp_path):
    index = str(tmp_path / "index")
    index_run.run(spark, index, note_files.notes(spark, vault, contents=False), note_files.read_contents)
    rows = [
        row("c1", "semantic", "Same", supersedes=["[[old]]", "mem", "nowhere"], profile="tutor"),
        row("c2", "semantic", "Same"),
        row("c3", "procedural", "Do it", "# Steps\n\nfirst", evidence=["ran twice", " "]),
        row("c4", "episodic", "It was"),
        row("bad", "semantic", "No scope", scope="zzz"),
    ]
    judged = gate.evaluate(spark.createDataFrame(rows, SCHEMA), MANIFEST)
    done = write_run.store(judged, vault, NOW, ["kb"], index)
    paths = {r.note_id: r.path[len(vault) + 1 :] for r in done.notes.collect()}
    assert paths["c3"] == "Procedural/PROC_do-it.md" and paths["c4"] == "Episodic/x/2024-06-01_MEM_it-was.md"
    assert {paths["c1"], paths["c2"]} == {"Semantic/2024-06-01_INS_same-2.md", "Semantic/2024-06-01_INS_same-3.md"} and "bad" not in paths
    assert {(r.target, r.action) for r in done.replaced.collect()} == {("old", "archive"), ("mem", "keep"), ("nowhere", "missing")}
    read = lambda n: open(os.path.join(vault, n), encoding="utf-8").read()
    assert read("Semantic/old.md") == "---\ntitle: Old\nstatus: arquivado\n---\nwords of old\n" and "status" not in read("Episodic/x/mem.md")
    assert read("Semantic/2024-06-01_INS_same.md") == "there already\n"
    files = note_files.notes(spark, vault).select("path", notes.decoded(F.col("content")).alias("text"))
    parsed = {r.path[len(vault) + 1 :]: r for r in notes.parse_notes(files).collect()}
    one, proc = parsed[paths["c1"]], parsed[paths["c3"]]
    assert (one.title, one.tags, one.supersedes, one.status, one.profile, one.source) == ("Same", ["mem/semantic", "agent/x", "kb", "own"], ["[[old]]", "[[mem]]", "[[nowhere]]"], "ativo", "tutor", "s: 1")
    assert one["keys"] == ["title", "tags", "created", "modified", "agent", "profile", "scope", "source", "confidence", "last_accessed", "supersedes", "status"]
    assert one.created.startswith("2024-06-01 10:30:00") and proc.last_tested.startswith("2024-06-01") and proc.body == "# Steps\n\nfirst\n\n## Evidência\n\n- ran twice\n"
    assert done.index.indexed == 5 and not done.index.full
    chunks = {r.note_id: r for r in segments.chunks(spark, segments.open_index(spark, index)).collect()}
    assert len(chunks) == 7 and chunks["old"].status == "arquivado" and chunks["PROC_do-it"].type == "procedural"
    # the index is what a run over all files makes
    whole = str(tmp_path / "whole")
    index_run.run(spark, whole, note_files.notes(spark, vault, contents=False), note_files.read_contents)
    full = lambda p: sorted(map(str, segments.chunks(spark, segments.open_index(spark, p)).select("chunk_id", "text", "status", "scope").collect()))
    assert full(index) == full(whole)


def test_nothing_accepted(spark, vault):
    before = sorted(os.listdir(os.path.join(vault, "Semantic")))
    judged = gate.evaluate(spark.createDataFrame([row("bad", "semantic", "x", scope="")], SCHEMA), MANIFEST)
    done = write_run.store(judged, vault, NOW)
    assert done.notes.count() == done.replaced.count() == 0 and done.index is None
    assert sorted(os.listdir(os.path.join(vault, "Semantic"))) == before
