"""Changeable postings, the run from a listing to a stored index, and notes as files."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestack.operators import embed, lexical, maintain, segments
from lodestack.plans import consolidate, index_run
from lodestack.sources import note_files, notes

SCHEMA = "chunk_id string, note_id string, text string"


def chunk(i, text, part=0):
    return (f"n{i}#{part}", f"n{i}", text)


def scores(df):
    return {r.chunk_id: round(r.score, 9) for r in df.collect()}


def test_scores_after_changes(spark, tmp_path):
    """An index that was changed scores like one made anew, and like the plain scan."""
    path, query = str(tmp_path / "i"), "alpha beta gamma für"
    rows = {i: [chunk(i, f"alpha {'beta ' * (i % 4)} {'gamma' if i % 3 else 'fur'} w{i}", p) for p in range(1 + i % 2)] for i in range(60)}
    frame = lambda ids: spark.createDataFrame([c for i in ids for c in rows[i]], SCHEMA)
    segments.upsert(spark, path, frame(range(50)))
    for i in (3, 4, 55):
        rows[i] = [chunk(i, "beta beta alpha new"), chunk(i, "für", 7)]
    segments.upsert(spark, path, frame([3, 4, 55]))
    rows[5] = [chunk(5, None), chunk(5, "", 1)]
    segments.upsert(spark, path, frame([5]))
    for i in (0, 3, 11):
        del rows[i]
    segments.delete(spark, path, spark.createDataFrame([("n0",), ("n3",), ("n11",), ("none",)], "note_id string"))
    rows[3] = [chunk(3, "gamma again")]
    stored = segments.upsert(spark, path, frame([3]))
    now = frame([i for i in rows if i < 50 or i == 55])
    assert stored.chunks == now.count() and len(stored.segments) == 5
    lexical.write_index(now, str(tmp_path / "whole"))
    want = scores(lexical.bm25(now, query))
    assert scores(segments.bm25(spark, stored, query)) == want == scores(lexical.bm25_stored(spark, str(tmp_path / "whole"), query))
    keep = now.where("note_id >= 'n5'")
    assert scores(segments.bm25(spark, stored, query, keep)) == {k: v for k, v in want.items() if k >= "n5"}
    assert scores(segments.bm25(spark, stored, "!?")) == {}
    merged = segments.merge(spark, path)
    assert len(merged.segments) == 1 and scores(segments.bm25(spark, merged, query)) == want
    # a reader of the older version is not disturbed until it expires
    assert scores(segments.bm25(spark, stored, query)) == want
    assert len(segments.expire(spark, path)) == 10 and scores(segments.bm25(spark, segments.open_index(spark, path), query)) == want
    assert sorted(r.note_id for r in segments.chunks(spark, merged).select("note_id").collect()) == sorted(r.note_id for r in now.collect())


def test_a_write_touches_its_segment_only(spark, tmp_path):
    path = str(tmp_path / "i")
    segments.upsert(spark, path, spark.createDataFrame([chunk(i, "a b") for i in range(9)], SCHEMA))
    seen = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names)}
    stored = segments.upsert(spark, path, spark.createDataFrame([chunk(1, "c")], SCHEMA))
    assert all(os.stat(f).st_mtime_ns == t for f, t in seen.items())
    assert (stored.chunks, stored.tokens) == (9, 17)
    # a version that was not finished does not count
    os.makedirs(f"{path}/versions/v=9")
    assert segments.open_index(spark, path).version == 2


def test_terms_read_their_folders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_CHUNKS", 1)
    path = str(tmp_path / "i")
    stored = segments.upsert(spark, path, spark.createDataFrame([chunk(i, f"word{i} common") for i in range(40)], SCHEMA))
    rows = segments.postings(spark, stored, ["word7"])
    assert [r.term for r in rows.collect()] == ["word7"]
    assert len(rows.inputFiles()) == len(segments.postings(spark, stored).inputFiles())  # one relation, pruned by bucket
    assert "bucket" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


NOTE = "---\ntitle: {t}\nscope: s{s}\nstatus: ativo\ntags: [mem/semantic, x]\n---\n# Head\n\nBody of {t} with words.\n"


def put(root, name, text):
    at = os.path.join(root, name)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w", encoding="utf-8") as f:
        f.write(text)


def same_index(spark, a, b):
    """Both indexes hold the same chunks, vectors, postings and state."""
    kinds = [segments.chunks, segments.postings, lambda s, i: segments.state(s, i).drop("mtime")]
    for kind in kinds:
        rows = [sorted(map(str, (r.asDict(recursive=True).items() for r in kind(spark, i).select(*sorted(kind(spark, i).columns)).collect()))) for i in (a, b)]
        assert rows[0] == rows[1] and rows[0]


def test_run_from_files(spark, tmp_path):
    root, path = str(tmp_path / "vault"), str(tmp_path / "index")
    for i in range(12):
        put(root, f"Semantic/n{i}.md", NOTE.format(t=f"Title {i}", s=i % 3))
    put(root, "Procedural/n3.md", "# loses\n\nnothing")
    put(root, "z/n5.md", "loses too")
    put(root, "empty.md", "")
    put(root, "bad.md", "---\n[x\n---\nstill indexed")
    put(root, ".hidden.md", "no")
    opened = []

    def read(paths):
        opened.append(sorted(os.path.basename(r.path) for r in paths.collect()))
        return note_files.read_contents(paths)

    listed = lambda: note_files.notes(spark, root, contents=False)
    run = lambda **kw: index_run.run(spark, path, listed(), read, **kw)
    first = run()
    assert first.full and first.indexed == 14 and first.ambiguous == 2 and first.chunks_written == first.chunks_total == 13
    files = len(os.listdir(path)), len(os.listdir(f"{path}/versions"))
    opened.clear()
    again = run()
    assert (again.indexed, again.unchanged, again.chunks_written) == (0, 14, 0) and again.ambiguous == 2 and not opened
    assert (len(os.listdir(path)), len(os.listdir(f"{path}/versions"))) == files
    # new, changed, touched, removed, and a winner that hands its name over
    put(root, "Semantic/n20.md", NOTE.format(t="New", s=1))
    put(root, "Semantic/n1.md", NOTE.format(t="Changed", s=1))
    os.utime(os.path.join(root, "Semantic/n2.md"), (time.time() + 60,) * 2)
    os.remove(os.path.join(root, "Semantic/n4.md"))
    os.remove(os.path.join(root, "Procedural/n3.md"))
    third = run()
    assert (third.full, third.indexed, third.touched, third.removed, third.unchanged) == (False, 3, 1, 2, 10)
    assert opened == [["n1.md", "n2.md", "n20.md", "n3.md"], ["n1.md", "n20.md", "n3.md"]]
    whole = str(tmp_path / "whole")
    index_run.run(spark, whole, listed(), note_files.read_contents)
    now = segments.open_index(spark, path)
    same_index(spark, now, segments.open_index(spark, whole))
    state = {r.note_id: r for r in segments.state(spark, now).collect()}
    assert state["n3"].path.endswith("Semantic/n3.md") and state["empty"].chunks == 0 and "n4" not in state
    rows = {r.note_id: r for r in segments.chunks(spark, now).collect()}
    assert rows["n1"].title == "Changed" and rows["n1"].type == "semantic" and rows["n1"].scope == "s1" and rows["bad"].type is None
    assert rows["n1"].embedding == pytest.approx(embed.hash_vector(rows["n1"].text).tolist())
    opened.clear()
    assert run(settings={"max_chars": 300}).full and len(opened[0]) == 14
    assert not run(settings={"max_chars": 300}).full
    with pytest.raises(ValueError):
        run(partial=True)


def test_single_notes(spark, tmp_path):
    root, path = str(tmp_path / "vault"), str(tmp_path / "index")
    for i in range(3):
        put(root, f"n{i}.md", NOTE.format(t=f"T{i}", s=0))
    listed = note_files.notes(spark, root, contents=False)
    index_run.run(spark, path, listed, note_files.read_contents)
    put(root, "n1.md", NOTE.format(t="Other", s=0))
    done = index_run.run(spark, path, listed.where("path like '%n1.md'"), note_files.read_contents, partial=True)
    assert (done.indexed, done.removed, done.chunks_deleted, done.chunks_total) == (1, 0, 1, 3)
    assert {r.title for r in segments.chunks(spark, segments.open_index(spark, path)).collect()} == {"T0", "Other", "T2"}
    left = index_run.remove_notes(spark, path, spark.createDataFrame([("n0",)], "note_id string"))
    assert left.chunks == 2 and {r.note_id for r in segments.state(spark, left).collect()} == {"n1", "n2"}


def test_notes_source(spark, tmp_path):
    root = str(tmp_path / "v")
    for name in ("a/x.md", "a/y.md", "b/x.md", ".dot/z.md", "b/.h.md", "b/t.txt"):
        put(root, name, name)
    late = dt.datetime(2031, 1, 1, tzinfo=dt.timezone.utc)
    os.utime(os.path.join(root, "a/y.md"), (late.timestamp(),) * 2)
    df = note_files.notes(spark, root)
    assert {r.path[len(root) + 1 :]: bytes(r.content).decode() for r in df.collect()} == {n: n for n in ("a/x.md", "a/y.md", "b/x.md", ".dot/z.md")}
    assert note_files.notes(spark, root, dotfolders="false").count() == 3
    assert note_files.notes(spark, root, contents=False).where("content is not null").count() == 0
    assert note_files.notes(spark, str(tmp_path / "none")).count() == 0
    some = df.where(F.col("path").startswith(f"{root}/a/") & (F.col("mtime") > F.lit(dt.datetime(2030, 1, 1))))
    assert [r.path for r in some.collect()] == [f"{root}/a/y.md"]
    assert "Filter (" not in some._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))  # all of it is pushed
    # what is pushed is not opened: contents that cannot be read do no harm
    reader = note_files.NotesReader({"path": root})
    left = list(reader.pushFilters([note_files.StringStartsWith(("path",), f"{root}/a/x"), note_files.EqualTo(("content",), b"")]))
    assert len(left) == 1 and [f[0] for f in reader.files()] == [f"{root}/a/x.md"]


def test_notes_writer(spark, tmp_path):
    root = str(tmp_path / "v")
    put(root, "a/x.md", "same")
    put(root, "a/y.md", "old")
    os.utime(os.path.join(root, "a/x.md"), (1,) * 2)
    rows = spark.createDataFrame([("a/x.md", "same"), ("a/y.md", "new"), (f"{root}/c/d/z.md", "made")], "path string, content string")
    note_files.write_notes(rows, root)
    read = lambda n: open(os.path.join(root, n)).read()
    assert (read("a/y.md"), read("c/d/z.md"), os.stat(os.path.join(root, "a/x.md")).st_mtime) == ("new", "made", 1)
    # a task that fails leaves all files as they were, and nothing beside them
    bad = rows.repartition(3).withColumn("content", F.when(F.col("path").contains("z.md"), F.raise_error(F.lit("no")).cast("string")).otherwise("broken"))
    with pytest.raises(Exception):
        note_files.write_notes(bad, root)
    assert read("a/y.md") == "new" and read("a/x.md") == "same"
    assert sorted(n for _, _, names in os.walk(root) for n in names) == ["x.md", "y.md", "z.md"]


def test_front_matter_in_columns(spark):
    words = ["plain", "yes", "No", "true", "12", "a: b", "it's", 'say "hi"', "# x", "- y", "[[l#h|a]]", "été", "back\\slash", " lead", "trail ", "", "2024-01-01x", "x: ", "a, b", "@at", "multi\nline", "null", "~", "c:"]
    df = spark.createDataFrame([(f"v/n{i}.md", w, [w, "b"], dt.date(2024, 1, 2) if i else None, f"\n\nBody {i}\n\n") for i, w in enumerate(words)], "path string, title string, tags array<string>, created date, body string")
    files = df.select("path", notes.rendered(df, ["title", "tags", "created"]).alias("text"))
    back = {r.path: r for r in notes.parse_notes(files).collect()}
    for i, w in enumerate(words):
        r = back[f"v/n{i}.md"]
        assert not r.malformed and r.title == w and r.created == ("2024-01-02" if i else None) and r.body == f"Body {i}\n", w


def test_patched_heads(spark):
    texts = {
        "head": "---\ntitle: T\nstatus: ativo\nextra:\n  - 1\n  - 2\n---\nbody\n",
        "list": "---\nsuperseded_by:\n- a\n- b\nz: 1\n---\nbody status: x\n",
        "none": "status: no head\n",
        "null": "---\nstatus: ativo\n---\n",
    }
    df = spark.createDataFrame([*texts.items()], "k string, text string")
    value = F.when(F.col("k") != "null", F.lit("arqui$1v\\ado"))
    got = {r.k: r.t for r in df.select("k", notes.patched(F.col("text"), {"status": value, "superseded_by": F.when(F.col("k") == "list", notes.yaml_value(F.array(F.lit("[[n]]")), "array<string>"))}).alias("t")).collect()}
    assert got["head"] == "---\ntitle: T\nstatus: arqui$1v\\ado\nextra:\n  - 1\n  - 2\n---\nbody\n"
    assert got["list"] == '---\nsuperseded_by: ["[[n]]"]\nz: 1\nstatus: arqui$1v\\ado\n---\nbody status: x\n'
    assert got["none"] == "---\nstatus: arqui$1v\\ado\n---\nstatus: no head\n" and got["null"] == texts["null"]


def test_cycle_lands_in_files(spark, tmp_path):
    """What a cycle archives, deprecates and stamps is in the files after it, and nothing else is."""
    root = str(tmp_path / "v")
    put(root, "Semantic/old.md", "---\ntitle: Old\nstatus: ativo\ncreated: 2020-01-01\nextra: {a: 1}\n---\nbody\n")
    put(root, "Semantic/read.md", "---\ntitle: Read\ncreated: 2020-01-01\n---\nbody\n")
    put(root, "Procedural/p1.md", "---\nstatus: ativo\ncreated: 2024-05-01\n---\nsteps\n")
    put(root, "Procedural/p2.md", "---\nsupersedes: '[[p1]]'\ncreated: 2024-05-02\nlast_tested: 2024-05-02\n---\nsteps\n")
    before = {n: open(os.path.join(root, n)).read() for n in ("Semantic/old.md", "Semantic/read.md", "Procedural/p1.md", "Procedural/p2.md")}
    files = note_files.notes(spark, root).select("path", notes.decoded(F.col("content")).alias("text"))
    rows = notes.parse_notes(files).withColumn("type", maintain.type_of(F.col("folders"), F.col("tags"), "tag_first"))
    rows = rows.withColumns({c: F.to_date(c) for c in ("created", "modified", "last_accessed", "last_tested")})
    edges = spark.createDataFrame([("p2", "p1", "supersedes", "supersedes")], "source string, target string, relation string, origin string")
    seen = spark.createDataFrame([("2024-05-20T10:00:00", "get", ["read"])], "ts string, kind string, ids array<string>")
    vectors = spark.createDataFrame([], "id string, kind string, scope string, embedding array<double>")
    cycle = consolidate.consolidate(rows, seen, edges, vectors, rows.select("note_id").limit(0), dt.date(2024, 6, 1))
    changes = consolidate.changed_fields(rows, cycle.notes)
    assert consolidate.land(changes, root).count() == 3
    after = {n: open(os.path.join(root, n)).read() for n in before}
    assert after["Semantic/old.md"] == before["Semantic/old.md"].replace("status: ativo", "status: arquivado")
    assert after["Semantic/read.md"] == before["Semantic/read.md"].replace("01-01\n", "01-01\nlast_accessed: 2024-05-20\n")
    assert after["Procedural/p1.md"] == '---\nstatus: deprecado\ncreated: 2024-05-01\nsuperseded_by: "[[p2]]"\n---\nsteps\n'
    assert after["Procedural/p2.md"] == before["Procedural/p2.md"]
    again = notes.parse_notes(note_files.notes(spark, root).select("path", notes.decoded(F.col("content")).alias("text")))
    assert not again.where("malformed").count()
