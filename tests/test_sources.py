import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestack.sources import logs, notes, sinks
from lodestack.streaming import access


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_notes(spark, tmp_path):
    put(tmp_path, "Semantic/a.md", "---\ntitle: A\ntags: '#x, y'\nsupersedes: '[[old]]'\ncreated: 2026-01-15\nextra: 3\n---\nbody\n")
    put(tmp_path, "b.md", "---\nnot closed\n")
    put(tmp_path, "c.md", "---\n- a\n- list\n---\nrest")
    put(tmp_path, "d.md", "---\ntitle: [broken\n---\nrest")
    put(tmp_path, ".hidden.md", "no")
    put(tmp_path, "other.txt", "no")
    rows = {r.note_id: r for r in notes.parse_notes(notes.read_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    a = rows["a"]
    assert (a.title, a.tags, a.supersedes, a.created, a.body, a.malformed) == ("A", ["x", "y"], ["[[old]]"], "2026-01-15", "body\n", False)
    assert "extra" in a["keys"] and a.folders[-1] == "Semantic"
    assert rows["b"].body == "---\nnot closed\n" and not rows["b"].malformed
    assert rows["c"].malformed and rows["d"].malformed
    assert notes.list_files(spark, str(tmp_path)).count() == 4
    text = notes.render_note({"title": "A", "tags": ["x"]}, "body\n\n")
    assert text == "---\ntitle: A\ntags:\n- x\n---\nbody\n"


def test_file_names(spark):
    rows = spark.createDataFrame([("1", "n"), ("2", "n"), ("3", "m")], "note_id string, name string")
    taken = spark.createDataFrame([("m",)], "name string")
    assert {r.note_id: r.file for r in notes.file_names(rows, taken).collect()} == {"1": "n.md", "2": "n-2.md", "3": "m-2.md"}
    named = lambda wanted, taken: {r.note_id: r.file for r in notes.file_names(spark.createDataFrame([(str(i), n) for i, n in enumerate(wanted)], "note_id string, name string"), spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert named(["a", "a", "a-2"], []) == {"0": "a.md", "1": "a-3.md", "2": "a-2.md"}
    assert named(["a"], ["a", "a-2"]) == {"0": "a-3.md"}
    many = named(["a", "a-2", "a", "a-2", "a-2-2", "b", "a", "a-3"], ["a-2", "a-4", "b", "b-2", "b-3"])
    twice = spark.createDataFrame([("1", "n"), ("1", "n"), (None, "n"), ("2", None), ("3", "")], "note_id string, name string")
    assert sorted(r.file for r in notes.file_names(twice).collect()) == ["n-2.md", "n-3.md", "n.md", "nota-2.md", "nota.md"]
    assert len(set(many.values())) == 8 and not {x[:-3] for x in many.values()} & {"a-2", "a-4", "b", "b-2", "b-3"}


def test_logs(spark):
    lines = lambda *x: spark.createDataFrame([(y,) for y in x], "value string")
    got = logs.parse_access(lines('{"ts":"2026-01-01","kind":"get","ids":["a"]}', '{"ts":"20', "[]", "")).collect()
    assert [(r.ts, r.ids) for r in got] == [("2026-01-01", ["a"])]
    acts = logs.parse_actions(lines('{"ts":"1","action":"write","x":1}', "oops", '{"ts":"2","action":"reject"}'))
    assert [r.action for r in logs.tail_actions(acts, 1).collect()] == ["reject"]
    assert logs.parse_links(lines('{"a":"x","b":"y"}', " ")).first().relation == "related"
    for bad in ('{"a":"x"}', '{"a":"x","b":"y","c":1}', "junk"):
        with pytest.raises(Exception, match="link record|MALFORMED|JSON"):
            logs.parse_links(lines(bad)).collect()


def test_tail_by_lines(spark, tmp_path):
    put(tmp_path, "a.jsonl", "".join(json.dumps({"ts": "5", "action": "x", "n": i}) + "\n" for i in range(4)) + "torn\n")
    put(tmp_path, "b.jsonl", "".join(json.dumps({"ts": "5", "action": "x", "n": i}) + "\n" for i in range(4, 6)))
    tail = logs.tail_actions(logs.read_actions(spark, str(tmp_path)), 3).select(F.to_json("record").alias("j")).collect()
    assert [json.loads(r.j)["n"] for r in tail] == [5, 4, 3]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    docs = spark.createDataFrame([("index.md", "## b"), ("index.md", "## a")], "path string, body string")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert "".join(p.read_text() for p in (tmp_path / "docs").rglob("*.txt")).startswith("## a\n\n## b")
    assert sinks.splice("x\n<a>\nold\n<b>\ny", "new", "<a>", "<b>") == "x\n<a>\nnew\n<b>\ny"
    assert sinks.splice("", "new", "<a>", "<b>") == "<a>\nnew\n<b>\n"
    with pytest.raises(ValueError):
        sinks.splice("<a><a><b>", "n", "<a>", "<b>")


def test_access_stream(spark, tmp_path):
    logs_dir, table, state = tmp_path / "log", str(tmp_path / "seen"), str(tmp_path / "state")
    write = lambda name, *rows: put(logs_dir, name, "\n".join(json.dumps(r) for r in rows) + '\n{"torn')
    apply = access.merge_into(spark, table)
    run = lambda f: access.flush(access.stream(spark, str(logs_dir)), f, state).awaitTermination()
    seen = lambda: {r.note_id: str(r.seen) for r in access.current(spark, table).collect()}
    assert seen() == {}
    write("1.jsonl", {"ts": "2026-01-02T00:00:00Z", "kind": "get", "ids": ["a", "b"]}, {"ts": "2026-01-05T23:30:00-03:00", "kind": "get", "ids": ["a"]})
    run(apply)
    assert seen() == {"a": "2026-01-06", "b": "2026-01-02"}
    write("2.jsonl", {"ts": "2026-01-01T00:00:00Z", "kind": "search", "ids": ["a", "c"]})

    def fails(_):
        raise RuntimeError("disk full")

    with pytest.raises(Exception, match="disk full"):
        run(fails)
    assert "c" not in seen()
    run(apply)  # the failed batch comes again
    assert seen() == {"a": "2026-01-06", "b": "2026-01-02", "c": "2026-01-01"}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    apply = access.merge_into(spark, str(tmp_path), 8)
    rows = lambda *r: spark.createDataFrame([(n, dt.date(2026, 1, d)) for n, d in r], "note_id string, seen date")
    apply(rows(*[(f"n{i}", 5) for i in range(40)]))
    apply(rows(("n3", 9), ("n4", 1)))
    apply(rows())
    assert len(list((tmp_path / "rows" / "v=1").glob("bucket=*"))) == 8
    assert len(list((tmp_path / "rows" / "v=2").glob("bucket=*"))) <= 2 and not (tmp_path / "rows" / "v=3").exists()
    got = {r.note_id: r.seen.day for r in access.current(spark, str(tmp_path)).collect()}
    assert got == {f"n{i}": 9 if i == 3 else 5 for i in range(40)}


def test_flush_again_after_a_crash(spark, tmp_path):
    """A batch that was applied but not committed comes again and does no harm; cleaned files and old versions go."""
    src, out, done = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "done")
    put(tmp_path, "in/0.jsonl", json.dumps({"ts": "2024-01-01T00:00:00", "kind": "get", "ids": ["a", "b"]}))
    merge, calls = access.merge_into(spark, out, 4), []

    def crashes(seen):
        merge(seen)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")

    records = lambda: access.stream(spark, src, 1, "archive", done)
    with pytest.raises(Exception, match="lost"):
        access.flush(records(), crashes, str(tmp_path / "cp")).awaitTermination()
    for i in range(1, 5):
        put(tmp_path, f"in/{i}.jsonl", json.dumps({"ts": f"2024-01-0{i + 1}T00:00:00", "kind": "get", "ids": ["a", f"n{i}"]}))
        access.flush(records(), crashes, str(tmp_path / "cp")).awaitTermination()
        access.expire(spark, out)
    got = {r.note_id: str(r.seen) for r in access.current(spark, out).collect()}
    assert got == {"a": "2024-01-05", "b": "2024-01-01"} | {f"n{i}": f"2024-01-0{i + 1}" for i in range(1, 5)} and len(calls) >= 6
    assert len(list((tmp_path / "out/versions").iterdir())) == 1
    folders = [b for v in (tmp_path / "out/rows").iterdir() for b in v.iterdir() if b.name.startswith("bucket=")]
    assert len(folders) <= 4
    moved = [p.name for p in (tmp_path / "done").rglob("*.jsonl")] if (tmp_path / "done").exists() else []
    assert len(moved) + len(list((tmp_path / "in").glob("*.jsonl"))) == 5 and moved
    assert access.expire(spark, str(tmp_path / "none")) == 0


def test_lines_of_large_documents(spark, tmp_path):
    root = str(tmp_path / "docs")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot.md").otherwise(F.concat(F.lit("in/p"), F.col("id") % 5, F.lit(".md"))).alias("path"), (3000 - F.col("id")).alias("entry"), F.when(F.col("id") != 7, F.concat(F.lit("line é "), "id")).alias("line"))
    put(tmp_path, "docs/in/p0.md", "old")
    assert sinks.write_lines(rows.repartition(5), root) == 6
    for path, lines in rows.toPandas().sort_values("entry").groupby("path"):
        assert (tmp_path / "docs" / path).read_text(encoding="utf-8") == "".join(f"{x or ''}\n" for x in lines.line)
    assert not [p for p in (tmp_path / "docs").rglob(".*")]
    bad = rows.withColumn("line", F.when(F.col("path") == "in/p1.md", F.raise_error(F.lit("no")).cast("string")).otherwise("x"))
    with pytest.raises(Exception):
        sinks.write_lines(bad, root)
    assert (tmp_path / "docs/hot.md").read_text(encoding="utf-8").startswith("line é 2998\n")
    assert sinks.write_lines(rows.limit(0), root) == 0
