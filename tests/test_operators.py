import datetime as dt
import hashlib
import math
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.config import Agent, ConfigError, Frontmatter, Manifest, Scopes
from lodestack.functions import dates, text as tx, vectors as vx
from lodestack.operators import boards, chunk, embed, filters, gate, graph, hybrid, index, lexical, maintain, vector
from lodestack.plans.consolidate import consolidate


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# text


def test_fold_and_tokens(spark):
    assert one(spark, tx.tokens(F.lit("Crème_brûlée für ß ½ CAFÉ"))) == ["creme", "brulee", "fur", "ß", "½", "cafe"]
    assert one(spark, tx.tokens(F.lit("éte"))) == ["ete"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []


def test_excerpt(spark):
    assert one(spark, tx.excerpt(F.lit("  a  b\n c "), ["zzz"])) == "a b c"
    long = "x" * 300 + " needle " + "y" * 300
    got = one(spark, tx.excerpt(F.lit(long), ["needle"], 90))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) == 92
    assert one(spark, tx.excerpt(F.lit(""), ["a"])) == ""


def test_prefix_slug_tags_links(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, tx.context_prefix(F.lit("p"), F.lit(" "), a("t", "u"), a("A", "B"))) == "scope: p | tags: t, u | section: A > B"
    assert one(spark, tx.context_prefix(F.lit(None).cast("string"), F.lit(""), a(), a())) == ""
    assert one(spark, tx.slug(F.lit("  Olá, Mundo!  "))) == "ola-mundo" and one(spark, tx.slug(F.lit("…"))) == "nota"
    assert one(spark, tx.tags_of(F.lit("#a, b ,,##c"))) == ["a", "b", "c"]
    assert one(spark, tx.strip_wikilink(F.lit("[[id#h|al]]"))) == "id"
    body = "---\na: 1\n---\n# Title\n\n> [!note] x\nSee [[a|the a]] and [[b]] ![[c]]\n```\ncode\n```\nend"
    assert one(spark, tx.plain_excerpt(F.lit(body))) == "See the a and b end"


def test_dates(spark):
    assert one(spark, dates.as_date(F.lit("2026-01-15T10:00"))) == dt.date(2026, 1, 15)
    assert one(spark, dates.as_date(F.lit("soon"))) is None
    assert one(spark, dates.utc_date(F.lit("2026-01-15T23:30:00-03:00"))) == dt.date(2026, 1, 16)
    assert one(spark, dates.utc_date(F.lit("2026-01-15T23:30:00"))) == dt.date(2026, 1, 15)
    assert one(spark, dates.freshness(F.lit(14))) == pytest.approx(math.exp(-1)) and one(spark, dates.freshness(F.lit(-3))) == 1.0
    row = spark.range(1).select(*dates.period_labels(F.lit(dt.date(2027, 1, 1)))).first()
    assert tuple(row) == ("2026-W53", "2027-01", "2027-H1", "2027", "2025-2029")


# chunks and embeddings


def chunked(spark, body, *budget):
    return [(list(c.heading_path), c.raw_text) for c in one(spark, chunk.chunks(F.lit(body), *budget))]


def test_chunks_follow_headings(spark):
    body = "intro\n\n# A\n\n## B\n\ntext b\n\n```sh\n# no heading\n\nstill code\n```\n\n## C #\ntext c\n#tag is text"
    cut = one(spark, F.transform(chunk.sections(F.lit(body)), lambda s: F.struct(s["path"].alias("path"), chunk.section_text(s["part"]).alias("text"))))
    assert [(list(s.path), s.text) for s in cut] == [([], "intro"), (["A", "B"], "## B\ntext b\n\n```sh\n# no heading\n\nstill code\n```"), (["A", "C"], "## C #\ntext c\n#tag is text")]
    assert chunked(spark, "# A\n\n## B\nx\n\n## C\ny") == [(["A"], "## B\nx\n\n## C\ny")]
    assert chunked(spark, "  \n") == [] and chunked(spark, "") == []
    assert chunked(spark, "### deep\n# top\n###\nunnamed") == [(["top"], "###\nunnamed")]
    assert chunked(spark, "````\n```\n# in\n````\n# out\nx", 20, 0) == [([], "````\n```\n# in\n````"), (["out"], "# out\nx")]


def test_chunks_split_and_overlap(spark):
    words = " ".join(f"w{i:03d}" for i in range(200))
    pieces = chunked(spark, f"# T\n{words}\n\n# U\nlast", 100, 20)
    assert pieces[0][1].startswith("# T\n") and pieces[-1] == (["U"], "# U\nlast")
    for (_, a), (_, b) in zip(pieces, pieces[1:-1], strict=False):
        head, rest = b.split("\n\n", 1)
        assert a.endswith(head) and 0 < len(head) <= 20 and len(rest) <= 100
    assert "".join(t for _, t in chunked(spark, "x" * 250, 100, 0)) == "x" * 250
    assert [t for _, t in chunked(spark, "~~~\na\n\nb", 4, 0)][0].startswith("~~~")


def test_long_bodies_are_chunked_whole(spark):
    body = "".join(f"# h{i}\n\n" + "word " * 30 + "\n\n" for i in range(3000)) + "```\n" + "code\n" * 20_000
    pieces = chunked(spark, body, 200, 0)
    assert sum(t.count("word") for _, t in pieces) == 90_000 and sum(t.count("code") for _, t in pieces) == 20_000


def test_chunk_notes(spark):
    notes = table(spark, [("n", "one\n\ntwo", "s", "T", ["x"]), ("e", None, None, None, None)], "note_id string, body string, scope string, title string, tags array<string>")
    row = chunk.chunk_notes(notes).collect()
    assert [(r.chunk_id, r.raw_text, r.embed_text) for r in row] == [("n#0", "one\n\ntwo", "scope: s | title: T | tags: x\n\none\n\ntwo")]
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunk.chunk_notes(notes, *bad)


def plain_vector(text, dim):
    """Feature by feature."""
    words = re.findall(r"\w+", text.lower())
    line = " ".join(words)
    out = np.zeros(dim)
    for f in [f"w:{w}" for w in words] + [f"w:{a} {b}" for a, b in zip(words, words[1:], strict=False)] + [f"c:{line[i : i + 3]}" for i in range(len(line) - 2)]:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        out[h % dim] += 1 if h >> 63 else -1
    return out / (np.linalg.norm(out) or 1)


def test_embeddings(spark):
    rows = table(spark, [(1, "Hello hello world"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in embed.hash_embed(rows, 32).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and not any(got[2]) and not any(got[3])
    assert got[1] == pytest.approx(list(embed.hash_vector("Hello hello world", 32)))
    texts = ["ab cd", "", "a", "Ünï _x 12 Ünï", "the cat the cat", "😀 ab😀c"]
    assert embed.hash_vectors(texts, 64) == pytest.approx(np.stack([plain_vector(t, 64) for t in texts]))
    back = embed.http_provider(lambda texts: [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(texts)))])
    assert back()(["a", "bb"]).tolist() == [[1, 0], [2, 0]]
    with pytest.raises(ValueError):
        embed.http_provider(lambda texts: [])()(["a"])


# vectors


VECTORS = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])]


def test_cosine_topk(spark):
    v = table(spark, VECTORS, "id long, embedding array<double>")
    got = [(r.id, r.cos) for r in vector.cosine_topk(v, [3.0, 0.0], 9).collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0), (4, -1.0)]
    assert vector.cosine_topk(v, [1.0, 0.0], 0).count() == 0
    assert {r.cos for r in vector.cosine_topk(v, [0.0, 0.0], 4).collect()} == {0.0}
    asked = v.select(F.col("id").alias("query_id"), "embedding")
    batch = {(r.query_id, r["rank"]): r.id for r in vector.cosine_topk_batch(v, asked, 2).collect()}
    assert batch[1, 1] == 1 and batch[1, 2] == 2 and batch[4, 1] == 4 and len(batch) == 8


@pytest.mark.parametrize("blocks", [(100, 100), (3, 4), (1, 1), (7, 100)])
def test_cosine_topk_batch_whatever_the_blocks(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(30)]
    v = table(spark, rows, "id long, embedding array<double>")
    asked = v.where("id % 4 = 0").select(F.col("id").alias("query_id"), "embedding")
    unit = [np.array(e) / (np.linalg.norm(e) or 1) for _, e in rows]
    got = {(r.query_id, r["rank"]): (round(r.cos, 9), r.id) for r in vector.cosine_topk_batch(v, asked, 5, *blocks).collect()}
    for q in range(0, 30, 4):
        ranked = [got[q, n][0] for n in range(1, 6)]
        assert ranked == sorted((round(float(u @ unit[q]), 9) for u in unit), reverse=True)[:5]
        assert all(c == round(float(unit[q] @ unit[i]), 9) for n in range(1, 6) for c, i in [got[q, n]])
    none = table(spark, [], "id long, embedding array<double>")
    assert vector.cosine_topk_batch(none, asked, 5, *blocks).count() == 0
    assert vector.cosine_topk_batch(v, none.withColumnRenamed("id", "query_id"), 5, *blocks).count() == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_similar_pairs_whatever_the_blocks(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, "k" if i % 3 else None, f"s{i % 2}", rng.normal(size=3).tolist()) for i in range(20)]
    v = table(spark, rows, "id long, kind string, scope string, embedding array<double>")
    got = {(r.a, r.b, r.same_scope) for r in vector.similar_pairs(v, 0.7, block).collect()}
    unit = [np.array(r[3]) / np.linalg.norm(r[3]) for r in rows]
    want = {(i, j, i % 2 == j % 2) for i in range(20) for j in range(i + 1, 20) if rows[i][1] == rows[j][1] and unit[i] @ unit[j] > 0.7}
    assert got == want and got


def test_vector_table(spark):
    v = table(spark, VECTORS, "id long, embedding array<double>")
    new = table(spark, [(1, [5.0, 5.0], 1), (1, [6.0, 8.0], 2), (9, [1.0, 1.0], 1)], "id long, embedding array<double>, seq int")
    got = {r.id: r.embedding for r in vector.upsert(v, new, seq="seq").collect()}
    assert got[1] == [6.0, 8.0] and set(got) == {1, 2, 3, 4, 9}
    assert vector.upsert(v, new.where("id = 9").drop("seq")).count() == 5
    with pytest.raises(Exception, match="repeated key"):
        vector.upsert(v, new.drop("seq")).collect()
    assert vector.validated(v, 2).where("id = 2").first().embedding == [1.0, 0.0]
    with pytest.raises(Exception, match="invalid vector"):
        vector.validated(table(spark, [(1, [float("nan"), 1.0])], "id long, embedding array<double>"), 2).collect()
    assert one(spark, vx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


# lexical


def test_bm25_equals_sqlite(spark):
    texts = ["the quick brown fox", "The lazy dog; the end", "fox fox FOX", "nothing here", "crème brûlée", "", "a AND b OR not"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize=\"unicode61 remove_diacritics 2\")")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    rows = table(spark, list(enumerate(texts)), "chunk_id long, text string")
    for q in ("fox the", "creme", "AND fox", "zebra"):
        match = " OR ".join(f'"{t}"' for t in lexical.query_terms(q))
        want = {i: -s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))}
        got = {r.chunk_id: r.score for r in lexical.bm25(rows, q).collect()}
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
        terms = table(spark, [(0, t) for t in lexical.query_terms(q)], "query_id long, term string")
        lengths = rows.select("chunk_id", F.size(tx.tokens(F.col("text"))).alias("length"))
        batch = {r.chunk_id: r.score for r in lexical.bm25_batch(lexical.postings(rows), lengths, terms, 10).collect()}
        assert batch == pytest.approx(got)
    assert lexical.bm25(rows, "?!").count() == 0
    assert lexical.query_terms("für FÜR fur") == ["fur", "fur"]
    kept = lexical.bm25(rows, "fox", F.col("chunk_id") == 2).collect()
    assert len(kept) == 1 and kept[0].score == pytest.approx({r.chunk_id: r.score for r in lexical.bm25(rows, "fox").collect()}[2])
    with pytest.raises(ValueError):
        lexical.top(kept, 0)


# hybrid


def test_a_stored_index_scores_alike(spark, tmp_path):
    texts = ["the fur of für", "", "the the a", None, "fur", "x y z", "the"]
    chunks = table(spark, list(enumerate(texts)), "chunk_id long, text string")
    lexical.write_index(chunks, str(tmp_path))
    for q in ("the für", "fur FUR z", "nowhere", "", "the für fur"):
        want = {r.chunk_id: r.score for r in lexical.bm25(chunks, q).collect()}
        assert {r.chunk_id: r.score for r in lexical.bm25_stored(spark, str(tmp_path), q).collect()} == pytest.approx(want)
    few = chunks.where("chunk_id in (0, 1, 6)")
    want = {r.chunk_id: r.score for r in lexical.bm25(chunks, "the", F.col("chunk_id").isin(0, 1, 6)).collect()}
    assert {r.chunk_id: r.score for r in lexical.bm25_stored(spark, str(tmp_path), "the", few).collect()} == pytest.approx(want) and set(want) == {0, 6}
    plan = lexical.bm25_stored(spark, str(tmp_path), "the")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_index_lines_number_each_scope(spark):
    notes = table(spark, [(f"n{i:03}", f"s{i % 3}" if i % 7 else None, f"T{i * 37 % 20}" if i % 5 else None) for i in range(200)], "note_id string, scope string, title string")
    notes = notes.withColumns({"type": F.lit("semantic"), "status": F.lit(None).cast("string"), "agent": F.lit("x"), "confidence": F.lit("low")})
    lines = boards.index_lines(notes)
    got = {}
    for r in lines.orderBy("entry").collect():
        got.setdefault(r.scope, []).append((r.entry, r.line))
    whole = {r.scope: r.lines.split("\n") for r in boards.index_map(notes).collect()}
    assert {s: [x for _, x in rows] for s, rows in got.items()} == whole
    assert all([n for n, _ in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    files = boards.index_files(lines.where("scope is not null"), ["s2"], 10)
    assert {r.path for r in files.select("path").distinct().collect()} == {"indices/s0.md", "indices/s1.md", "indices/s2.md"}
    one_file = boards.index_files(lines.where("scope is not null"), ["s2"], 1000)
    first = one_file.orderBy("path", "place", "entry").first()
    assert first.path == "index.md" and first.place.name == "s2" and first.entry == 1


def test_min_max_and_fusion(spark):
    dense = table(spark, [("a", 0.9), ("b", 0.5)], "chunk_id string, cos double")
    sparse = table(spark, [("b", 3.0)], "chunk_id string, score double")
    got = {r.chunk_id: (round(r.score, 6), r.cos) for r in hybrid.fuse(dense, sparse).collect()}
    assert got == {"a": (0.6, 0.9), "b": (0.4, 0.5)}
    assert hybrid.pool_size(3) == 40 and hybrid.pool_size(10) == 50


def test_fold_takes_first_chunk_of_a_tie(spark):
    rows = table(spark, [("n", "n#1", 1, 0.5, 0.1), ("n", "n#0", 0, 0.5, 0.0), ("n", "n#2", 2, 0.2, 0.9)], "note_id string, chunk_id string, ordinal int, score double, cos double")
    assert tuple(hybrid.fold_to_notes(rows).first()) == ("n", 0.5, "n#0", 0.9)


def vault(spark):
    notes = table(
        spark,
        [("a", "semantic", "p", "ativo", "high", ["t"]), ("b", "semantic", "p", "ativo", "low", ["t", "u"]), ("c", "semantic", "q", "arquivado", None, []), ("d", "procedural", "q", None, "medium", ["u"])],
        "note_id string, type string, scope string, status string, confidence string, tags array<string>",
    ).withColumns({"agent": F.lit("x"), "profile": F.lit(None).cast("string"), "title": F.col("note_id")})
    chunks = table(spark, [("a#0", "a", 0, "fox jumps", [1.0, 0.0]), ("b#0", "b", 0, "dog sleeps", [0.6, 0.8]), ("c#0", "c", 0, "fox old", [1.0, 0.1]), ("d#0", "d", 0, "unrelated", [-1.0, 0.0])], "chunk_id string, note_id string, ordinal int, text string, embedding array<double>")
    edges = table(spark, [("a", "d", "wikilink", "wikilink"), ("a", "c", "wikilink", "wikilink")], "source string, target string, relation string, origin string")
    return notes, chunks, edges


def test_search(spark):
    notes, chunks, edges = vault(spark)
    run = lambda **k: [(r.note_id, r.score, r.hops) for r in hybrid.search(chunks, notes, edges, "fox", [1.0, 0.0], **k).collect()]
    assert run(k=5, hops=0) == [("a", 1.0, 0), ("b", 0.0, 0)]
    assert run(k=5) == [("a", 1.0, 0), ("d", 0.5, 1), ("b", 0.0, 0)]  # c is archived and stays out
    assert run(k=1) == [("a", 1.0, 0)]
    assert run(k=5, hops=0, filters={"status": ["ativo", "arquivado"]})[1][0] == "c"
    assert [r[0] for r in run(k=5, hops=0, filters={"scope": "q", "status": "arquivado"})] == ["c"]
    with pytest.raises(ValueError):
        run(k=5, hops=3)
    hits = hybrid.search(chunks, notes, edges, "fox", [1.0, 0.0], k=5)
    shown = {r.note_id: r for r in hits.collect()}
    assert shown["a"].via is None and shown["d"].via == "[[a]] → [[d]]" and shown["d"].wikilink == "[[d]]"
    opening = {r.note_id: r.text for r in chunks.orderBy(F.desc("ordinal")).collect()}
    assert shown["d"].excerpt == (opening.get("d") or "")
    at = dt.datetime(2026, 1, 2, 3)
    assert [tuple(r) for r in hybrid.accesses(hits, at).collect()] == [("2026-01-02T03:00:00", "search", ["a", "b", "d"])]
    assert hybrid.accesses(hits.where("false"), at).count() == 0


def test_filters(spark):
    notes, _, _ = vault(spark)
    ids = lambda f: sorted(r.note_id for r in filters.apply(notes, f).collect())
    assert ids(None) == ["a", "b", "d"] and ids({"tags": ["t", "u"]}) == ["b"] and ids({"min_confidence": "medium"}) == ["a", "d"]
    assert ids({"scope": None, "type": "semantic"}) == ["a", "b"] and ids({"status": "arquivado"}) == ["c"]
    for bad in ({"scopes": "p"}, {"status": "active"}, {"scope": []}, {"min_confidence": "huge"}):
        with pytest.raises(filters.FilterError):
            filters.check(bad)


# graph


def test_wikilinks(spark):
    body = "[[a]] ![[b|alias]] [[c#h]] [[#own]] `[[no]]`\n```\n[[no2]]\n```\n[[a]]\n~~~\n[[no3]]"
    assert one(spark, graph.wikilinks(F.lit(body))) == ["a", "b", "c", "a"]
    for raw, name in (("Folder/Sub/id.md", "id"), ("[[x|y]]", "x"), ("v1.2", "v1.2"), (" ![[q#r]] ", "q")):
        assert one(spark, graph.normal_target(F.lit(raw))) == name


def test_links_resolve(spark):
    notes = table(spark, [("Vec", "1/Vec.md", "[[vec]] [[DUP]] [[gone]] [[other]]", ["[[Other]]"]), ("Other", "1/Other.md", "", None), ("dup", "1/dup.md", "", None), ("Dup", "2/Dup.md", "", None), ("Vec", "0/Vec.md", "", None)], "note_id string, path string, body string, supersedes array<string>")
    ids = graph.winners(notes)
    assert {r.note_id: (r.path, r.ambiguous) for r in ids.collect()}["Vec"] == ("0/Vec.md", True)
    found = graph.resolve(graph.authored(notes), ids)
    edges, dropped = graph.split_links(found)
    assert {(r.source, r.target, r.relation) for r in edges.collect()} == {("Vec", "Other", "wikilink"), ("Vec", "Other", "supersedes")}
    assert {(r.raw, r.reason) for r in dropped.collect()} == {("vec", "broken"), ("DUP", "broken"), ("gone", "broken")}
    assert tuple(graph.health(ids, edges, dropped).first()) == (4, 1, 2, 3, 0)


def test_expand(spark):
    e = table(spark, [("a", "b", "r", "o"), ("b", "c", "z", "o"), ("b", "c", "q", "o"), ("a", "x", "r", "o"), ("x", "c", "r", "o"), ("c", "a", "r", "o2")], "source string, target string, relation string, origin string")
    seeds = table(spark, [("b",), ("lonely",)], "note_id string")
    got = {r.note_id: (r.hops, r.path, r.relations) for r in graph.expand(e, seeds, 2).collect()}
    assert got == {"b": (0, ["b"], []), "lonely": (0, ["lonely"], []), "a": (1, ["b", "a"], ["r"]), "c": (1, ["b", "c"], ["q"]), "x": (2, ["b", "a", "x"], ["r", "r"])}
    assert graph.expand(e, seeds, 0).count() == 2
    assert one(spark, graph.via(F.array(F.lit("a"), F.lit("b")))) == "[[a]] → [[b]]"
    fresh = table(spark, [("a", "b", "r", "o"), ("a", "a", "r", "o"), ("a", "nope", "r", "o"), ("b", "x", "n", "o")], e.schema)
    known = table(spark, [("a",), ("b",), ("x",)], "note_id string")
    assert [tuple(r) for r in graph.new_links(e, fresh, known).collect()] == [("b", "x", "n", "o")]
    odd = table(spark, [("a", "b", "r", None), ("b", "a", None, "o"), ("x", "a", "r", None), (None, "a", "r", "o"), ("a", "b", "r", "o"), ("b", "b", "r", "o"), ("b", "zz", "r", "o")], e.schema)
    reasons = {(r.source, r.target): r.reason for r in graph.judged_links(e.union(odd.limit(1)), odd, known).where("source is null or origin is null or source = 'b'").collect()}
    assert reasons == {("a", "b"): "known", ("b", "a"): "blank", ("x", "a"): None, (None, "a"): "blank", ("b", "b"): "self", ("b", "zz"): "unknown"}
    again = e.union(graph.new_links(e, odd, known))
    assert graph.new_links(again, odd, known).count() == 0


# index and maintenance


def test_snapshot_diff(spark):
    state = table(spark, [("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h"), ("d", 1, "h")], "path string, mtime long, hash string")
    now = table(spark, [("a", 1, "other"), ("b", 2, "h"), ("c", 2, "new"), ("e", 1, "h")], "path string, mtime long, hash string")
    diff = index.snapshot_diff(state, now)
    assert {r.path: r.action for r in diff.collect()} == {"a": "unchanged", "b": "touched", "c": "changed", "d": "removed", "e": "new"}
    chunks = table(spark, [("c", "old"), ("d", "old"), ("a", "old")], "path string, t string")
    fresh = table(spark, [("c", "new"), ("e", "new")], "path string, t string")
    assert {tuple(r) for r in index.apply_diff(chunks, diff, fresh).collect()} == {("a", "old"), ("c", "new"), ("e", "new")}
    assert tuple(index.index_report(diff, fresh).first()) == (1, 1, 1, 1, 1, 2)
    assert index.needs_rebuild(index.fingerprint({"a": 1}), {"a": 2}) and not index.needs_rebuild(index.fingerprint({"a": 1}), {"a": 1})


D = dt.date


def cycle_notes(spark):
    rows = [
        ("old", "semantic", "p", "ativo", D(2026, 1, 1), None, None, None),
        ("edge", "semantic", "p", None, D(2026, 7, 3), None, None, None),
        ("read", "semantic", "q", "ativo", D(2026, 1, 1), None, None, None),
        ("undated", "semantic", "q", "ativo", None, None, None, None),
        ("proc", "procedural", "p", "ativo", D(2026, 1, 1), None, None, D(2026, 2, 1)),
        ("proc2", "procedural", "p", "ativo", D(2026, 1, 1), None, D(2026, 9, 30), D(2026, 2, 1)),
        ("gone", "semantic", "p", "arquivado", D(2025, 1, 1), None, None, None),
    ]
    return table(spark, rows, "note_id string, type string, scope string, status string, created date, modified date, last_accessed date, last_tested date")


@pytest.mark.parametrize(("body", "n"), [("# a\n## b\n# c", 2), ("~~~\n# x\n~~~\n# a", 1), ("# a\n```\n# open", 1), ("````\n```\n# x\n````\n## a\n## b", 2), ("none", 0)])
def test_top_sections(spark, body, n):
    assert one(spark, gate.top_sections(F.lit(body))) == n


def test_metadata_filters(spark):
    rows = table(spark, [("a", "p", ["x", "y"], 1), ("b", "q", [], 2), ("c", None, None, None)], "id string, scope string, tags array<string>, n int")
    ids = lambda **f: sorted(r.id for r in filters.metadata(rows, f).collect())
    assert ids() == ids(scope=None) == ["a", "b", "c"] and ids(scope=["p", "q"]) == ["a", "b"] and ids(tags="y") == ["a"]
    assert ids(scope="q", n=[1, 2]) == ["b"] and ids(scope="p", tags="z") == [] and ids(none="x") == []
    with pytest.raises(filters.FilterError):
        ids(scope=[])
    late = table(spark, [("b", 3), ("a", 3), ("c", 9)], "note_id string, days_stale int")
    assert [r.note_id for r in maintain.longest_untested(late).collect()] == ["c", "a", "b"]


def test_cycle(spark):
    notes = cycle_notes(spark)
    access = table(spark, [("2026-09-30T10:00:00Z", ["read", "ghost"]), ("2026-09-01", ["read"]), ("torn", ["old"])], "ts string, ids array<string>")
    edges = table(spark, [("new", "proc", "supersedes", "s"), ("doc", "old", "wikilink", "w"), ("doc", "old", "wikilink", "w2"), ("doc", "proc", "wikilink", "w"), ("doc", "edge", "wikilink", "w")], "source string, target string, relation string, origin string")
    vectors = table(spark, [("a", "semantic", "p", [1.0, 0.0]), ("b", "semantic", "q", [1.0, 0.01])], "id string, kind string, scope string, embedding array<double>")
    docs = table(spark, [("doc",)], "note_id string")
    run = lambda dry: consolidate(notes, access, edges, vectors, docs, D(2026, 10, 1), dry_run=dry)
    real, dry = run(False), run(True)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(real.decayed) == ["old"] and ids(dry.decayed) == ["old", "read"]  # a dry run does not stamp; 90 days are not over 90
    assert ids(real.stamped) == ["read"] and ids(real.deprecated) == ["proc"] and ids(real.stale) == ["proc2"]
    assert [tuple(r) for r in real.dead_citations.orderBy("cited").collect()] == [("doc", "old", "arquivado", None), ("doc", "proc", "deprecado", "new")]
    assert {r.note_id: r.status for r in real.notes.collect()}["proc"] == "deprecado"
    assert [(r.a, r.b, r.same_scope) for r in real.duplicates.collect()] == [("a", "b", False)]
    assert {r.step: r.n for r in real.report().collect()}["decayed"] == 1


def test_type_rules(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    kind = lambda rule, folders, tags=(): one(spark, maintain.type_of(a(*folders), a(*tags), rule))
    assert kind("tag_first", ["Episodic", "Semantic"]) == "semantic" and kind("tag_first", ["Semantic", "Episodic", "x"]) == "episodic"
    assert kind("folder_first", ["Semantic", "Episodic"]) == kind("folder_first", ["Episodic", "x", "Semantic", "y"]) == "episodic"
    assert kind("tag_first", ["Semantic", "x"], ["mem/procedural"]) == "procedural" and kind("tag_first", ["semantic"]) is None
    assert kind("tag_first", ["Semantic", "x", "y"]) is None and kind("folder_first", ["Semantic", "x", "y"]) == "semantic"
    assert kind("folder_first", ["x"], ["mem/research"]) == "research" and kind("folder_only", ["x"], ["mem/research"]) is None
    assert kind("folder_only", ["Semantic", "Episodic"]) == "semantic" and kind("tag_first", []) is None
    below = lambda *folders: one(spark, maintain.type_of(a(*folders), a(), "folder_only", "root"))
    assert below("Episodic", "root", "Semantic", "Procedural") == "semantic" and below("Semantic") is None and below("root", "x", "Semantic") is None


# gate


MANIFEST = Manifest(scopes=Scopes(known=("p", "q")), agents=(Agent("x", ("tutor",)), Agent("y")), frontmatter=Frontmatter(("bad",), ("no/tag",)), research_enabled=False)


def candidate(spark, **change):
    base = {"note_id": "n", "type": "semantic", "scope": "p", "agent": "x", "profile": "tutor", "confidence": "medium", "source": "s", "body": "b", "tags": ["t"], "keys": ["k"], "supersedes": [], "evidence": [], "merge": False}
    kinds = {"tags": "array<string>", "keys": "array<string>", "supersedes": "array<string>", "evidence": "array<string>", "merge": "boolean"}
    row = base | change
    return table(spark, [tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row))


@pytest.mark.parametrize(
    ("change", "check"),
    [
        ({"type": "research"}, "type_disabled"), ({"scope": " "}, "scope_missing"), ({"scope": "zz"}, "scope_unknown"), ({"agent": None}, "agent_missing"), ({"agent": "z"}, "agent_unknown"),
        ({"profile": "planner"}, "profile_unknown"), ({"keys": ["bad"]}, "denylist_keys"), ({"tags": ["no/tag"]}, "denylist_tags"), ({"tags": ["t", " ##no/tag"]}, "denylist_tags"), ({"confidence": "High"}, "confidence_invalid"),
        ({"source": ""}, "source_missing"), ({"type": "procedural"}, "evidence_missing"),
    ],
)
def test_each_rule_rejects_alone(spark, change, check):
    row = gate.evaluate(candidate(spark, **change), MANIFEST).first()
    assert [f.check for f in row.findings if f.severity == "reject"] == [check] and not row.accepted


def test_gate_warns_and_finds_duplicates(spark):
    fine = gate.evaluate(candidate(spark), MANIFEST).first()
    assert fine.accepted and [f.check for f in fine.findings] == ["reusable"]
    heavy = candidate(spark, confidence="high", body="# a\nx\n# b\ny\n# c\n```\n# d\n```")
    assert [f.check for f in gate.evaluate(heavy, MANIFEST).first().findings] == ["reusable", "atomic", "confidence_unverified"]
    near = table(spark, [("n", ["m"])], "note_id string, similar array<string>")
    assert not gate.evaluate(candidate(spark), MANIFEST, near).first().accepted
    assert gate.evaluate(candidate(spark, supersedes=["m"]), MANIFEST, near).first().accepted
    strict = Manifest(scopes=MANIFEST.scopes, agents=MANIFEST.agents, reject_unverified=True)
    assert not gate.evaluate(candidate(spark, confidence="high"), strict).first().accepted


def test_lint(spark):
    notes = candidate(spark, note_id="e", type="episodic").withColumns({"path": F.lit("v/Episodic/y/e.md"), "malformed": F.lit(False)})
    notes = notes.union(notes.withColumn("path", F.lit("v/Episodic/e2.md")).withColumn("note_id", F.lit("e2"))).union(notes.withColumn("malformed", F.lit(True)).withColumn("note_id", F.lit("m")))
    got = {r.note_id: [f.check for f in r.findings] for r in gate.lint(notes, MANIFEST).collect()}
    assert got == {"e": ["episodic_agent_mismatch"], "e2": ["episodic_unpartitioned"], "m": ["frontmatter_malformed"]}


# boards and settings


def test_boards(spark):
    notes = cycle_notes(spark).withColumns({"title": F.col("note_id"), "agent": F.lit("x"), "confidence": F.lit("high")})
    hot = boards.hot_board(notes, most=1)
    assert {(r.scope, r.note_id, r.more) for r in hot.collect()} == {("p", "proc2", 3), ("q", "read", 1)}
    assert "- [[edge]]" not in boards.index_map(notes).where("scope = 'q'").first().lines
    assert {r.path for r in boards.index_documents(boards.index_map(notes), 3).collect()} == {"indices/p.md", "indices/q.md"}
    order = spark.createDataFrame([("global",), ("z",), ("q",), ("a",)], "scope string").orderBy(boards.scope_order(F.col("scope"), ["q"]))
    assert [r.scope for r in order.collect()] == ["q", "a", "z", "global"]
    lines = table(spark, [("d", 1, "# top"), ("d", 2, "## p"), ("d", 3, "- one"), ("d", 4, "text"), ("d", 5, "- two")], "doc string, line_no int, text string")
    assert [tuple(r) for r in boards.parse_board(lines).orderBy("item").collect()] == [("d", "p", "one"), ("d", "p", "two")]
    acts = table(spark, [("write",), ("reject",), ("write",)], "action string")
    assert tuple(boards.activity_stats(acts).first()) == (2, 1)
    assert one(spark, boards.report_age(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-03 23:00:00").cast("timestamp"))) == 2


def test_manifest():
    m = Manifest.read({"scopes": {"known": ["a"]}, "agents": [{"name": "x", "profiles": ["p"]}], "retrieval": {"vector_weight": 0.7, "bm25_weight": 0.3}})
    assert m.agent("x").profiles == ("p",) and m.retrieval.vector_weight == 0.7
    for bad in ({"scope": {}}, {"retrieval": {"vector_weight": 0.9}}, {"retrieval": {"rerank": True}}, {"maintenance": {"decay_days": True}}, {"research_enabled": 1}, {"scopes": {"known": "a"}}):
        with pytest.raises(ConfigError):
            Manifest.read(bad)
    with pytest.raises(ConfigError, match="did you mean"):
        m.agent("xx")


# writing


def test_names_and_tags(spark):
    from lodestack.operators import write

    day = F.lit(D(2026, 1, 15))
    assert one(spark, write.note_name(F.lit("semantic"), F.lit("Olá mundo"), day)) == "2026-01-15_INS_ola-mundo"
    assert one(spark, write.note_name(F.lit("procedural"), F.lit("Deploy"), day)) == "PROC_deploy"
    assert one(spark, write.note_name(F.lit("episodic"), F.lit(None).cast("string"), F.lit(None).cast("date"))) == "MEM_nota"
    own = F.array(F.lit("x"), F.lit("mem/semantic"), F.lit("req"))
    assert one(spark, write.note_tags(F.lit("semantic"), F.lit("a"), ["req"], own)) == ["mem/semantic", "agent/a", "req", "x"]


def test_proposals_and_derived_documents(spark):
    from lodestack.operators import write

    notes, _, _ = vault(spark)
    changes = table(spark, [("a", "text", "x"), ("nope", "text", "x")], "target string, body string, agent string")
    assert [r.target for r in write.proposals(changes, notes).collect()] == ["a"]
    stored = table(spark, [("i", "1"), ("s", "2"), ("l", "3")], "path string, body string")
    rendered = table(spark, [("i", "1"), ("s", "9"), ("m", "4")], "path string, body string")
    assert {r.path: r.state for r in write.stale_documents(stored, rendered).collect()} == {"s": "stale", "l": "left over", "m": "missing"}
    refs = table(spark, [("[[a|b]]",), ("zz",)], "ref string")
    assert {r.ref: r.found for r in write.get(notes, refs).collect()} == {"[[a|b]]": True, "zz": False}
