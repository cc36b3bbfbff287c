import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestack.llm import merkle, queries, variants

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, Place int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """All levels, from the leaves to the root."""
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
    return rows


def plain_way(rows, at, digest):
    """(siblings level by level, the root with ``digest`` at ``at``)."""
    siblings = []
    for row in rows[:-1]:
        first = at // 8 * 8
        run = row[first : first + 8]
        siblings += run[: at - first] + run[at - first + 1 :]
        digest, at = sha(*run[: at - first], digest, *run[at - first + 1 :]), at // 8
    return siblings, digest


def brute(docs):
    leaves = {}
    for r in docs:
        text = r["text"]
        lower = text and "".join(c.lower() if c.isascii() else c for c in text)
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        leaf = plain_leaf(r, text)
        leaves.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, plain_leaf(r, lower) if hit else leaf))
    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        leaves[g].sort()
        trees[g] = plain_tree([x[2] for x in leaves[g]])
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for at, (has, doc, leaf, changed) in enumerate(leaves[g]):
            low, sub = plain_way(trees[g], at, changed)
            high, folded = plain_way(top, place, sub)
            out.append((doc if has else None, leaf, trees[g][-1][0], top[-1][0], sha(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def spark_rows(spark, docs, tmp_path):
    path = str(tmp_path / f"t{len(docs)}")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    rows = queries.op12_merkle_manifest(spark, path).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows), key=str)


def doc(i, lang="en", text="Some Text", source="s"):
    return dict(doc_id=i, source=source, lang=lang, n_chars=len(text or ""), text=text, digest="d", Place=1)


def as_dicts(spark, docs):
    return [r.asDict() for r in spark.createDataFrame(docs, SCHEMA).collect()]


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    docs = [doc(i, text=f"Text {i}") for i in range(n)]
    assert spark_rows(spark, docs, tmp_path) == brute(as_dicts(spark, docs))


def test_edges(spark, tmp_path):
    docs = [doc(i, lang=f"l{i % 11}", text="É A" * i) for i in range(150)] + [doc(5, None, None), doc(None, None, ""), doc(7, "", "X", None), doc(3, "a"), doc(3, "a"), doc(3, "a", "Z" * 300_000), doc(900, "ab"), doc(901, "B")]
    got = spark_rows(spark, docs, tmp_path)
    assert got == brute(as_dicts(spark, docs)) and {x[-1] for x in got} == {True, False}


def test_more_than_one_subtree(spark, tmp_path, monkeypatch):
    """Subtrees of one level make several rounds both up and down."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    docs = [doc(i, lang=f"l{i % 2}" if i < 300 else f"m{i % 70}", text=f"T{i}") for i in range(420)]
    assert spark_rows(spark, docs, tmp_path) == brute(as_dicts(spark, docs))


def test_empty(spark, tmp_path):
    assert spark_rows(spark, [], tmp_path) == []


def test_only_right_siblings_are_hashed():
    digests = [sha(str(i)).encode() for i in range(200)]
    tree = merkle.Subtree(digests, 3)
    rows = plain_tree([d.decode() for d in digests])
    assert tree.root.decode() == rows[-1][0] and len(tree.states[0]) == 200
    for at in (0, 7, 8, 130, 199):
        siblings, root = plain_way(rows, at, sha("new"))
        assert tree.fold(at, sha("new").encode()).decode() == root
        assert "".join(siblings).encode() == b"".join(a + b for a, b in tree.siblings(at))
    # what lies left is in the retained state: a fold without it still gives the root
    tree.rows[0] = b"?" * (64 * 130) + tree.rows[0][64 * 130 :]
    assert tree.fold(130, digests[130]) == tree.root


def test_places(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 10)).alias("key"), F.lit("x").alias("digest"))
    placed = merkle.numbered(rows.withColumn("id", F.col("id") % 50), "key", ["id"]).collect()
    for key in {r.key for r in placed}:
        mine = sorted((r.place, r.id) for r in placed if r.key == key)
        assert [p for p, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
        assert {r["size"] for r in placed if r.key == key} == {len(mine)}


def test_lower_ascii(spark):
    row = spark.createDataFrame([("ÀBcİ",), ("ABC",), (None,)], "t string").select(variants.lower_ascii(F.col("t")).alias("t")).collect()
    assert [r.t for r in row] == ["Àbcİ", "abc", None]
