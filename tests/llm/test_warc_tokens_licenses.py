import collections
import gzip
import hashlib
import random
import re

import pytest
from oracle import SF, connection, rows
from pyspark.sql import functions as F

from lodestack.llm import licenses, queries, warc, wordpiece


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), connection().execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


PAGES = [(1, "http://a", "x" * 1200), (2, "http://b", "x" * 1200), (3, None, "short"), (4, "http://c\nd", "short"), (5, "u", None), (None, "u", "y" * 2000), (6, "u", "é" * 600), (7, "u", "é" * 600), (7, "u", "é" * 600)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = warc.archive(pages, f"file://{tmp_path}/w")
    got = sorted(map(tuple, warc.page_digests(warc.read_archive(spark, path)).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if p in (1, 6) else "response", {1: 2, 6: 7}.get(p)) for p, _, h in PAGES]
    assert got == sorted(want, key=str)
    whole = warc.read_archive(spark, path)
    revisits = whole.where("record_type = 'revisit' and target_uri like 'http://%'")
    assert [r.record_id for r in revisits.collect()] == ["urn:x-page:1"]
    assert warc.read_archive(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.archive(pages.limit(0), f"{tmp_path}/none") and warc.read_archive(spark, f"{tmp_path}/none").count() == 0


def test_only_committed_files_are_read(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.archive(pages, f"{tmp_path}/w")
    (tmp_path / "w" / "part-stray.warc.gz").write_bytes(b"left by a task that was lost")
    assert warc.read_archive(spark, path).count() == len(PAGES)


def test_appending_adds_and_overwriting_replaces(spark, tmp_path):
    page = lambda i: spark.createDataFrame([(i, None, f"page {i}")], "page_id long, url string, html string")
    path = f"{tmp_path}/w"
    for i in (1, 2):
        warc.archive(page(i), path)
    read = lambda: sorted(r.page_id for r in warc.page_digests(warc.read_archive(spark, path)).collect())
    assert read() == [1, 2]
    warc.records(page(3)).write.format("warc").mode("overwrite").save(path)
    assert read() == [3]


@pytest.mark.parametrize("kind", ["plain", "gzip"])
def test_foreign_archives(spark, tmp_path, kind):
    record = {"record_type": "response", "record_id": "urn:r", "target_uri": "http://a", "date": "d", "refers_to": None, "payload_digest": None, "payload_length": None}
    raw = [warc.encode(record | {"record_id": f"urn:{i}", "payload": b"p" * n}) for i, n in enumerate((0, 10, 200_000))]
    raw.append(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    name = "x.warc" if kind == "plain" else "x.warc.gz"
    (tmp_path / name).write_bytes(b"".join(raw if kind == "plain" else map(gzip.compress, raw)))
    got = {r.record_id: (r.record_type, r.payload_length, len(r.payload)) for r in warc.read_archive(spark, str(tmp_path)).collect()}
    assert got == {"urn:0": ("response", 0, 0), "urn:1": ("response", 10, 10), "urn:2": ("response", 200_000, 200_000), None: ("warcinfo", 3, 3)}


def test_rejected_records_are_not_decoded():
    import io

    import pyarrow as pa

    record = {"record_type": "response", "record_id": "urn:r", "target_uri": "http://a", "date": "d", "refers_to": None, "payload_digest": None, "payload_length": None}
    good = warc.member(warc.encode(record | {"payload": random.Random(0).randbytes(100_000)}))
    broken = good[:50_000] + b"\0" * (len(good) - 50_000)  # the payload cannot be inflated
    for wanted, payload in ((lambda r: False, True), (lambda r: True, False)):
        found = list(warc.scan(pa.PythonFile(io.BytesIO(broken + good), "r"), len(broken) + len(good), wanted, payload))
        assert len(found) == (0 if payload else 2)


def test_filters():
    row = {"record_type": "response", "payload_length": None}
    assert warc.accepts(warc.EqualTo(("record_type",), "response"), row) and not warc.accepts(warc.GreaterThan(("payload_length",), 5), row)
    reader = warc.WarcReader({"path": "x"})
    left = list(reader.pushFilters([warc.In(("record_type",), ("a",)), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and len(reader.filters) == 1


# word pieces


def greedy(word, starts, rests):
    at = n = 0
    while at < len(word):
        known = rests if at else starts
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), 0)
        if not end:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(7)
    for _ in range(60):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        starts, rests = {piece() for _ in range(rng.randint(0, 8))}, {piece() for _ in range(rng.randint(0, 8))}
        machine = wordpiece.Automaton(starts, rests)
        for _ in range(120):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
            assert machine.count(word) == greedy(word, starts, rests)


def test_token_counts(spark, tmp_path, monkeypatch):
    (tmp_path / "v.txt").write_text("un\n##aff\n##able\na\n##b\n")
    pieces = wordpiece.load_pieces(str(tmp_path / "v.txt"))
    docs = spark.createDataFrame([(1, "unaffable a\tab zz"), (2, None), (3, " "), (1, "a")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    assert sorted(map(tuple, wordpiece.token_counts(docs, pieces).collect())) == [(1, 1, 1, 0), (1, 4, 7, 1), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert wordpiece.token_counts(docs.limit(0), pieces).count() == 0
    monkeypatch.setattr(wordpiece, "REMEMBERED", 1)
    known = wordpiece._Memory(wordpiece.Automaton(*pieces))
    assert [known[w] for w in ("a", "ab", "a")] == [1, 2, 1] and len(known) == 1


# licences


def plain_licences(text, templates, threshold=0.8):
    """{template: dice} by trying every stretch of a text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    out = {}
    for t, (_, said) in enumerate(templates):
        bag = licenses.template_bigrams(said)
        for first in {i - k for i, x in enumerate(pairs) for k, y in enumerate(bag) if x == y}:
            part = pairs[max(first, 0) : first + len(bag)]
            dice = 2 * (collections.Counter(part) & collections.Counter(bag)).total() / (len(part) + len(bag))
            if dice >= threshold - 1e-9:
                out[t] = max(out.get(t, 0), dice)
    return out


def test_licences(spark):
    """Notices in long lines, wrapped ones, whole texts with changes, repeated rows, ties and odd texts."""
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    rng = random.Random(6)
    texts = [
        "Copyright (c) 2020 Jane Doe. Released under the MIT License.", "Copyright 2020 Foo. All rights reserved.", "long prose " * 300 + "all rights reserved and so on",
        "Licensed under the\n  Apache License,\nVersion 2.0.\n\nMore of it", mit, mit.replace("Software", "Program").replace("AUTHORS", "WRITERS"), "x " * 50 + mit[: len(mit) // 2],
        "LICENSED UNDER CC BY 4.0!", "Licensed under CC BY-SA 4.0, all  rights\treserved", "reserved rights all", "all", "", None, " \n", "a b", "\u00dcber all rights reserved",
        *[" ".join(rng.choices(re.findall(r"\w+", mit), k=rng.randint(5, 60))) for _ in range(20)], " ".join([mit] * 4), "all rights reserved " * 200,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3 + [(None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licenses": F.lit("clash"), "T": F.lit(1), "hits": F.lit(2)})
    for templates in (None, [("b", "all rights reserved"), ("a", "All rights reserved!"), ("one", "word"), ("none", "")]):
        known = [x for x in (licenses.TEMPLATES if templates is None else templates) if licenses.template_bigrams(x[1])]
        got = collections.Counter((r.doc_id, tuple(r.licenses), r.n_matches, r.best_license, r.best_dice) for r in licenses.scan_licenses(docs, templates=templates).collect())
        want = collections.Counter()
        for i, t in rows:
            found = plain_licences(t, known)
            best = min(((-d, known[k][0]) for k, d in found.items()), default=(None, None))
            want[i, tuple(sorted({known[k][0] for k in found})), len(found), best[1], None if best[0] is None else round(-best[0], 6)] += 1
        assert got == want
    found = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert found[0] == ["MIT"] and found[1] == ["proprietary"] and found[3] == ["Apache-2.0"] and "MIT" in found[4] and "MIT" in found[5] and found[6] == []
    assert licenses.scan_licenses(docs.limit(0)).count() == 0 and licenses.scan_licenses(docs, templates=[]).agg(F.sum("n_matches")).first()[0] == 0


def test_notices(spark):
    apache = licenses.TEMPLATES[4][1]
    docs = [(1, f"prose\n{licenses.TEMPLATES[0][1]}\nmore"), (2, apache.replace(" You ", "\nYou ")), (3, "Licensed under the Apache License, Version 2.0"), (4, None), (5, ""), (6, "All rights reserved. " * 4), (7, "unrelated words only"), (8, "x\n\n" + apache.replace(" ", "\n") + "\n\ny"), (9, "released UNDER the mit license?\nCC BY 4.0, Licensed under")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    got = {r.doc_id: (r.licenses, r.best_license) for r in licenses.scan_licenses(df).collect()}
    assert got[1] == (["MIT"], "MIT") and got[2][1] == "Apache-2.0" and got[3][1] == "Apache-2.0" and got[8][1] == "Apache-2.0"
    assert all(got[i] == ([], None) for i in (4, 5, 7)) and got[9][1] == "MIT"
    assert licenses.scan_licenses(df.limit(0)).count() == 0 and licenses.scan_licenses(df, templates=[]).where("n_matches > 0").count() == 0
