import random
import re
import zlib
from collections import Counter

from lodestack.llm import queries, variants

SCHEMA = "doc_id long, text string, word string, N int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    form, count = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], words.get(form[w]), count[w], root))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()), key=str)


def made(seed, n_docs):
    r = random.Random(seed)
    base = ["".join(r.choices("abcé", k=r.randint(6, 12))) for _ in range(40)]

    def typo(w):
        i, kind = r.randrange(len(w)), r.randrange(4)
        return w if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + r.choice("abcÉZ") + w[i + (kind == 2) :]

    return [(i, " ".join(typo(r.choice(base)) if r.random() < 0.3 else r.choice(base[: 1 + i % 40]) for _ in range(60))) for i in range(n_docs)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = made(seed, 120)
        df = spark.createDataFrame([(*d, "w", 1) for d in docs], SCHEMA)
        got = found(variants.group_spellings(df))
        assert got == brute(docs) and any(r[2] for r in got)


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "Straße straße straßen STRASSE"), (None, "straße straßen"), (3, "aaaaaaaa aaaaaaa aaaaaaaaa aaaaaaa aaaaaaaa aaaaaaaaa"), (4, "×××÷÷÷× ×××÷÷÷×"), (5, "x" * 9_000 + " " + "x" * 9_000 + " " + "x" * 9_001 + " " + "x" * 9_001), (6, "a1b2 short wörter")]
    docs += [(7, "repeated repeated repeeted repeeted")] * 3
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], SCHEMA)
    got = found(variants.group_spellings(df))
    assert got == brute(docs)
    assert any(len(r[0]) == 9_000 and r[4] == 1 for r in got)
    assert variants.group_spellings(df.limit(0)).count() == 0


def test_chain_of_forms(spark):
    words = spark.createDataFrame([("abcdefgh", 1000), ("abcdefgx", 100), ("abcdefyx", 10), ("abcdwfyx", 1), ("zzzzzzzz", 5)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.variants(words).collect()}
    assert got["abcdwfyx"] == ("abcdefyx", "abcdefgh", 1) and got["abcdefgh"] == (None, "abcdefgh", 1) and got["zzzzzzzz"] == (None, "zzzzzzzz", 0)


def test_every_edit_keeps_a_chunk(spark):
    """All words one edit from a few, at every place, are found, and no others."""
    words = set()
    for w in ("abcdefg", "aaaaaaa", "abababab", "naïvetés"):
        words.add(w)
        for i in range(len(w) + 1):
            words |= {w[:i] + c + w[i:] for c in "aéz"} | {w[:i] + c + w[i + 1 :] for c in "aéz"} | {w[:i] + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    pairs = variants.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    got = sorted(tuple(sorted((p.a, p.b))) for p in pairs)
    assert got == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = found(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert [r[:2] for r in got] == [r[:2] for r in brute(docs)]
