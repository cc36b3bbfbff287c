r"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Strict patterns find base spans that always count.  Looser, high-recall generators
propose further spans, which may overlap: addresses with a spelt-out ``at`` or ``dot``,
four numbers with odd separators, runs of digits (as card and as phone), long mixed runs
of characters and what follows the word password or token.  Gradient-boosted trees score
each candidate by its format and context; for every kind a threshold is calibrated on
held-out candidates to a target precision.  Candidates that reach it and overlap no base
span are added, a run of digits as the kind that it suits best.

Labels come from planting, not from the validators of the base spans.  Contexts are cut
out of a bounded sample of the documents; into each goes an item of known nature: personal
data written as people write it (``bob [at] host dot org``, ``1[.]2[.]3[.]4``, a card number
with dots, a phone number without plus, keys) or a look-alike (orders, dates, versions,
lists, sentences around the word at, checksums, identifiers).  The generators are run on
the planted texts, and their candidates are labelled by what was planted there.  So every
kind has both classes whatever the corpus holds; ``sample_docs`` and ``sample_rows`` bound
the sample, and scoring covers all documents.

Scoring is one projection without a shuffle: spans stay in their document's row and the
fitted trees become an expression over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let, scan
from .workspace import cut

#: Base kinds, and what only the generators find.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# The strict patterns, possessive and anchored to starts of runs, so that long runs cost linear time.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_STRICT = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True))
# The generators; all repetitions are bounded or possessive.
_AT = r"(?:@|\x20@\x20|\x20?[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20\.\x20|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?|\x20(?:dot|DOT)\x20)"
_LIKE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:[.,:·_-]|[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]|\x20dot\x20)\x20?[0-9]{1,3}+){3}(?![0-9])",
    "number": r"(?:\+|(?<![0-9+]))\(?[0-9](?:[\x20().·/_ ‑-]{0,3}+[0-9]){6,24}+(?![0-9])",
    "run": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "named": r"(?<=(?:password|passwd|pwd|secret|token|key)[\"']{0,1}\s{0,2}[:=]\s{0,2}[\"']{0,1})(?![\"'])[^\s\"',;]{6,}+",
}
#: Kinds that a generator's spans may be.
_PROPOSES = {"email": ("email",), "ip": ("ip",), "number": ("card", "phone"), "run": ("secret",), "named": ("secret",)}
_CONTEXT = 24
_WORDS = (r"(?i)tel|phone|call|fax|mob|ring|whatsapp", r"(?i)mail|contact|write|reach", r"(?i)\bip\b|host|addr|server|ping", r"(?i)card|visa|pay|acc|master|amex|iban", r"(?i)token|secret|passw|pwd|api|auth|cred", r"(?i)order|item|no\b|nr\b|id\b|isbn|part|inv|page|vers|build|chap", r"(?i)commit|sha|md5|etag|check|hash|digest")
_SPAN = "struct<start:int,end:int,said:string,before:string,after:string>"


def find(text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column] = lambda said: F.lit(True)) -> Column:
    """The leftmost non-overlapping matches that ``keep`` accepts as (start, end, said, before, after), in code points.

    The pieces between matches and the matches alternate, so running lengths give
    the places.  ``gate`` is a cheap necessary condition; where it is false the
    pattern is not tried.
    """
    pieces, said = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(pieces, lambda p: F.arrays_zip(p.alias("gap"), said.alias("said"), F.slice(p, F.lit(2), F.size(p)).alias("rest")))
    # the last piece has no match behind it
    pairs = F.filter(pairs, lambda x: x["said"].isNotNull())
    begin = lambda at, x: at + F.length(x["gap"])
    span = lambda at, x: F.struct(begin(at, x).alias("start"), (begin(at, x) + F.length(x["said"])).alias("end"), x["said"].alias("said"), F.right(x["gap"], F.lit(_CONTEXT)).alias("before"), F.left(x["rest"], F.lit(1)).alias("after"))
    found = scan(pairs, F.lit(0), lambda at, x: begin(at, x) + F.length(x["said"]), span, lambda _, x: keep(x["said"]), _SPAN)
    return F.when(gate, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda n, d: n + d)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return _luhn_sum(digits) % 10 == 0


def valid(kind: str, said: Column) -> Column:
    """What a match of the strict pattern must fulfil besides."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.transform(F.split(said, r"\."), part), lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).try_cast("int") <= 255))
    if kind == "card":
        digits = _digits(said)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(said)).between(10, 15)
    return F.lit(True)


def strict(kind: str, said: Column) -> Column:
    """Whether ``said`` is wholly a base span."""
    return said.rlike(f"^(?:{_STRICT[kind]})$") & valid(kind, said)


def _base(text: Column) -> dict[str, Column]:
    """Base spans of each kind."""
    number = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": number, "card": number, "phone": number & F.contains(text, F.lit("+"))}
    return {k: find(text, _STRICT[k], gates[k], lambda said, k=k: valid(k, said)) for k in KINDS}


def _proposed(text: Column) -> dict[str, Column]:
    """Spans of each generator, without those that are base spans themselves."""
    number, lower = text.rlike("[0-9]"), F.lower(text)
    gates = {"email": F.contains(text, F.lit("@")) | lower.rlike(r"(?:\x20|[(\[{<]\x20?)at[\x20)\]}>]"), "ip": number, "number": number, "run": number, "named": text.rlike("(?:password|passwd|pwd|secret|token|key)[\"']?\\s{0,2}[:=]")}
    new = {"email": lambda s: ~strict("email", s), "ip": lambda s: ~strict("ip", s), "number": lambda s: ~(strict("card", s) | strict("phone", s)), "run": lambda s: F.lit(True), "named": lambda s: ~s.rlike(_LIKE["run"])}
    return {g: find(text, p, gates[g], new[g]) for g, p in _LIKE.items()}


FEATURES = ("length", "digits", "letters", "capitals", "hex", "dots", "dashes", "blanks", "brackets", "colons", "underscores", "plus", "zeros_first", "at", "at_word", "dot_word", "groups", "longest", "shortest", "small_parts", "luhn", "mixed", "ends_in_letters", "glued_before", "glued_after", "assigned", "sentence", "tel", "mail", "host", "card_word", "key", "order", "checksum", *ALL_KINDS)


def _features(kind: str, s: Column) -> Column:
    said, before = s["said"], s["before"]
    count = lambda p: F.length(F.regexp_replace(said, f"[^{p}]", ""))
    groups = F.split(F.trim(F.regexp_replace(said, "[^0-9A-Za-z]+", " ")), " ")
    parts = F.transform(groups, F.length)
    small = F.forall(groups, lambda g: g.rlike("^[0-9]{1,3}$") & (F.substring(g, 1, 3).try_cast("int") <= 255))
    digits = _digits(said)
    changes = F.size(F.regexp_extract_all(said, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]"), F.lit(0)))
    values = [
        F.length(said), count("0-9"), count("A-Za-z"), count("A-Z"), count("0-9a-f"), count("."), count("-"), count(r"\x20"), count(r"()\[\]{}<>"), count(":,/"), count("_=+/"), count("+"), said.rlike("^00"),
        F.contains(said, F.lit("@")), said.rlike("(?i)[^a-z]at[^a-z]"), F.size(F.regexp_extract_all(said, F.lit("(?i)[^a-z]dot[^a-z]"), F.lit(0))),
        F.size(groups), F.array_max(parts), F.array_min(parts), small, F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False), changes,
        said.rlike(r"(?:^|[^A-Za-z])[a-z]{2,6}$"), F.right(before, F.lit(1)).rlike("[0-9A-Za-z]"), s["after"].rlike("[0-9A-Za-z]"), before.rlike("[:=]\\s{0,2}[\"']?$"), said.rlike(r"\.\x20|[A-Z][a-z]+$"),
        *[before.rlike(w) for w in _WORDS], *[F.lit(float(kind == k)) for k in ALL_KINDS],
    ]
    return F.transform(F.array(*[v.cast("double") for v in values]), lambda v: F.coalesce(v, F.lit(0.0)))


# --------------------------------------------------------------------- planting


def _pick(h: Column, salt: str, of: list[Column | str]) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in of])[F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(len(of))).cast("int")]


def _some_digits(h: Column, salt: str, n: int) -> Column:
    return F.substring(F.lpad(F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(10**18)).cast("string"), 18, "0"), 18 - n + 1, n)


def _some_letters(h: Column, salt: str, least: int, most: int) -> Column:
    said = F.translate(F.md5(F.concat(h.cast("string"), F.lit(salt))), "0123456789", "ghijklmnop")
    return F.substring(said, F.lit(1), least + F.pmod(F.xxhash64(h, F.lit(salt), F.lit(1)), F.lit(most - least + 1)).cast("int"))


def _part(h: Column, salt: str, below: int = 256) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(below)).cast("string")


def _grouped(h: Column, digits: Column, sizes: list[int], separators: list[str], salt: str) -> Column:
    said, at = [], 1
    for n in sizes:
        said.append(F.substring(digits, at, n))
        at += n
    return F.concat_ws("\x01", *said).replace("\x01", "") if not separators else _pick(h, salt, [F.concat_ws(s, *said) for s in separators])


def _planted(h: Column) -> Column:
    """(kind, cue, said): an item of a kind, or a look-alike with an empty kind."""
    name = F.concat(_some_letters(h, "u", 2, 9), _pick(h, "u2", ["", "", F.concat(F.lit("."), _some_letters(h, "u3", 2, 8)), _some_digits(h, "u4", 2), F.concat(F.lit("."), _some_digits(h, "u5", 2))]))
    host, top = _some_letters(h, "h", 2, 10), _pick(h, "t", ["com", "org", "net", "io", "de", "fr", "es", "edu", "example.com", "co.uk"])
    lit = F.lit
    emails = [F.concat(name, lit(at), host, lit(dot), F.replace(top, lit("."), lit(dot))) for at, dot in ((" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" AT ", " DOT "), (" @ ", " . "), ("@", " dot "), ("[at]", "."), (" {at} ", " {dot} "), ("@", " [dot] "), (" <at> ", "."))]
    numbers = [_part(h, f"i{i}") for i in range(4)]
    ips = [F.concat_ws(s, *numbers) for s in ("[.]", " . ", "(.)", " dot ", "[dot]", "-", " [.] ", "_", ".", "(dot)")]
    fifteen = F.concat(_pick(h, "c0", ["4", "5", "3", "6"]), _some_digits(h, "c1", 14))
    check = lambda d: let(F.concat(d, lit("0")), lambda z: F.concat(d, F.pmod(10 - _luhn_sum(z), lit(10)).cast("string")))
    card = check(fifteen)
    amex = check(F.concat(lit("37"), _some_digits(h, "c2", 12)))
    odd = [".", " . ", "/", "_", "  ", " - ", "·", " ", "--"]
    cards = [_grouped(h, card, [4, 4, 4, 4], odd, "cs"), _grouped(h, card, [4, 4, 4, 4], odd, "ct"), _grouped(h, amex, [4, 6, 5], odd, "cu")]
    a, b, c, d = (_some_digits(h, f"p{i}", n) for i, n in enumerate((2, 3, 3, 4)))
    area = F.concat(_pick(h, "pa", list("23456789")), a)
    phones = [F.concat(*p) for p in ((lit("00"), _pick(h, "pc", ["1", "33", "34", "44", "49"]), lit(" "), area, lit(" "), b, lit(" "), d), (lit("("), area, lit(") "), b, lit("-"), d), (area, lit("-"), b, lit("-"), d), (area, lit("."), b, lit("."), d), (lit("0"), area, lit("/"), c, lit(" "), d), (lit("0"), a, lit(" "), F.substring(b, 1, 2), lit(" "), F.substring(c, 1, 2), lit(" "), F.substring(d, 1, 2), lit(" "), F.substring(d, 3, 2)), (lit("0"), area, lit("-"), c, d), (area, lit(" "), b, lit(" "), d))]
    code = lambda salt: F.md5(F.concat(h.cast("string"), lit(salt)))
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(code("k1"), code("k2")))), "[+/=]", "")
    keys = [code("k3"), F.sha1(code("k4")), F.sha2(code("k5"), 256), F.substring(mixed, 1, 24), F.substring(mixed, 1, 40), F.concat(lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.concat(lit("ghp_"), F.substring(mixed, 1, 36))]
    passwords = [F.concat(F.initcap(_some_letters(h, "w", 4, 8)), _some_digits(h, "w2", 2), _pick(h, "w3", ["!", "#", "$", "?", "%"])), F.substring(mixed, 3, 10), F.concat(_some_letters(h, "w4", 4, 8), _some_digits(h, "w5", 4))]
    # look-alikes
    wrong = F.concat(fifteen, F.pmod(F.right(card, lit(1)).cast("int") + 1 + F.pmod(h, lit(9)), lit(10)).cast("string"))
    year, month, day = F.concat(_pick(h, "y", ["19", "20"]), _some_digits(h, "y2", 2)), F.lpad((F.pmod(h, lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(h, lit(28)) + 1).cast("string"), 2, "0")
    two = [_some_digits(h, f"n{i}", 2) for i in range(8)]
    word = lambda salt: _some_letters(h, salt, 2, 9)
    orders = [_grouped(h, wrong, [4, 4, 4, 4], [*odd, "", " ", "-"], "os"), F.concat(_some_digits(h, "o", 9)), F.concat(_some_digits(h, "o2", 17)), F.concat(lit("978-"), F.substring(two[0], 1, 1), lit("-"), two[1], lit("-"), _some_digits(h, "o3", 6), lit("-"), F.substring(two[2], 1, 1)), F.concat(_some_digits(h, "o4", 4), lit("/"), _some_digits(h, "o5", 6))]
    bare = [_some_digits(h, f"b{n}", n) for n in range(7, 19)] + [wrong, wrong, wrong]
    dates = [F.concat(year, lit("-"), month, lit("-"), day, lit(" "), two[0], lit("."), two[1]), F.concat(day, lit("."), month, lit("."), year, lit(" - "), two[0]), F.concat(year, lit("-"), F.concat(year)), F.concat(year, month, day, two[1], two[2]), F.concat(lit("0."), _some_digits(h, "f", 14)), F.concat(_some_digits(h, "f2", 3), lit("."), _some_digits(h, "f3", 9)), F.concat(year, lit("/"), month, lit("/"), day, lit("/"), two[0])]
    lists = [F.concat_ws(s, *two[:n]) for s, n in ((", ", 4), (":", 4), (" ", 6), (" - ", 5), (",", 4), (" / ", 5), (" ", 8), ("-", 4))] + [F.concat_ws("-", *[_some_digits(h, f"l{i}", 3) for i in range(4)])]
    sentences = [F.concat(word("s1"), lit(at), word("s2"), lit(dot), F.initcap(word("s3"))) for at, dot in ((" at ", "."), (" @ ", " . "), (" at ", " dot "))] + [F.concat(word("s4"), lit(" at "), word("s5"), lit(" . "), F.initcap(word("s6"))), F.concat(word("s7"), lit(" @ "), two[0], lit("."), two[1]), F.concat(word("s8"), lit(" at "), two[2], lit("."), two[3])]
    named = [F.concat(word("d1"), lit("_"), word("d2"), lit("_"), two[0], lit("_"), word("d3")), F.concat(word("d4"), lit("/"), year, lit("/"), month, lit("/"), word("d5"), lit("-"), word("d6")), F.concat(F.upper(word("d7")), lit("-"), year, lit("-"), _some_digits(h, "d8", 6), lit("-"), two[1]), F.concat(word("d9"), lit("-"), word("da"), lit("-"), word("db"), lit("-"), two[2]), F.concat(word("dc"), word("dd"), word("de"), two[0])]
    plain = [word("e1"), F.concat(word("e2"), lit("_"), word("e3")), F.concat(word("e4"), lit("."), word("e5")), F.concat(lit("<"), word("e6"), lit(">"))]
    sums = [F.sha1(code("g")), code("g2"), F.concat_ws("-", F.substring(code("g3"), 1, 8), F.substring(code("g3"), 9, 4), F.substring(code("g3"), 13, 4), F.substring(code("g3"), 17, 4), F.substring(code("g3"), 21, 12))]
    assigned = ['token = "', "token: ", "api_key=", "secret: ", "secret = '", "auth_token=", '"key": "']
    kinds = [
        ("email", ["mail: ", "contact ", "write to ", "reach me: ", "", ""], emails),
        ("ip", ["ip ", "host ", "server at ", "ping ", "", ""], ips),
        ("card", ["card ", "visa ", "pay with ", "amex ", "", ""], cards),
        ("phone", ["tel ", "call ", "phone: ", "mobile ", "", ""], phones),
        ("secret", assigned, keys),
        ("secret", ["", "", "auth "], keys),
        ("secret", ["password: ", "password=", 'pwd = "', "passwd: "], passwords),
        ("", ["order ", "item no ", "part ", "invoice ", "id ", ""], orders),
        ("", ["", "", "", "no ", "id "], bare),
        ("", ["on ", "dated ", "page ", "build ", "", ""], dates),
        ("", ["no ", "chapters ", "version ", "", "", ""], lists),
        ("", ["", "", ""], sentences),
        ("", ["file ", "see ", "id ", "", ""], named),
        ("", ["password: ", "token: ", "key = ", 'key: "', "secret: "], plain),
        ("", ["commit ", "sha1 ", "md5 ", "etag ", "checksum: "], sums),
    ]
    return _pick(h, "kind", [F.struct(lit(k).alias("kind"), _pick(h, f"cue{i}", cues).alias("cue"), _pick(h, f"said{i}", said).alias("said")) for i, (k, cues, said) in enumerate(kinds)])


def training_rows(docs: DataFrame, sample_docs: int = 2_000, sample_rows: int = 24_000) -> DataFrame:
    """(kind, x, label, held_out): candidates on items planted in contexts of a bounded sample of ``docs``."""
    total = docs.count()
    order = F.xxhash64("doc_id", "text")
    # the share is of all rows, so the sample's size does not follow the corpus
    share = int(1_000_003 * min(1.0, 2 * sample_docs / max(total, 1))) + 1
    text = F.coalesce("text", F.lit(""))
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.greatest(F.length(text) - 60, F.lit(1))).cast("int")
    sample = docs.where(F.pmod(order, F.lit(1_000_003)) < share).select(order.alias("h"), F.substring(text, at + 1, F.lit(30)).alias("left"), F.substring(text, at + 31, F.lit(20)).alias("right"))
    sample = cut(sample.orderBy("h", "left", "right").limit(sample_docs))
    times = -(-sample_rows // max(sample.count(), 1))
    # the sample comes from one task; what is planted is spread over more
    rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("i")).repartition(8, "h", "i").withColumn("h", F.xxhash64("h", "left", "right", "i"))
    rows = cut(rows.withColumn("p", _planted(F.col("h"))))
    left = F.concat(F.regexp_extract("left", r"(?s)^.*\s", 0), F.col("p.cue"))
    right = F.concat(F.when(F.col("p.cue").rlike("[\"']$"), F.right("p.cue", F.lit(1))).otherwise(""), F.regexp_replace("right", r"^\S*", ""))
    rows = rows.select("h", F.col("p.kind").alias("planted"), F.length(left).alias("from"), (F.length(left) + F.length("p.said")).alias("to"), F.concat(left, "p.said", right).alias("t"))
    found = rows.select("*", F.explode(F.flatten(_candidates(_proposed(F.col("t"))))).alias("c")).where((F.col("c.start") < F.col("to")) & (F.col("from") < F.col("c.end")))
    exact = (F.col("c.start") == F.col("from")) & (F.col("c.end") == F.col("to"))
    same = F.col("c.kind") == F.col("planted")
    inside = (F.col("from") <= F.col("c.start")) & (F.col("c.end") <= F.col("to"))
    # part of an item of its kind, or more than an item, is neither right nor wrong
    return found.where(exact | (inside & ~same)).select("c.kind", "c.x", same.cast("int").alias("label"), (F.pmod("h", F.lit(4)) == 0).alias("held_out"))


def _candidates(proposed: dict[str, Column]) -> Column:
    """Array of spans over all generators, each an array of (kind, start, end, x) with one for each kind that it may be."""
    of = lambda kind, s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _features(kind, s).alias("x"))
    kinds = lambda g: lambda s: F.array(*[of(k, s) for k in _PROPOSES[g]])
    return F.concat(*[F.transform(spans, kinds(g)) for g, spans in proposed.items()])


# ---------------------------------------------------------------------- fitting


def trees_to_sql(model: GBTClassificationModel, x: str) -> str:
    """The model's probability of the positive class as SQL over a feature array."""

    def walk(node) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            return f"{node.prediction()!r}D"
        split = node.split()
        return f"IF({x}[{split.featureIndex()}] <= {split.threshold()!r}D, {walk(node.leftChild())}, {walk(node.rightChild())})"

    margin = " + ".join(f"{weight!r}D * {walk(tree._call_java('rootNode'))}" for tree, weight in zip(model.trees, model.treeWeights, strict=True))
    return f"1 / (1 + exp(-2 * ({margin})))"


def fit(docs: DataFrame, precision: float = 0.98, sample_docs: int = 2_000, sample_rows: int = 24_000) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """(trees, threshold of each kind); None if ``docs`` is empty.

    A threshold is the least score above which the held-out candidates of its kind are
    right with ``precision``, at steps of 1/50, and one half at least.
    """
    rows = cut(training_rows(docs, sample_docs, sample_rows).coalesce(4))
    train, held = rows.where(~F.col("held_out")), rows.where("held_out")
    if train.isEmpty():
        return None
    vectors = train.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"))
    model = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.3, seed=7).fit(vectors)
    scored = model.transform(held.select("kind", "label", array_to_vector("x").alias("features")))
    bins = scored.groupBy("kind", F.floor(vector_to_array("probability")[1] * 50).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()
    thresholds = {}
    for kind in ALL_KINDS:
        n = right = 0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, right = n + r["n"], right + r["right"]
            if right / n >= precision:
                thresholds[kind] = max(r["bin"] / 50, 0.5)
    return model, thresholds


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind)


def _clear(base: Column, added: Column) -> Column:
    """The spans of ``added`` that overlap none of ``base``; both as (start, rank, kind, end)."""
    kind = "struct<start:int,rank:bigint,kind:string,end:int,base:boolean>"
    mark = lambda spans, is_base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(is_base).alias("base")))
    # base spans come first among those of one start, so the furthest end of base spans tells overlaps from the left
    ordered = lambda spans: F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["base"].cast("int") - a["base"].cast("int")))
    itself = lambda _, x: x
    free = scan(ordered(F.concat(mark(base, True), mark(added, False))), F.lit(0), lambda s, x: F.when(x["base"], F.greatest(s, x["end"])).otherwise(s), itself, lambda s, x: x["base"] | (s <= x["start"]), kind)
    # and the nearest start, coming from the right
    free = scan(F.reverse(free), F.lit(2**31 - 1), lambda s, x: F.when(x["base"], F.least(s, x["start"])).otherwise(s), itself, lambda s, x: ~x["base"] & (x["end"] <= s), kind)
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_pii(docs: DataFrame, precision: float = 0.98, sample_docs: int = 2_000, sample_rows: int = 24_000) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for every row of ``docs`` (doc_id, text).

    Places are code points, the end exclusive; spans are sorted by start, then
    kind, and contain the base spans.  Null text is empty.  Base spans of different
    kinds may overlap; added ones overlap no base span.  Whole texts are scanned, in
    time that grows at most as the length times the root of its number of matches.
    Repeated rows are treated alike; other columns are ignored.
    """
    fitted = fit(docs, precision, sample_docs, sample_rows)
    text = F.col("_t")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    plain = lambda k, found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), _rank(F.lit(k)).alias("rank"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*[plain(k, found) for k, found in _base(text).items()]))
    rows = rows.select("doc_id", base.alias("_base"), (_candidates(_proposed(text)) if fitted else F.lit(None)).alias("_like"))
    added = F.array().cast("array<struct<start:int,rank:bigint,kind:string,end:int>>")
    if fitted:
        model, thresholds = fitted
        least = f"coalesce({', '.join(f'IF(c.kind = {k!r}, {t}D, null)' for k, t in thresholds.items())}, 2D)"
        # by how far a span passes as each kind; the best one counts
        passing = f"transform(array({trees_to_sql(model, 'c.x')}), p -> IF(p >= {least}, named_struct('over', {least} - p, 'kind', c.kind, 'start', c.start, 'end', c.end), null))[0]"
        best = F.array_compact(F.expr(f"transform(_like, g -> array_min(transform(g, c -> {passing})))"))
        added = F.transform(best, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    spans = let(added, lambda a: F.when(F.size(a) > 0, F.array_sort(F.concat("_base", _clear(F.col("_base"), a)))).otherwise(F.col("_base")))
    return rows.select("doc_id", slim("_base").alias("base"), slim(spans).alias("spans"))


def spans_text(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find_pii`` returns."""
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    counts.append((F.size("spans") - F.size("base")).cast("long").alias("n_added"))
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[PII]") -> DataFrame:
    """doc_id and text with every span replaced by ``mark``; ``found`` has one row for each doc_id.

    Overlapping spans become one mark.
    """
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found.select("doc_id", "spans"), "doc_id")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(acc["text"], acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.length(acc["text"]))))
    return joined.select("doc_id", done.alias("text"))
