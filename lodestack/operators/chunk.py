"""Heading-aware chunking of Markdown bodies, as column expressions.

A body is cut by one pattern into tokens: a fenced block as a whole, or a line.  All
that follows is arithmetic on arrays in the note's row: places of headings bound the
sections, places after blank tokens start the paragraphs, and greedy filling is a
running pass that says where chunks begin.  Nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let, places, runs, scan, shared_prefix
from ..functions.text import context_prefix, embed_text

MAX_CHARS, OVERLAP = 1200, 120
FENCE = r"^ {0,3}(?:(`{3,}+).*?(?:^ {0,3}\1`*+[^\S\n]*+$|\z)|(~{3,}+).*?(?:^ {0,3}\2~*+[^\S\n]*+$|\z))"
_TOKEN = rf"(?msd){FENCE}|^[^\n]*+$"
_FENCED = r"^ {0,3}(?:`{3}|~{3})"
_HEADING = r"(?d)^ {0,3}(#{1,6})(?:[ \t]+(.*))?$"


def _strip(text: Column, what: str = r"\s") -> Column:
    return F.regexp_replace(text, rf"(?U)\A{what}+|{what}+\z", "")


def _blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def _is_heading(token: Column) -> Column:
    return token.rlike(_HEADING) & ~token.rlike(_FENCED)


def _paths(headings: Column) -> Column:
    """For each heading line the titles it stands under, its own included; levels replace those at or below them."""
    marks = F.transform(headings, lambda h: F.struct(F.length(F.regexp_extract(h, _HEADING, 1)).alias("level"), _strip(F.regexp_replace(F.regexp_extract(h, _HEADING, 2), "#+$", "")).alias("title")))
    opened = lambda s, x: F.array_append(F.filter(s, lambda o: o["level"] < x["level"]), x)
    named = lambda s, x: F.filter(F.transform(opened(s, x), lambda o: o["title"]), lambda t: t != "")
    return scan(marks, F.array().cast("array<struct<level:int,title:string>>"), opened, named, lambda s, x: F.lit(True), "array<string>")


def _cut(tokens: Column) -> Column:
    """(path, tokens) of each part between headings that has content besides its heading."""
    # an empty heading in front opens the part before the first one
    whole = F.concat(F.array(F.lit("")), tokens)
    starts = places(whole, lambda t, i: (i == 0) | _is_heading(t))
    paths = lambda parts: F.concat(F.array(F.array().cast("array<string>")), _paths(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p[0])))
    zipped = let(runs(whole, starts, lambda p: p), lambda parts: F.arrays_zip(paths(parts).alias("path"), parts.alias("part")))
    return F.filter(zipped, lambda s: F.exists(F.slice(s["part"], F.lit(2), F.size(s["part"])), lambda t: ~_blank(t)))


def sections(body: Column) -> Column:
    """Array of (path, part): the heading path, and the heading line (or an empty one) with the tokens under it."""
    return let(F.regexp_extract_all(F.regexp_replace(body, r"\r\n?", "\n"), F.lit(_TOKEN), F.lit(0)), _cut)


def section_text(part: Column) -> Column:
    """The text of a section: its heading line and what stands below, without empty lines around that."""
    text = _strip(F.array_join(F.slice(part, F.lit(2), F.size(part)), "\n"), r"\n")
    return F.concat(F.when(part[0] != "", F.concat(_strip(part[0]), F.lit("\n"))).otherwise(""), text)


def _fill(parts: Column, width: int, glue: str, exempt: bool = False) -> Column:
    """Parts joined greedily up to ``width``; with ``exempt``, headings are never left standing alone."""
    only = (lambda p: _blank(p) | p.rlike(_HEADING)) if exempt else (lambda p: F.lit(False))
    marks = F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.length(p).alias("n"), only(p).alias("only")))
    grown = lambda s, x: s["size"] + len(glue) + x["n"]
    fresh = lambda s, x: (s["size"] < 0) | ((grown(s, x) > width) & ~s["only"])
    state = lambda s, x: F.when(fresh(s, x), F.struct(x["n"].alias("size"), x["only"].alias("only"))).otherwise(F.struct(grown(s, x).alias("size"), (s["only"] & x["only"]).alias("only")))
    starts = scan(marks, F.struct(F.lit(-1).alias("size"), F.lit(False).alias("only")), state, lambda s, x: x["i"], fresh, "int")
    return runs(parts, starts, lambda r: F.array_join(r, glue))


def _wrapped(line: Column, width: int) -> Column:
    """Pieces of a line of at most ``width`` characters, cut at blanks where there is one."""
    pieces = F.regexp_extract_all(line, F.lit(rf"(?s)[^ ].{{0,{width - 1}}}(?= |\z)|[^ ].{{0,{width - 1}}}"), F.lit(0))
    return F.when(F.length(line) <= width, F.array(line)).otherwise(F.transform(pieces, F.rtrim))


def _split(block: Column, width: int) -> Column:
    """A block, or what lines and words of a long one fill."""
    lines = F.flatten(F.transform(F.split(block, "\n"), lambda line: _wrapped(line, width)))
    return F.when(F.length(block) <= width, F.array(block)).otherwise(let(lines, lambda p: _fill(p, width, "\n", exempt=True)))


def _pieces(part: Column, width: int, overlap: int) -> Column:
    """A section's chunks, each but the first opening with the end of the one before."""
    # the first line below the heading follows it at once
    below = let(F.slice(part, F.lit(2), F.size(part)), lambda ts: F.slice(ts, F.get(places(ts, lambda t, _: t != ""), F.lit(0)) + 1, F.size(ts)))
    tokens = F.concat(F.when(part[0] != "", F.array(_strip(part[0]))).otherwise(F.array().cast("array<string>")), below)

    def filled(ts: Column) -> Column:
        starts = places(ts, lambda t, i: ~_blank(t) & ((i == 0) | _blank(F.get(ts, i - 1))))
        blocks = runs(ts, starts, lambda r: _strip(F.array_join(F.filter(r, lambda t: ~_blank(t)), "\n"), r"\n"))
        return let(F.flatten(F.transform(blocks, lambda b: _split(b, width))), lambda atoms: _fill(atoms, width, "\n\n"))

    def tail(before: Column) -> Column:
        end = F.right(before, F.lit(overlap))
        # not from the middle of a word
        return _strip(F.when(F.length(before) > overlap, F.regexp_replace(end, r"(?U)\A\S*\s+", "")).otherwise(end))

    def lapped(whole: Column) -> Column:
        opening = lambda i: let(tail(F.get(whole, i - 1)), lambda t: F.when(t != "", F.concat(t, F.lit("\n\n"))).otherwise(""))
        return F.transform(whole, lambda p, i: F.when(i == 0, p).otherwise(F.concat(opening(i), p)))

    return let(let(tokens, filled), lapped if overlap else lambda whole: whole)


def chunks(body: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of (heading_path, raw_text): a body's chunks; small neighbouring sections share one."""
    made = F.transform(sections(body), lambda s: F.struct(s["path"].alias("path"), _pieces(s["part"], max_chars, overlap).alias("pieces")))

    def merged(rows: Column) -> Column:
        # sizes of what may share a chunk; others do not
        marks = F.transform(rows, lambda s, i: F.struct(i.alias("i"), F.when(F.size(s["pieces"]) == 1, F.length(s["pieces"][0])).alias("n")))
        joins = lambda room, x: F.coalesce(room >= x["n"] + 2, F.lit(False))
        room = lambda room, x: F.when(joins(room, x), room - x["n"] - 2).otherwise(F.coalesce(max_chars - x["n"], F.lit(-1)))
        starts = scan(marks, F.lit(-1), room, lambda _, x: x["i"], lambda r, x: ~joins(r, x), "int")
        chunk = lambda path, text: F.struct(path.alias("heading_path"), text.alias("raw_text"))

        def group(r: Column) -> Column:
            path = F.aggregate(F.slice(r, F.lit(2), F.size(r)), r[0]["path"], lambda a, s: shared_prefix(a, s["path"]))
            together = chunk(path, F.array_join(F.transform(r, lambda s: s["pieces"][0]), "\n\n"))
            return F.when(F.size(r) > 1, F.array(together)).otherwise(F.transform(r[0]["pieces"], lambda p: chunk(r[0]["path"], p)))

        return F.flatten(runs(rows, starts, group))

    stripped = F.transform(let(made, merged), lambda c: F.struct(c["heading_path"].alias("heading_path"), _strip(c["raw_text"], r"\n").alias("raw_text")))
    return F.filter(stripped, lambda c: ~_blank(c["raw_text"]))


def chunk_notes(notes: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, contextual: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """note_id, chunk_id, ordinal, heading_path, raw_text, embed_text for notes (note_id, body, scope, title, tags).

    Null and blank bodies have no chunks.  Notes are chunked where they lie; the
    other columns stay in the row, so nothing is shuffled.  ``keep`` names columns of the
    notes that come last.
    """
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and overlap between 0 and max_chars")
    cols = list(dict.fromkeys(["note_id", "scope", "title", "tags", *keep]))
    rows = notes.select(*cols, F.posexplode(chunks(F.col("body"), max_chars, overlap)).alias("ordinal", "part")).select(*cols, "ordinal", "part.heading_path", "part.raw_text")
    prefix = context_prefix(F.col("scope"), F.col("title"), F.col("tags"), F.col("heading_path")) if contextual else F.lit("")
    return rows.select("note_id", F.concat_ws("#", "note_id", "ordinal").alias("chunk_id"), "ordinal", "heading_path", "raw_text", embed_text(prefix, F.col("raw_text")).alias("embed_text"), *keep)
