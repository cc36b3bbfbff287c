"""Text expressions: folding, tokens, excerpts, prefixes, slugs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

TOKEN = r"([\p{L}\p{N}\u0300-\u036F]+)"


def _fold_tables() -> tuple[str, str]:
    """Accented letters and what they fold to; combining marks, which fold to nothing, come last."""
    accented, plain = [], []
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]) and chr(cp) == chr(cp).lower():
            accented.append(chr(cp))
            plain.append(parts[0])
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(accented) + marks, "".join(plain)


_ACCENTED, _PLAIN = _fold_tables()


def fold(text: Column) -> Column:
    """Lower case without diacritics; ß and its like stay."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def fold_py(text: str) -> str:
    """``fold`` for a driver-side query string."""
    return text.lower().translate(str.maketrans(_ACCENTED[: len(_PLAIN)], _PLAIN, _ACCENTED[len(_PLAIN) :]))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; null text has none.

    Only tokens that are not ASCII are folded, which is the slow part; combining
    marks hold a token together and then go.
    """
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    plain = F.transform(raw, lambda t: F.when(F.octet_length(t) > F.length(t), F.translate(t, _ACCENTED, _PLAIN)).otherwise(t))
    return F.filter(plain, lambda t: t != "")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, query_terms: list[str], width: int = 240) -> Column:
    """About ``width`` characters around the first query term, with ellipses where text is left out.

    Without a hit the opening stands in; blank text gives the empty string.
    """
    flat = collapse(F.coalesce(text, F.lit("")))
    found = [F.nullif(F.instr(F.lower(flat), t.lower()), F.lit(0)) for t in query_terms if t]
    at = (F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None)).cast("int") - 1
    start = F.greatest(at - width // 3, F.lit(0))
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, F.lit(width)), F.when(start + width < F.length(flat), "…").otherwise(""))
    head = F.concat(F.substring(flat, 1, width), F.when(F.length(flat) > width, "…").otherwise(""))
    return F.when(at.isNull(), head).otherwise(window)


def plain_excerpt(body: Column, width: int = 220) -> Column:
    """The opening of a note without front matter, fences, headings, callouts, embeds and link marks."""
    text = F.regexp_replace(body, r"(?s)^---\n.*?\n---\n?", "")
    for pattern, to in ((r"(?s)```.*?```", " "), (r"(?m)^#{1,6}\s.*$", " "), (r"(?m)^>\s*\[![^\]]*\].*$", " "), (r"!\[\[[^\]]*\]\]", " "), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"[*_`>#]", "")):
        text = F.regexp_replace(text, pattern, to)
    flat = collapse(text)
    return F.when(F.length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width - 1)), F.lit("…"))).otherwise(flat)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def context_prefix(scope: Column, title: Column, tags: Column, heading_path: Column) -> Column:
    """``scope: … | title: … | tags: … | section: …`` without the blank fields; empty if all are."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    listed = lambda a, sep: F.when(F.size(a) > 0, F.array_join(a, sep))
    return F.concat_ws(" | ", field("scope", blank_to_null(scope)), field("title", blank_to_null(title)), field("tags", listed(tags, ", ")), field("section", listed(heading_path, " > ")))


def embed_text(prefix: Column, raw: Column) -> Column:
    """What is embedded: prefix and text, or the text alone."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), raw)).otherwise(raw)


def slug(text: Column, fallback: str = "nota") -> Column:
    """ASCII lower-case words joined by dashes."""
    ascii_only = F.regexp_replace(fold(text), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit(fallback))


def tags_of(raw: Column) -> Column:
    """A comma-separated tag string as an array without leading hash signs and blanks."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.regexp_replace(F.trim(t), "^#+", ""))
    return F.filter(parts, lambda t: t != "")


def strip_wikilink(text: Column) -> Column:
    """``[[id#heading|alias]]`` -> ``id``."""
    return F.trim(F.regexp_extract(F.trim(text), r"^(?:!?\[\[)?([^\]|#]*)", 1))
