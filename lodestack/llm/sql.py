"""DuckDB SQL of the manifest and of the spelling variants."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 by the table of the reflected polynomial; ``crc_table`` must be in scope.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc)"


def _crc32(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substring(hex({text}), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c >> 8, crc[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)"


def merkle(levels: int = 9) -> str:
    """The manifest level by level, enough of them for 8 ** ``levels`` rows of a language."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        _CRC_TABLE,
        f"d AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, * FROM (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS changed FROM documents, crc_table))",
        # g: the tree's name, i: the node's place, h: its digest; p: its path so far
        "l0 AS (SELECT lang AS g, place AS i, leaf AS h FROM d)",
        "w0 AS (SELECT lang AS g, place AS i, place AS at, changed AS h, '' AS proof FROM d)",
    ]

    def climb(nodes: str, ways: str, prefix: str) -> tuple[str, str]:
        for k in range(levels):
            up, way, alone = f"{prefix}{k + 1}", f"{prefix}w{k + 1}", "count(*) OVER (PARTITION BY g) = 1"
            parts.append(f"{up}c AS (SELECT *, {alone} AS alone FROM {nodes})")
            parts.append(f"{up} AS (SELECT g, i // 8 AS i, CASE WHEN bool_or(alone) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {up}c GROUP BY g, i // 8)")
            parts.append(f"{way} AS (SELECT w.g, w.i, w.at // 8 AS at, CASE WHEN bool_or(n.alone) THEN any_value(w.h) ELSE sha256(string_agg(CASE WHEN n.i = w.at THEN w.h ELSE n.h END, '' ORDER BY n.i)) END AS h, any_value(w.proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> w.at), '') AS proof FROM {ways} w JOIN {up}c n ON n.g IS NOT DISTINCT FROM w.g AND n.i // 8 = w.at // 8 GROUP BY w.g, w.i, w.at)")
            nodes, ways = up, way
        return nodes, ways

    subs, sub_ways = climb("l0", "w0", "l")
    parts.append(f"subroots AS (SELECT g AS lang, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS place, h AS subroot FROM {subs})")
    parts.append("r0 AS (SELECT 0 AS g, place AS i, subroot AS h FROM subroots)")
    parts.append(f"rw0 AS (SELECT 0 AS g, {{'lang': w.g, 'i': w.i}} AS i, place AS at, w.h, w.proof FROM {sub_ways} w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.g)")
    tops, top_ways = climb("r0", "rw0", "r")
    parts.append(f"ends AS (SELECT w.i.lang AS lang, w.i.i AS place, w.h AS folded_root, sha256(w.proof) AS proof_sha256, t.h AS root FROM {top_ways} w, {tops} t)")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM d JOIN ends e ON e.lang IS NOT DISTINCT FROM d.lang AND e.place = d.place JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang"


#: Near words by the words and places that one deletion leaves.
VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32("(doc_id || ':' || run)")} AS h FROM lowered, crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min({{'other': other, 'm': m}}, {{'k': -m, 'other': encode(other)}}) AS b FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, n, form, form_n, n_near, c.at AS root FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
