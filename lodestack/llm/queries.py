"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, licenses, merkle, mixing, ngram_join, packing, pii, quality, sharding, sql, variants, warc, wordpiece


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: 5-word sets, similarity 0.8."""
    return ngram_join.ngram_classes(_table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that any stretch of a document states."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    placed = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return placed.drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its edit distance."""
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op6_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether rules and perplexity keep it."""
    return quality.assess(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels")).drop("row_key")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    turns = rows.union(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content"))
    return chat.digest(chat.format_chats(turns))


#: Vocabulary of op8; another file is a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op8_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every document."""
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), wordpiece.load_pieces(PIECES))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.page_digests(warc.read_archive(spark, warc.archive(_table(spark, sf_dir, "pages"))))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, all spans."""
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


#: Vocabulary of op11.
WORDS = "/opt/tokenizers/word_bpe_49k.json"


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packing.piece_digests(packing.pack(_table(spark, sf_dir, "documents"), WORDS, 2048))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document, and the root that it leads to, a third of them tampered with."""
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", merkle.group_key(F.col("lang")).alias("group"), merkle.leaf_hash(*fields, F.col("text")).alias("leaf"), F.when(tampered, merkle.leaf_hash(*fields, variants.lower_ascii(F.col("text")))).alias("changed"))
    proved = merkle.prove(merkle.manifest(leaves, "group", ["doc_id"]), "changed")
    return proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, their form and its root."""
    return variants.group_spellings(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard, op2_license_scan, op3_source_mixing, op4_sharding, op5_decontaminate, op6_kneser_ney_rules, op7_chat_format, op8_wordpiece_counts, op9_warc, op10_pii, op11_harmonic_packing, op12_merkle_manifest, op13_spelling_variants)
    return {f.__name__: f for f in found}


_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(s>|/s>|/?INST\]|/?ROLE\]|MSG\]|(?:IMAGE|AUDIO|DOCUMENT) [0-9]+\])', '\1\\\2', 'g') AS text_out,
         regexp_replace(replace(role, '\', '\\'), '([<\[])(s>|/s>|/?INST\]|/?ROLE\]|MSG\]|(?:IMAGE|AUDIO|DOCUMENT) [0-9]+\])', '\1\\\2', 'g') AS role_out
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(13 + length(role_out) + length(text_out) + CASE WHEN role = 'user' THEN 13 ELSE 9 END))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_KNOWN = [(t, name, licenses.template_bigrams(text)) for t, (name, text) in enumerate(licenses.TEMPLATES)]
_PLACES = ", ".join(f"({t}, '{name}', {k}, '{x}', {len(b)})" for t, name, b in _KNOWN for k, x in enumerate(b))
_LICENSES = rf"""
WITH places(t, name, k, bigram, length) AS (VALUES {_PLACES}),
bags AS (SELECT t, bigram, count(*) AS times FROM places GROUP BY ALL),
texts AS (SELECT doc_id, row_number() OVER () AS r, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
pairs AS (SELECT r, len(w) - 1 AS n, unnest(range(len(w) - 1)) AS place, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM texts),
hits AS (SELECT r, n, place, bigram FROM pairs WHERE bigram IN (SELECT bigram FROM places)),
stretches AS (SELECT DISTINCT r, n, t, name, length, place - k AS first FROM hits JOIN places USING (bigram)),
here AS (SELECT s.r, s.n, s.t, s.name, s.length, s.first, h.bigram, count(*) AS c FROM stretches s JOIN hits h ON h.r = s.r AND h.place >= s.first AND h.place < s.first + s.length JOIN bags USING (t, bigram) GROUP BY ALL),
sums AS (SELECT r, n, t, name, length, first, sum(least(c, times)) AS shared FROM here JOIN bags USING (t, bigram) GROUP BY ALL),
found AS (SELECT r, t, name, max(2.0 * shared / (least(n, first + length) - greatest(first, 0) + length)) AS dice FROM sums GROUP BY ALL HAVING dice >= 0.8 - 1e-9),
best AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_matches, arg_min(name, (-dice, name)) AS best_license, round(max(dice), 6) AS best_dice FROM found GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches, best_license, best_dice FROM texts LEFT JOIN best USING (r)
"""

#: All pairs that share an n-gram; the least chance that the join loses a link is that of its bands.
_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
c AS (SELECT u AS doc_id, min(v) AS class_id FROM reach GROUP BY 1), k AS (SELECT u AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard": _JACCARD, "op2_license_scan": _LICENSES, "op7_chat_format": _CHAT, "op9_warc": _WARC, "op12_merkle_manifest": sql.merkle(), "op13_spelling_variants": sql.VARIANTS}
