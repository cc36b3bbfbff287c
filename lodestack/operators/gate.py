"""Write gate and lint: declarative rules over candidate and stored notes.

A rule is a condition; a note's findings are the rules that hold, as one array
column, so a whole batch is judged in one projection.  Registries are small
settings and come as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CONFIDENCE, Maintenance, Manifest
from ..functions.arrays import let
from .chunk import FENCE
from .embed import hash_counted
from .vector import similar_pairs
from ..workspace import cut, shuffles_dropped

KNOWLEDGE = ("semantic", "procedural")
ATOMIC_CHARS, ATOMIC_SECTIONS = 4000, 2
FINDING = "array<struct<check:string,severity:string>>"


def _text(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit(""))


def _known(column: Column, values: tuple[str, ...] | list[str]) -> Column:
    return column.isin(*values) if values else F.lit(False)


def scope_fits(manifest: Manifest) -> Column:
    """The scope is registered, or looks like a slug where no scopes are."""
    scope = _text("scope")
    return _known(scope, [*manifest.scopes.known, manifest.scopes.default]) if manifest.scopes.known else scope.rlike(r"^[a-z0-9][a-z0-9_-]*$")


def profile_fits(manifest: Manifest) -> Column:
    pairs = [f"{a.name}/{p}" for a in manifest.agents for p in a.profiles]
    return _known(F.concat_ws("/", _text("agent"), _text("profile")), pairs)


def has_content(items: str) -> Column:
    """An array with something that is not blank."""
    return F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def top_sections(body: Column) -> Column:
    """How many headings of the highest level there are outside of fenced code."""
    marks = lambda b: F.regexp_extract_all(F.regexp_replace(b, rf"(?msd){FENCE}", ""), F.lit(r"(?md)^(#{1,6})[ \t]+\S"), F.lit(1))
    return let(marks(body), lambda m: let(F.array_min(F.transform(m, F.length)), lambda least: F.size(F.filter(m, lambda x: F.length(x) == least))))


def _findings(rules: list[tuple[str, str, Column]]) -> Column:
    found = [F.when(when, F.struct(F.lit(name).alias("check"), F.lit(level).alias("severity"))) for name, level, when in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull()).cast(FINDING)


def _shared_rules(manifest: Manifest, level: str = "reject") -> list[tuple[str, str, Column]]:
    scope, agent = _text("scope"), _text("agent")
    agents = [a.name for a in manifest.agents]
    fine_agent = _known(agent, agents)
    denied = lambda col, names: F.arrays_overlap(F.coalesce(col, F.array().cast("array<string>")), F.array(*map(F.lit, names)).cast("array<string>")) if names else F.lit(False)
    return [
        ("scope_missing", level, scope == ""),
        ("scope_unknown", level, (scope != "") & ~scope_fits(manifest)),
        ("agent_missing", level, agent == ""),
        ("agent_unknown", level, (agent != "") & ~fine_agent),
        ("profile_unknown", level, fine_agent & (_text("profile") != "") & ~profile_fits(manifest)),
        ("denylist_keys", level, denied("keys", manifest.frontmatter.denylist_keys)),
        ("denylist_tags", level, denied(F.transform("tags", lambda t: F.regexp_replace(F.trim(t), "^#+", "")), manifest.frontmatter.denylist_tags)),
    ]


def near_copies(notes: DataFrame, threshold: float = Maintenance().dedup_similarity, every: bool = True) -> DataFrame:
    """(note_id, similar) of knowledge notes with an earlier near copy in the same type and scope.

    ``notes`` has note_id, seq (unique; stored notes have lower ones than candidates),
    type, scope and body.  Near means a cosine above the threshold.  ``similar`` names
    the first note of each distinct body, so that many copies do not become many pairs;
    without ``every`` it names one of them, which the rule of the gate is content with.

    Bodies are read once, where they lie: what goes on is their hash and feature counts.
    """
    known = notes.where(F.col("type").isin(*KNOWLEDGE) & (_text("scope") != ""))
    known = known.select("note_id", F.col("seq").cast("long").alias("seq"), "type", _text("scope").alias("scope"), F.coalesce("body", F.lit("")).alias("body"))
    with shuffles_dropped(notes.sparkSession):
        known = cut(hash_counted(known.withColumn("hash", F.unhex(F.sha2("body", 256))), "body"))
        # written out, so that a join with a hot body's copies shuffles both sides plainly
        first = cut(known.groupBy("type", "scope", "hash").agg(F.min("seq").alias("first")))
        placed = cut(known.drop("embedding").join(first, ["type", "scope", "hash"]).select("note_id", "seq", "first"))
        names = placed.where("seq = first").select(F.col("seq").alias("id"), F.col("note_id").alias("name"))
        heads = known.join(first.select(F.col("first").alias("seq")), "seq", "left_semi")
        vectors = heads.select(F.col("seq").alias("id"), F.concat_ws("/", "type", "scope").alias("kind"), "scope", "embedding")
        pairs = similar_pairs(cut(vectors), threshold, least=not every).select("a", "b")
        if every:
            both = pairs.union(pairs.select("b", "a")).toDF("first", "other")
        else:  # a copy of an earlier body needs no other; what is left are first notes and those before them
            both = pairs.groupBy("b").agg(F.min("a").alias("other")).select(F.col("b").alias("first"), "other")
        near = (placed if every else placed.where("seq = first")).join(both, "first").where("other < seq").select("note_id", F.col("other").alias("id"))
        near = near.union(placed.where("seq > first").select("note_id", F.col("first").alias("id")))
        return cut(near.join(names, "id").groupBy("note_id").agg(F.array_sort(F.collect_set("name")).alias("similar")))


def too_broad(body: Column) -> Column:
    """Longer or of more sections than one matter takes."""
    return (F.length(body) > ATOMIC_CHARS) | (top_sections(body) > ATOMIC_SECTIONS)


def evaluate(candidates: DataFrame, manifest: Manifest, near: DataFrame | None = None) -> DataFrame:
    """``candidates`` with findings and accepted.

    Candidates have note_id, type, scope, agent, profile, confidence, source, body,
    tags, keys, supersedes, evidence (arrays) and merge.  ``near`` is (note_id,
    similar): known notes above the duplicate threshold in the same type and scope.
    Where ``broad`` (``too_broad``) is there, no body is needed.
    """
    knowledge = F.coalesce(F.col("type").isin(*KNOWLEDGE), F.lit(False))
    # before the join, which then ships no body that nobody wants afterwards
    given = "broad" in candidates.columns
    if not given:
        candidates = candidates.withColumn("broad", knowledge & too_broad(F.coalesce("body", F.lit(""))))
    if near is None:
        candidates = candidates.withColumn("similar", F.array().cast("array<string>"))
    else:
        candidates = candidates.join(near, "note_id", "left")
    evidence = has_content("evidence")
    decided = has_content("supersedes") | F.coalesce("merge", F.lit(False))
    confidence = _text("confidence")
    rules = [
        ("type_disabled", "reject", (F.col("type") == "research") & F.lit(not manifest.research_enabled)),
        *_shared_rules(manifest),
        ("confidence_invalid", "reject", (confidence != "") & ~confidence.isin(*CONFIDENCE)),
        ("source_missing", "reject", knowledge & (_text("source") == "")),
        ("evidence_missing", "reject", (F.col("type") == "procedural") & ~evidence),
        ("duplicate", "reject", knowledge & (F.size(F.coalesce("similar", F.array().cast("array<string>"))) > 0) & ~decided & (_text("scope") != "") & scope_fits(manifest)),
        ("reusable", "warn", knowledge),
        ("atomic", "warn", knowledge & F.col("broad")),
        ("confidence_unverified", "reject" if manifest.reject_unverified else "warn", knowledge & (F.lower(confidence) == "high") & ~evidence),
    ]
    judged = candidates.withColumn("findings", _findings(rules))
    judged = judged if given else judged.drop("broad")
    return judged.withColumn("accepted", ~F.exists("findings", lambda f: f["severity"] == "reject"))


def lint(notes: DataFrame, manifest: Manifest, linked: DataFrame | None = None) -> DataFrame:
    """note_id, path and findings for stored notes that break a rule.

    ``notes`` also has path and malformed.  A malformed note gets no other finding.
    Episodic notes belong in a folder of their agent's name.  ``linked`` are the
    note_ids with any edge; without it orphans are not looked for.
    """
    folder = F.element_at(F.split(F.regexp_replace("path", r"/[^/]*$", ""), "/"), -1)
    episodic = F.coalesce(F.col("type") == "episodic", F.lit(False))
    if linked is not None:
        notes = notes.join(linked.select("note_id").distinct().withColumn("_linked", F.lit(True)), "note_id", "left")
    rules = [
        *_shared_rules(manifest, "error"),
        ("episodic_unpartitioned", "error", episodic & (F.lower(folder) == "episodic")),
        ("episodic_agent_mismatch", "error", episodic & (F.lower(folder) != "episodic") & (_text("agent") != "") & (folder != _text("agent"))),
    ]
    if linked is not None:
        rules.append(("orphan_note", "warn", F.col("_linked").isNull() & F.col("type").isin(*KNOWLEDGE)))
    broken = _findings([("frontmatter_malformed", "error", F.lit(True))])
    found = F.when(F.coalesce("malformed", F.lit(False)), broken).otherwise(_findings(rules))
    return notes.select("note_id", "path", found.alias("findings")).where(F.size("findings") > 0)


def long_form(judged: DataFrame) -> DataFrame:
    """note_id, check, severity: one row for each finding."""
    return judged.select("note_id", F.explode("findings").alias("f")).select("note_id", "f.check", "f.severity")


def totals(judged: DataFrame) -> DataFrame:
    """check, severity and how many notes have the finding."""
    return long_form(judged).groupBy("check", "severity").agg(F.count("*").alias("notes"))
