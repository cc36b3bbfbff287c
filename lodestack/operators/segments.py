"""A stored index that changes: segments of chunks with their postings, and the notes that each replaces.

A write adds one segment: the new chunks, their postings dealt by a hash of the term, and
the chunks of earlier segments, those of the notes that it replaces, that no longer count.  Nothing that was
written before is touched.  A segment counts when a new version names it, so chunks,
vectors (columns of the chunks), postings and the state of files change together or not
at all; readers keep the version that they opened.  One writer at a time.

The number of chunks and of tokens is summed up from the segments; how many chunks hold a
term is counted from the postings that a query reads anyway, dead ones left out.  So
scores are those of an index made anew.  ``merge`` makes one segment of all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..workspace import children, remove
from .lexical import idf, posted, query_terms, term_score

#: Most folders that a segment's postings are dealt to, and chunks that fill one of them.
BUCKETS, BUCKET_CHUNKS = 256, 4096
_ENTRY = "segment long, buckets int, chunks long, tokens long, gone boolean, gone_chunks long, gone_tokens long, state boolean, settings string"


@dataclass(frozen=True)
class Segment:
    """What a version says of a segment: its size, and what of earlier ones it makes void."""

    segment: int
    buckets: int
    chunks: int
    tokens: int
    gone: bool
    gone_chunks: int
    gone_tokens: int
    state: bool
    settings: str


@dataclass(frozen=True)
class Stored:
    """A version of the index below ``path``."""

    path: str
    version: int = 0
    segments: tuple[Segment, ...] = ()

    @property
    def chunks(self) -> int:
        return sum(s.chunks - s.gone_chunks for s in self.segments)

    @property
    def tokens(self) -> int:
        return sum(s.tokens - s.gone_tokens for s in self.segments)

    @property
    def settings(self) -> str | None:
        return self.segments[-1].settings if self.segments else None

    def at(self, segment: Segment, kind: str) -> str:
        return f"{self.path}/segment={segment.segment}/{kind}"


def open_index(spark: SparkSession, path: str) -> Stored:
    """The newest whole version; without one, an empty index."""
    numbers = [int(n[2:]) for n in children(spark, f"{path}/versions") if n.startswith("v=")]
    for version in sorted(numbers, reverse=True):
        if "_SUCCESS" in children(spark, f"{path}/versions/v={version}"):
            rows = spark.read.schema(_ENTRY).parquet(f"{path}/versions/v={version}").collect()
            return Stored(path, version, tuple(Segment(**r.asDict()) for r in sorted(rows, key=lambda r: r["segment"])))
    return Stored(path)


def _commit(spark: SparkSession, path: str, version: int, segments: list[Segment]) -> Stored:
    rows = [tuple(vars(s).values()) for s in segments]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version}")
    return Stored(path, version, tuple(segments))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _dead(spark: SparkSession, stored: Stored) -> DataFrame | None:
    """(chunk_id, until): a chunk in segments before ``until`` is void."""
    parts = [spark.read.schema("chunk_id string").parquet(stored.at(s, "gone")).select("chunk_id", F.lit(s.segment).alias("until")) for s in stored.segments if s.gone]
    return _union(parts).groupBy("chunk_id").agg(F.max("until").alias("until")) if parts else None


def _living(spark: SparkSession, stored: Stored, rows: DataFrame) -> DataFrame:
    """``rows`` (chunk_id, segment, ...) that no later segment has made void."""
    dead = _dead(spark, stored)
    if dead is None:
        return rows
    d = dead.withColumnRenamed("chunk_id", "_gone")
    return rows.join(d, (rows["chunk_id"] == d["_gone"]) & (rows["segment"] < d["until"]), "left_anti")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def chunks(spark: SparkSession, stored: Stored) -> DataFrame:
    """All chunks that count, with their columns and ``length``, their tokens."""
    parts = [spark.read.parquet(stored.at(s, "chunks")).withColumn("segment", F.lit(s.segment)) for s in stored.segments if s.chunks]
    if not parts:
        return spark.createDataFrame([], "chunk_id string, note_id string, text string, length int")
    return _living(spark, stored, _union(parts)).drop("segment")


def postings(spark: SparkSession, stored: Stored, terms: list[str] | None = None) -> DataFrame:
    """chunk_id, length, term, tf of the chunks that count; of some ``terms``, only their folders are read."""
    parts = []
    for s in stored.segments:
        if s.chunks:
            rows = spark.read.schema("chunk_id string, length int, term string, tf int, bucket int").parquet(stored.at(s, "postings"))
            if terms is not None:
                rows = rows.where(F.col("bucket").isin(*[_bucket(F.lit(t), s.buckets) for t in terms]) & F.col("term").isin(*terms)) if terms else rows.where(F.lit(False))
            parts.append(rows.drop("bucket").withColumn("segment", F.lit(s.segment)))
    if not parts:
        return spark.createDataFrame([], "chunk_id string, length int, term string, tf int")
    return _living(spark, stored, _union(parts)).drop("segment")


def state(spark: SparkSession, stored: Stored) -> DataFrame | None:
    """The newest row of each path that a segment's state names, those that are gone left out."""
    parts = [spark.read.parquet(stored.at(s, "state")).withColumn("segment", F.lit(s.segment)) for s in stored.segments if s.state]
    if not parts:
        return None
    rows = _union(parts)
    own = [c for c in rows.columns if c not in ("path", "segment")]
    newest = rows.groupBy("path").agg(F.max_by(F.struct(*own), "segment").alias("r")).select("path", "r.*")
    return newest.where("not gone").drop("gone")


def _posted(rows: DataFrame, buckets: int) -> DataFrame:
    return posted(rows, ["chunk_id"]).withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")


def write(spark: SparkSession, path: str, rows: DataFrame, gone: DataFrame | None = None, of_state: Callable[[DataFrame], DataFrame] | None = None, settings: str = "", fresh: bool = False) -> Stored:
    """Add a segment of chunks ``rows`` (chunk_id, note_id, text, ...) and make it count.

    ``gone`` (note_id) are the notes whose earlier chunks become void; ``of_state`` gets the
    written chunks and returns state rows (path, gone, ...).  ``fresh`` starts the index
    anew with this segment alone.  chunk_ids are unique; null texts have no tokens.
    """
    old = open_index(spark, path)
    number = old.version + 1
    kept = [] if fresh else list(old.segments)
    at = f"{path}/segment={number}"
    rows.withColumn("length", F.size(tokens(F.col("text")))).write.mode("overwrite").parquet(f"{at}/chunks")
    made = spark.read.parquet(f"{at}/chunks")
    n, total = made.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    buckets = 1
    while buckets < BUCKETS and buckets * BUCKET_CHUNKS < n:
        buckets *= 2
    if n:
        _posted(made, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/postings")
    lost = (0, 0)
    if gone is not None and kept:
        void = chunks(spark, Stored(path, old.version, tuple(kept))).join(gone.select("note_id").distinct(), "note_id", "left_semi")
        void.select("chunk_id", "length").write.mode("overwrite").parquet(f"{at}/gone")
        lost = spark.read.schema("chunk_id string, length int").parquet(f"{at}/gone").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if of_state is not None:
        of_state(made).write.mode("overwrite").parquet(f"{at}/state")
    segment = Segment(number, buckets, n, total, gone is not None and bool(kept), lost[0], lost[1], of_state is not None, settings)
    return _commit(spark, path, number, [*kept, segment])


def upsert(spark: SparkSession, path: str, rows: DataFrame, settings: str = "") -> Stored:
    """Replace all chunks of the notes in ``rows``."""
    return write(spark, path, rows, rows.select("note_id"), settings=settings)


def delete(spark: SparkSession, path: str, notes: DataFrame) -> Stored:
    """Drop all chunks of ``notes`` (note_id)."""
    stored = open_index(spark, path)
    none = chunks(spark, stored).drop("length").where(F.lit(False))
    return write(spark, path, none, notes, settings=stored.settings or "")


def merge(spark: SparkSession, path: str) -> Stored:
    """One segment of all that counts; the others can then ``expire``."""
    stored = open_index(spark, path)
    if len(stored.segments) < 2:
        return stored
    now = state(spark, stored)
    of_state = None if now is None else lambda _: now.withColumn("gone", F.lit(False))
    return write(spark, path, chunks(spark, stored).drop("length"), None, of_state, stored.settings or "", fresh=True)


def expire(spark: SparkSession, path: str) -> list[str]:
    """Remove what the newest version does not name; the folders that went.  Nobody may be reading older ones."""
    stored = open_index(spark, path)
    named = {f"segment={s.segment}" for s in stored.segments}
    old = [f"{path}/{n}" for n in children(spark, path) if n.startswith("segment=") and n not in named]
    old += [f"{path}/versions/{n}" for n in children(spark, f"{path}/versions") if n != f"v={stored.version}"]
    for folder in old:
        remove(spark, folder)
    return old


def bm25(spark: SparkSession, stored: Stored, query: str, keep: DataFrame | None = None) -> DataFrame:
    """chunk_id and score of the chunks that hold a query term, as ``lexical.bm25`` gives them.

    ``keep`` is (chunk_id) of the chunks that may be found; statistics cover all.
    """
    terms = query_terms(query)
    hits = postings(spark, stored, terms)
    counts = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
    found = hits.groupBy("chunk_id", "length").agg(*counts, F.lit(0))
    if not terms or not stored.chunks:
        return found.select("chunk_id", F.lit(0.0).alias("score")).where(F.lit(False))
    df = hits.agg(*[F.count_if(F.col("term") == t).alias(f"_df{i}") for i, t in enumerate(terms)])
    if keep is not None:
        found = found.join(keep.select("chunk_id"), "chunk_id", "left_semi")
    n, average = F.lit(float(stored.chunks)), F.lit(stored.tokens / stored.chunks)
    parts = [F.when(F.col(f"_tf{i}") > 0, term_score(idf(n, F.col(f"_df{i}")), F.col(f"_tf{i}"), F.col("length"), average)).otherwise(0.0) for i in range(len(terms))]
    return found.join(F.broadcast(df)).select("chunk_id", sum(parts[1:], parts[0]).alias("score"))
