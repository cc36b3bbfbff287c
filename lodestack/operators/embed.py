"""Embeddings: signed feature hashing, and any provider that maps texts to vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

DIM = 256
_WORD = re.compile(r"\w+")
#: Texts that are embedded together; each distinct feature among them is hashed once.
HASHED_TOGETHER = 1024


def _signed_places(features: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of each feature, from BLAKE2b-64."""
    digests = b"".join(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=8).digest() for f in features)
    h = np.frombuffer(digests, ">u8").astype(np.uint64)
    return (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def hash_counts(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Signed feature counts of each text, whole numbers; zero for a text without words.

    Features are the words in lower case, pairs of neighbouring words, and the
    character trigrams of the words joined by blanks.
    """
    out = np.zeros(len(texts) * dim)
    words = [_WORD.findall(t.lower()) for t in texts]
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(w, len(numbers)) for own in words for w in own], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in words])
    known = list(numbers)

    def add(features: list[str], which: np.ndarray, owners: np.ndarray) -> None:
        place, sign = _signed_places(features, dim)
        np.add(out, np.bincount(owners * dim + place[which], sign[which], len(out)), out=out)

    if len(flat):
        add([f"w:{w}" for w in known], flat, owner)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[near] * len(known) + flat[near + 1], return_inverse=True)
        if len(pairs):
            add([f"w:{known[p // len(known)]} {known[p % len(known)]}" for p in pairs.tolist()], which, owner[near])
        lines = [" ".join(own) for own in words]
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(x) for x in lines])
        inside = np.repeat(np.arange(len(lines)), length)
        at = np.flatnonzero(inside[2:] == inside[:-2])
        codes, which = np.unique((points[at] << np.uint64(42)) | (points[at + 1] << np.uint64(21)) | points[at + 2], return_inverse=True)
        if len(codes):
            three = [(int(c) >> 42, int(c) >> 21 & 0x1FFFFF, int(c) & 0x1FFFFF) for c in codes]
            add([f"c:{chr(a)}{chr(b)}{chr(c)}" for a, b, c in three], which, inside[at])
    return out.reshape(len(texts), dim)


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """``hash_counts`` of each text as a unit vector."""
    vectors = hash_counts(texts, dim)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def hash_vector(text: str, dim: int = DIM) -> np.ndarray:
    """``hash_vectors`` of one text."""
    return hash_vectors([text], dim)[0]


def embed_with(rows: DataFrame, provider: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(id, text) -> (id, embedding) by any provider.

    ``provider`` is called once in each task and returns what embeds a list of at
    most ``batch`` texts, so a model or a connection is set up once a task.  Null
    text is embedded as the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                vectors = np.asarray(embed([t or "" for t in piece.column("text").to_pylist()]), np.float64)
                ends = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.ListArray.from_arrays(ends, pa.array(vectors.reshape(-1)))], ["id", "embedding"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")


def add_embeddings(rows: DataFrame, text: str, provider: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = HASHED_TOGETHER) -> DataFrame:
    """``rows`` with the embedding of the column ``text`` beside it, so that nothing is joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()
        for part in batches:
            for at in range(0, part.num_rows, batch):
                piece = part.slice(at, batch)
                vectors = np.asarray(embed([t or "" for t in piece.column(text).to_pylist()]), np.float64)
                ends = pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.ListArray.from_arrays(ends, pa.array(vectors.reshape(-1)))], [*piece.schema.names, "embedding"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def hash_embed(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, text) -> (id, embedding) by feature hashing."""
    if dim < 1:
        raise ValueError("dim must be positive")

    return embed_with(rows, lambda: lambda texts: hash_vectors(texts, dim), HASHED_TOGETHER)


def hash_counted(rows: DataFrame, text: str, dim: int = DIM) -> DataFrame:
    """``rows`` with the column ``text`` replaced by ``embedding``, its feature counts: a fraction of the unit vector's bytes, at the same angles."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, HASHED_TOGETHER):
                piece = part.slice(at, HASHED_TOGETHER)
                counts = hash_counts([t or "" for t in piece.column(text).to_pylist()], dim)
                ends = pa.array(np.arange(len(counts) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(counts.reshape(-1).astype(np.int32)))], [*kept, "embedding"])

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in kept], StructField("embedding", ArrayType(IntegerType()))]))


def http_provider(post: Callable[[list[str]], list[dict]]) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A provider over a service that answers with {index, embedding} in any order; ``post`` does the call."""

    def embed(texts: list[str]) -> np.ndarray:
        found = sorted(post(texts), key=lambda r: r["index"])
        if [r["index"] for r in found] != list(range(len(texts))):
            raise ValueError("the service did not answer for every text")
        return np.array([r["embedding"] for r in found])

    return lambda: embed
