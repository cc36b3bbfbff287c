"""Harmonic packing of tokenised documents into training sequences.

A document's tokens (and an end token) are cut into whole sequences, then into pieces
of a reciprocal of the capacity each (a half, a third, ...), the largest that fits, down
to a tail shorter than the last of these classes.  A piece of class i = capacity //
length goes to a sequence of exactly i pieces of its class, which therefore never
overflows and is nearly full.

Every worker fills its own sequences as documents stream by: there is no shuffle, and
all that a worker holds is one open sequence for each class.  What is left in these at
its end is laid end to end, cut at the capacity, and the last stretch at powers of two,
so that it needs no padding.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words of a generation that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 48
#: Characters of a text that are cut into words at once.
_PIECE = 1 << 20
#: Bytes of ids that a task collects before it hands sequences on.
_BATCH = 4 << 20
_PIECES = "array<struct<doc_id:long,start:long,length:long,offset:long,doc_tokens:long>>"
SEQUENCES = f"n_tokens long, ids binary, pieces {_PIECES}"


def _stretches(text: str) -> Iterator[bytes]:
    """``text`` in parts of bounded length that are cut at blanks, as UTF-8."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end].encode("utf-8", "replace")
        at = end


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: its own where it is printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(free)}


class Encoder(dict):
    """Ids of texts, as bytes of little-endian 32-bit numbers, with a memory of words.

    For vocabularies that fold case, drop white space and never look across it: a text's
    ids are then those of its words in order.  A word of Latin letters is one unit for such
    a vocabulary and goes to its model directly, and one with a point or comma behind it is
    two, if samples show that the whole tokenizer agrees.  The memory has two generations,
    so frequent words stay.
    """

    #: Latin letters, and marks that can follow them as a unit of their own.
    LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")
    SAMPLES = ("a", "words", "naïve", "größe", "straße", "ÿ", "Àçéñ", "ABC", "Antidisestablishmentarianism")

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.old: dict[bytes, bytes] = {}
        self.letters = _byte_letters()
        self.direct = all(self._model(w) + self._whole(m) == self._whole(w + m) for w in self.SAMPLES for m in ("", ".", ",", "?!", "..."))

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _model(self, letters: str) -> list[int]:
        low = letters.lower()
        return [t.id for t in self.tokenizer.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters))]

    def __missing__(self, word: bytes) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            text = word.decode()
            if self.direct and (parts := self.LATIN.fullmatch(text)):
                ids = self._model(parts[1])
                marks = self[parts[2].encode()] if parts[2] else b""
            else:
                ids, marks = self._whole(text), b""
            packed = struct.pack(f"<{len(ids)}I", *ids) + marks
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join([self[word] for part in _stretches(text) for word in part.split()])


def cuts(tokens: int, capacity: int, classes: int) -> list[int]:
    """Lengths of a document's pieces, in order: whole sequences, reciprocals of the capacity, a tail."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest * classes >= capacity:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


class Bins:
    """One worker's open sequences; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, emit: Callable[[list[tuple]], None]) -> None:
        self.capacity, self.emit = capacity, emit
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple) -> None:
        kind = self.capacity // (len(piece[2]) // 4)
        held = self.open.setdefault(kind, [])
        held.append(piece)
        if len(held) == kind:
            self.emit(self.open.pop(kind))

    def close(self) -> None:
        """All that is left, end to end: full sequences, then ones of a power of two."""
        left = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open.clear()
        total = sum(len(p[2]) for p in left) // 4
        room = [self.capacity] * (total // self.capacity)
        rest = total - sum(room)
        room += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        held: list[tuple] = []
        free = 0
        for doc, start, ids, tokens in left:
            while ids:
                free = free or room.pop(0)
                part, ids = ids[: 4 * free], ids[4 * free :]
                held.append((doc, start, part, tokens))
                start, free = start + len(part) // 4, free - len(part) // 4
                if not free:
                    self.emit(held)
                    held = []


def _packer(encode: Callable[[], Callable[[str], bytes]], capacity: int, classes: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[list[tuple]] = []
        bins, ids_of, end, held = Bins(capacity, full.append), encode(), struct.pack("<I", end_id), 0

        def settle() -> Iterator[pa.RecordBatch]:
            rows = []
            for sequence in full:
                offset, pieces = 0, []
                for doc, start, ids, tokens in sequence:
                    pieces.append({"doc_id": doc, "start": start, "length": len(ids) // 4, "offset": offset, "doc_tokens": tokens})
                    offset += len(ids) // 4
                rows.append((offset, b"".join(p[2] for p in sequence), pieces))
            full.clear()
            if rows:
                tokens, ids, pieces = zip(*rows, strict=True)
                kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "offset", "doc_tokens")]))
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(pieces, kind)], ["n_tokens", "ids", "pieces"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py() or "") + end
                tokens, start = len(ids) // 4, 0
                for length in cuts(tokens, capacity, classes):
                    bins.add((doc, start, ids[4 * start : 4 * (start + length)], tokens))
                    start += length
                held += len(ids)
                if held > _BATCH:
                    yield from settle()
                    held = 0
        bins.close()
        yield from settle()

    return pack


def pack(docs: DataFrame, vocabulary_file: str, capacity: int = 2048, classes: int = 32, end_id: int = 1) -> DataFrame:
    """Sequences of the tokens of ``docs`` (doc_id, text): sequence_id, n_tokens, ids, pieces.

    ``ids`` are the sequence's token ids as little-endian 32-bit numbers, not padded;
    ``pieces`` (doc_id, start, length, offset, doc_tokens) say which part of which
    document lies where.  Each document ends with ``end_id``; a null or empty text is that
    token alone.  Rows with one doc_id, or none, stay documents of their own; other columns
    are ignored; no rows give no sequences.  Very long texts are cut into words part by part
    and only their ids are held; a text without blanks is one word for the tokenizer.
    ``classes`` must not exceed the root of ``capacity``.

    Sequences are numbered by worker.  A lost worker's part is packed anew to the same
    sequences as long as its rows come in the same order, so ``docs`` should be a table
    that was written and not the other side of a shuffle.
    """
    if not 1 <= classes * classes <= capacity:
        raise ValueError("classes must be between 1 and the root of the capacity")
    with open(vocabulary_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(_packer(lambda: Encoder(shared.value).encode, capacity, classes, end_id), SEQUENCES)
    return packed.select(F.monotonically_increasing_id().alias("sequence_id"), "n_tokens", "ids", "pieces")


def padded(length: Column, capacity: int = 2048) -> Column:
    """Tokens that a sequence takes in training: its own at a power of two, else the capacity."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(capacity)).cast("long")


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row for each piece with the CRC-32 of its ids."""
    p = F.col("p")
    each = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    ids = F.substring("ids", (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    return each.select(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(ids).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), "sequence_id", p["offset"].alias("offset"))
