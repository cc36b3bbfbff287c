"""Words and word n-grams of a text as 64-bit hashes (numpy).

A word is a run of characters other than ASCII white space, hashed by a
polynomial over its UTF-8 bytes; an n-gram is hashed from its words' hashes.
All functions see whole texts; long ones are hashed in pieces cut between words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = _U(0xD1342543DE82EF95)
_PIECE = 1 << 20
#: Bytes whose powers and sums stay in a core's cache.
_CACHED = 1 << 16
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys once each in ascending order, a place of each, and where each of ``keys`` is among them."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    place = order[new]
    return keys[place], place, back


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), _U(base))
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers


def _spaces(data: np.ndarray) -> np.ndarray:
    """Blanks and the five from tabulator to carriage return."""
    return (data == 32) | (data - np.uint8(9) < 5)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of each word."""
    edge = np.ones(len(data) + 2, bool)
    edge[1:-1] = _spaces(data)
    change = np.flatnonzero(edge[1:] != edge[:-1])
    return change[::2], change[1::2]


def _pieces(data: np.ndarray, size: int):
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        window = 256
        while end < len(data):
            gaps = np.flatnonzero(_spaces(data[end : end + window]))
            if len(gaps):
                end += int(gaps[0])
                break
            end, window = min(end + window, len(data)), 2 * window
        yield data[at:end]
        at = end


def _hashed(data: np.ndarray, size: int = _PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and one-past-last byte of each word."""
    out, at = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for piece in _pieces(data, size):
        start, end = word_spans(piece)
        power, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, _U)
        np.cumsum((piece.astype(_U) + _U(1)) * power[: len(piece)], out=sums[1:])
        out.append((mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U)), start + at, end + at))
        at += len(piece)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word of ``text``, in order."""
    return _hashed(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[0]


@dataclass(frozen=True)
class Words:
    """The words of several texts, in order: hashes, first and one-past-last bytes in ``data``, how many each text has, and bytes of each text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    data: np.ndarray
    sizes: np.ndarray


def words_of(texts: list[str]) -> Words:
    """The words of all ``texts`` in one pass, with the hashes of ``word_hashes``."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" ".join(raw), np.uint8)
    hashes, start, end = _hashed(data, _CACHED)
    first = np.searchsorted(start, np.cumsum(sizes + 1) - sizes - 1)
    return Words(hashes, start, end, np.diff(first, append=len(start)), data, sizes)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` words; of fewer words, one for all of them; of none, none."""
    size = min(n, len(words))
    if not size:
        return np.zeros(0, _U)
    grams = np.zeros(len(words) - size + 1, _U)
    for i in range(size):
        grams = grams * _STEP + words[i : len(words) - size + 1 + i]
    return mix(grams + _U(size))
