"""Token counts by greedy longest-match word pieces, in linear time.

The vocabulary becomes a trie with two roots, for pieces that start a word and
pieces that continue one.  Where the trie cannot go on, a failure link leads to
the node for what is left of the input after the longest match is taken out, and
the link's precomputed count says how many pieces that took.  So a word is
counted in one pass over its characters and no piece is ever built.

Words are runs of characters other than ASCII white space.  A word that cannot be
cut into pieces is one unknown token.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_START, _REST = 0, 1
#: Words whose counts a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 40


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces that continue one) of a vocabulary file.

    A ``.model`` file is read with sentencepiece (a leading low line marks a
    start), any other as lines of word pieces (a leading ``##`` marks the rest).
    Control and byte pieces are left out.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]
    with open(path, encoding="utf-8") as f:
        lines = [x for x in f.read().split("\n") if x]
    return [x for x in lines if not x.startswith("##")], [x[2:] for x in lines if x.startswith("##") and len(x) > 2]


class Automaton:
    """The trie, its failure links and the pieces that each link pops."""

    def __init__(self, starts: Iterable[str], rests: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, words in ((_START, starts), (_REST, rests)):
            for word in words:
                node = root
                for ch in word:
                    if ch not in self.next[node]:
                        self.next[node][ch] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = self.next[node][ch]
                piece[node] = piece[node] or node > _REST
        self.link: list[int] = [-1] * len(self.next)
        self.pops: list[int] = [0] * len(self.next)
        queue = deque([_START, _REST])
        while queue:
            parent = queue.popleft()
            for ch, node in self.next[parent].items():
                queue.append(node)
                if piece[node]:
                    self.link[node], self.pops[node] = _REST, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at >= 0 and ch not in self.next[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.next[at][ch], popped

    def count(self, word: str) -> int:
        """Pieces of ``word``; 0 if it cannot be cut."""
        nxt, link, pops = self.next, self.link, self.pops
        node, pieces = _START, 0
        for ch in word:
            while ch not in nxt[node]:
                if link[node] < 0:
                    return 0
                pieces += pops[node]
                node = link[node]
            node = nxt[node][ch]
        while node != _REST:
            if link[node] < 0:
                return 0
            pieces += pops[node]
            node = link[node]
        return pieces


class _Memory(dict):
    """Counts of the words seen so far, at most ``REMEMBERED`` at a time."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, pieces: tuple[list[str], list[str]]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of ``docs`` (doc_id, text).

    Unknown words count as one token each.  Null and wordless texts have none.
    Rows with one doc_id stay separate; other columns are ignored.  No shuffle;
    the automaton is as large as the vocabulary, whatever the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Memory(shared.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = _WORD.findall(text.as_py() or "")
                counts = [known[w] for w in words]
                unknown = counts.count(0)
                rows.append((len(words), sum(counts) + unknown, unknown))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
