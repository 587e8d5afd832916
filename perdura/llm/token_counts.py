"""Word-piece counts of texts by a linear longest-match automaton.

Method: the vocabulary is a trie whose node is a piece's letters; a piece that may only
continue a word hangs under a second root. Each node has a failure link and the number
of pieces popped on following it: the pieces of the greedy longest match that end
before the letters still pending at the link's target. Counting a word reads each
letter once, follows links when no edge fits and adds their counts; pieces are never
built. A word that the pieces do not cover counts as one unknown piece, as in the
word-piece scheme.

Words are the runs between white space. A word's count is kept by each worker in a
table that is emptied at a fixed size, so memory stays bounded.

Rows: a null or empty text has no pieces. An empty vocabulary gives one unknown piece
for each word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.textkit import slices

REMEMBERED = 400_000
MOST_PIECES = 1_000_000
START = "▁"


class PieceCounter:
    """Counts of greedy longest-match pieces; starts and continuations are sets of pieces."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        # node 0: word start, node 1: inside a word; both are roots
        self.edges: list[dict[str, int]] = [{}, {}]
        parent, letter, ends = [-1, -1], ["", ""], [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        parent.append(node)
                        letter.append(c)
                        ends.append(False)
                    node = self.edges[node][c]
                ends[node] = node > 1
        self.fail: list[int] = [-1] * len(self.edges)
        self.popped: list[int] = [0] * len(self.edges)
        level = [n for root in (0, 1) for n in self.edges[root].values()]
        while level:  # breadth first, so shorter strings have their links already
            for node in level:
                if ends[node]:
                    self.fail[node], self.popped[node] = 1, 1
                    continue
                at, count = self.fail[parent[node]], self.popped[parent[node]]
                while at >= 0 and letter[node] not in self.edges[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.edges[at][letter[node]], count
            level = [n for node in level for n in self.edges[node].values()]

    def count(self, word: str) -> int:
        node = total = 0
        for c in word:
            while c not in self.edges[node]:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1
            node = self.edges[node][c]
        while node > 1:
            total += self.popped[node]
            node = self.fail[node]
        return total if node == 1 else 1


class _Remembered(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.counter.count(word)
        return n


def split_vocabulary(pieces: Iterable[str], start: str = START) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that continue one) of a vocabulary that marks word starts."""
    starts, continuations = set(), set()
    for piece in pieces:
        if piece.startswith(start):
            starts.add(piece[len(start) :])
        else:
            continuations.add(piece)
    return sorted(starts - {""}), sorted(continuations - {""})


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return split_vocabulary(model.id_to_piece(i) for i in ordinary)


def count_tokens(docs: DataFrame, vocabulary: tuple[list[str], list[str]]) -> DataFrame:
    """doc_id, n_words, n_tokens; one row per row of docs."""
    if len(vocabulary[0]) + len(vocabulary[1]) > MOST_PIECES:
        raise ValueError(f"a vocabulary may have {MOST_PIECES} pieces at most")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Remembered(PieceCounter(*shared.value)).__getitem__
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_tokens = [], []
                for text in part.column("text").to_pylist():
                    words = (text or "").split()
                    n_words.append(len(words))
                    n_tokens.append(sum(map(pieces, words)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                    ["doc_id", "n_words", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_tokens long"
    )
