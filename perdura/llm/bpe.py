"""Byte-level BPE encoding and decoding by a depth-first walk of a trie of distinct words.

Method: the BPE encoding of a string less its last token is the encoding of the string
that is left. So one token for each prefix, the last of its encoding, says all encodings
along a path of a trie. A slice's distinct new words are put in byte order, which is the
depth-first order of their trie: each word shares a prefix, a path from the root, with the
word before, and the last tokens along that path are kept. Each prefix is so computed once
however many words begin with it. At a node the last token is the one token that ends there
and stands the border test against the last token of the node where it begins.

Border test: tokens u, t stay apart if no merge takes a right edge x of u with a left edge
y of t while both are edges. An edge lasts until the merge that takes it into the next
larger edge. Merges apply by rank and, at the same rank, from the left, so the crossing
merge comes first if its rank is below that of x's and not above that of y's.

Decoding looks up each token's bytes.

Words come from the tokenizer's own splitting pattern. Which letters and digits it knows
depends on the library's Unicode version, so the library is asked once about every code
point that this Python's pattern and the library might see differently.

Rows: null text counts as empty and gives no tokens and an empty text. Rows are kept one
for one, whatever their ids. Bytes of ids that are no UTF-8 decode to U+FFFD. Texts of any
length are read in pieces of PIECE words; a word longer than LONG bytes is a path of its own
and is not remembered.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.textkit import slices

REMEMBERED = 300_000  # words, and border tests, that a worker keeps
LONG = 200
SLICE = 1 << 20  # bytes of texts whose words are taken together
PIECE = 200_000
NEVER = 1 << 60

NEAR = 0x250

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: itself if it is printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(points: Iterable[int]) -> str:
    points = np.array(sorted(points), dtype=np.int64)
    if not len(points):
        return ""
    cut = np.flatnonzero(np.diff(points) != 1)
    first, last = points[np.r_[0, cut + 1]], points[np.r_[cut, len(points) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))


@lru_cache(maxsize=4)
def word_patterns(path: str) -> tuple[str, str]:
    """The splitting pattern with the letters and digits that the tokenizer's library knows, and
    a plainer and faster one for texts whose characters all lie below NEAR.

    Asked are the code points on which two Unicode versions at hand, those of the pattern
    module and of Python, disagree; on the others versions do not differ.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    whole = "".join(map(chr, points))
    far, near = {}, {"space": _ranges(p for p in range(NEAR) if regex.match(r"\s", chr(p)))}
    for name, kind, before in (("letter", "L", "a"), ("digit", "N", "1")):
        own = set(map(ord, regex.findall(rf"\p{{{kind}}}", whole)))
        asked = [p for p in points if (p in own) != (unicodedata.category(chr(p))[0] == kind)]
        found = split("".join(f"{before}{chr(p)}\n" for p in asked))
        theirs = {asked[a // 3] for _, (a, b) in found if b - a == 2 and a % 3 == 0}
        more, less = theirs - own, own.intersection(asked) - theirs
        far[name] = rf"[\p{{{kind}}}{_ranges(more)}{'--[' + _ranges(less) + ']' if less else ''}]"
        near[name] = _ranges(p for p in (own | more) - less if p < NEAR)
    return "(?V1)" + WORDS.format(space=r"\s", **far), WORDS.format(**near)


class Bpe:
    """Encoder and decoder of one vocabulary file; `from_file` reads it."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int], patterns: tuple[str, str]):
        """tokens by id; merges as (left, right, result) in rank order; special texts with their ids; word_patterns."""
        self.tokens = tokens
        self.words, self.near_words = regex.compile(patterns[0]), re.compile(patterns[1])
        self.far = re.compile(f"[{chr(NEAR)}-\U0010ffff]")
        self.special = special
        self.cut = None
        if special:
            self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=lambda s: (-len(s), s))))
        self.rank = {(a << 24) | b: m for m, (a, b, _) in enumerate(merges)}
        parts = {c: (a, b, m) for m, (a, b, c) in enumerate(merges)}
        if len(parts) != len(merges):
            raise ValueError("a token is the result of two merges")
        self.parts = parts
        whole = set(range(len(tokens))) - set(parts)  # tokens that are their own encoding
        whole -= set(special.values())
        if {tokens[i] for i in whole} < {bytes([b]) for b in range(256)}:
            raise ValueError("the vocabulary lacks single bytes")
        made = set(whole)
        for m, (a, b, c) in enumerate(merges):
            if not made.issuperset((a, b)):
                raise ValueError("a merge comes before those of its parts")
            made.add(c)
            if a in whole and b in whole and self._apart(a, b, m):
                whole.add(c)
        self._build(sorted(whole))
        self.known: dict[str, bytes] = {}
        self.borders: dict[int, bool] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]

    def _build(self, whole: list[int]) -> None:
        """The automaton of all tokens: at each state, the tokens that end there, longest first."""
        self.edges: dict[int, int] = {}  # (state << 8) | byte -> state
        depth, own = [0], [-1]
        for token in whole:
            state = 0
            for byte in self.tokens[token]:
                key = (state << 8) | byte
                if key not in self.edges:
                    self.edges[key] = len(depth)
                    depth.append(depth[state] + 1)
                    own.append(-1)
                state = self.edges[key]
            own[state] = token
        self.fail = [0] * len(depth)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(depth)
        self.step = dict(self.edges)
        for key, state in sorted(self.edges.items(), key=lambda e: depth[e[1]]):
            if key >> 8:
                self.fail[state] = self._next((self.fail[key >> 8] << 8) | (key & 255))
            mine = ((own[state], depth[state]),) if own[state] >= 0 else ()
            self.ending[state] = mine + self.ending[self.fail[state]]

    def _next(self, key: int) -> int:
        """The state after a byte, by failure links; remembered."""
        if len(self.step) > len(self.edges) + REMEMBERED:
            self.step = dict(self.edges)
        at = key
        while at not in self.edges and at >> 8:
            at = (self.fail[at >> 8] << 8) | (key & 255)
        found = self.step[key] = self.edges.get(at, 0)
        return found

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        return cls(*read_vocabulary(path))

    def _edges(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The tokens once at an edge of token (side 0: left, 1: right), each with the rank that ends it."""
        end = NEVER
        while True:
            yield token, end
            if token not in self.parts:
                return
            end = self.parts[token][2]
            token = self.parts[token][side]

    def _apart(self, u: int, t: int, but: int = -1) -> bool:
        """Whether no merge, other than the one of rank `but`, crosses the border of u and t."""
        rank, left = self.rank, list(self._edges(t, 0))
        for x, end_x in self._edges(u, 1):
            for y, end_y in left:
                m = rank.get((x << 24) | y)
                if m is not None and m != but and m < end_x and m <= end_y:
                    return False
        return True

    def _border(self, pair: int) -> bool:
        if len(self.borders) >= REMEMBERED:
            self.borders.clear()
        apart = self.borders[pair] = self._apart(pair >> 24, pair & 0xFFFFFF)
        return apart

    def _walk(self, path: bytes, states, last) -> None:
        """Carry the automaton's state and the last token of each prefix to the path's end."""
        ending, borders, state = self.ending, self.borders, states[-1]
        for n in range(len(last), len(path) + 1):
            key = (state << 8) | path[n - 1]
            state = self.step.get(key)
            if state is None:
                state = self._next(key)
            for token, k in ending[state]:
                if k == n:
                    break
                pair = (last[n - k] << 24) | token
                apart = borders.get(pair)
                if apart is None:
                    apart = self._border(pair)
                if apart:
                    break
            states.append(state)
            last.append(token)

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words, none of them over LONG bytes, by the walk of their trie."""
        fresh = sorted(words)  # by code point, which is also the order of their UTF-8 bytes
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
        tokens, packed, known = self.tokens, self.packed, self.known
        # automaton state, last token and whole encoding of each prefix on the path
        states, last, done, before = [0], [-1], [b""], b""
        for word in fresh:
            path = word.encode()
            most = min(len(path), len(before))
            apart = int.from_bytes(path[:most]) ^ int.from_bytes(before[:most])
            shared = most - (apart.bit_length() + 7) // 8 + 1
            del states[shared:], last[shared:], done[shared:]
            self._walk(path, states, last)
            for n in range(shared, len(path) + 1):
                token = last[n]
                done.append(done[n - len(tokens[token])] + packed[token])
            known[word] = done[-1]
            before = path

    def _long(self, word: str) -> bytes:
        """A word of any length: its path alone, read backwards from the last token."""
        path, states, last, found = word.encode(), array("i", [0]), array("i", [-1]), []
        self._walk(path, states, last)
        n = len(path)
        while n:
            found.append(self.packed[last[n]])
            n -= len(self.tokens[last[n]])
        return b"".join(reversed(found))

    def _prepare(self, words: set[str]) -> None:
        """Have the encodings of all these words at hand but for the long ones."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        self.learn(w for w in words.difference(self.known) if len(w) * 4 <= LONG or len(w.encode()) <= LONG)

    def _join(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            return b"".join(self.known[w] if w in self.known else self._long(w) for w in words)

    def _pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and the ids of special texts, in order."""
        at = 0
        for found in self.cut.finditer(text) if self.cut else ():
            yield from self._split(text[at : found.start()])
            yield self.special[found.group()]
            at = found.end()
        yield from self._split(text[at:] if at else text)

    def _split(self, text: str) -> Iterator[list[str]]:
        pattern = self.words if self.far.search(text) else self.near_words
        if len(text) <= PIECE:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while words := [m.group() for m in islice(found, PIECE)]:
            yield words

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers.

        The distinct words of all texts share one trie, unless the texts are long together.
        """
        if sum(map(len, texts)) > SLICE:
            return [b"".join(self._encode_pieces(text)) for text in texts]
        pieces = [list(self._pieces(text)) for text in texts]
        self._prepare({w for text in pieces for piece in text if not isinstance(piece, int) for w in piece})
        return [
            b"".join(self.packed[p] if isinstance(p, int) else self._join(p) for p in text) for text in pieces
        ]

    def _encode_pieces(self, text: str) -> Iterator[bytes]:
        for piece in self._pieces(text):
            if isinstance(piece, int):
                yield self.packed[piece]
            else:
                self._prepare(set(piece))
                yield self._join(piece)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> str:
        return decode_ids(self.tokens, packed)


def decode_ids(tokens: list[bytes], packed: bytes) -> str:
    ids = np.frombuffer(packed, dtype="<u4").tolist()
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int], tuple[str, str]]:
    """(tokens by id, merges, special texts, splitting patterns) of a tokenizer file with byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, words = whole["model"], whole["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE" and words.get("type") == "ByteLevel" and words.get("use_regex", True)
        and not words.get("add_prefix_space") and whole["normalizer"] is None
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"]):
        raise ValueError(f"{path} is no plain byte-level BPE")
    letters, vocab = byte_letters(), model["vocab"]
    tokens = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in whole["added_tokens"])]))
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text)
    merges = []
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    for text, i in special.items():
        tokens[i] = text.encode()
    return tokens, merges, special, word_patterns(path)


_ready: dict[int, Bpe] = {}


def _of(shared) -> Bpe:
    """The worker's own coder for a broadcast vocabulary, built once."""
    if shared.value[0] not in _ready:
        _ready.clear()
        _ready[shared.value[0]] = Bpe(*shared.value[1])
    return _ready[shared.value[0]]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers); one row per row of docs."""
    vocabulary = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((hash((path, len(vocabulary[0]))), vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of(shared)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = coder.encode_all([text or "" for text in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encode` with the text of their ids; a null `ids` gives an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            for part in slices(batch, "ids", SLICE):
                texts = [decode_ids(tokens, ids or b"") for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary, text string"
    )
