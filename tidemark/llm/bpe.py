"""op12: BPE encoding and decoding by an index of pair occurrences.

A partition's texts are split into pieces that no merge crosses, and each piece not met
before is encoded once. ``Merges`` does that for many pieces together: it maps each pair to
all its positions, applies the ranks that have positions in ascending order, each to all of
them at once, and files the pairs that a merge creates under their own ranks. Its cost
follows the merges done, so a piece of a million letters is no special case.

A rank's merges within a piece are done together, not one by one: that is the same as
merging the least rank first as long as no merge can create a pair of a lower rank, which
``Merges`` verifies for the given vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import byte_view, steps, table, texts

#: Pieces that a worker remembers; beyond, a piece is encoded again in each step that has it.
REMEMBERED = 150_000
#: Bytes of text whose new pieces share one index.
STEP = 4_000_000

#: Letters whose classes, composition and lower case no Unicode version has changed.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
_MARKS = "«»¿¡–—‘’“”„…€§°£"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_UNUSUAL = re.compile(rf"[^\t\n\r !-~{_LETTERS}{_MARKS}]")

DEAD, END = -2, -1


class Merges:
    """Encodes many pieces at once with one index from pairs to positions."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str, byte_chars: list[str]):
        self.left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        self.right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.span = max(vocabulary.values()) + 1
        keys = self.left * self.span + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.inner = np.array([vocabulary[c] for c in byte_chars], np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in byte_chars], np.int64)
        first = np.full(self.span, len(merges), np.int64)
        np.minimum.at(first, self.left, np.arange(len(merges)))
        np.minimum.at(first, self.right, np.arange(len(merges)))
        if (first[self.made] < np.arange(len(merges))).any():
            raise ValueError("a merge of this vocabulary creates pairs of a lower rank")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = a * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the end of each piece's ids."""
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes + 1)  # a place after each piece holds END, so that no pair crosses pieces
        symbol = np.full(ends[-1], END, np.int64)
        real = np.ones(ends[-1], bool)
        real[ends - 1] = False
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbol[real] = self.inner[data]
        symbol[ends - 2] = self.final[data[np.cumsum(sizes) - 1]]
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(part)

        file(np.arange(len(symbol) - 1))
        while active:
            r = heapq.heappop(active)
            at = np.concatenate(places.pop(r))
            at = at[(symbol[at] == self.left[r]) & (symbol[after[at]] == self.right[r])]
            if not len(at):
                continue
            if self.left[r] == self.right[r]:
                at = self._apart(np.unique(at), after)
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = DEAD
            after[at] = after[gone]
            before[after[at]] = at
            touched = np.concatenate([before[at], at])
            file(np.unique(touched[touched >= 0]))
        alive = symbol >= 0
        return symbol[alive].astype("<u4"), np.cumsum(alive)[ends - 1]

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Every second position of a chain of overlapping pairs of one symbol, from its left."""
        chained = np.zeros(len(at), bool)
        chained[1:] = after[at[:-1]] == at[1:]
        start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        return at[(np.arange(len(at)) - start) % 2 == 0]


class Codec:
    """Ids and decoded text of whole texts, as the vocabulary file's own library gives them."""

    def __init__(self, tokenizer: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, library = described["model"], Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        byte_chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(byte_chars)}
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"], byte_chars)
        self.word = {i: t for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.ids: dict[str, bytes] = {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        self.decoded: dict[str, str] = {t: t for t in self.added}

    def pieces(self, text: str) -> list[str]:
        """What merges don't cross, in order; an added token is a piece of its own."""
        if _UNUSUAL.search(text):
            return [p for part in self.at_added.split(text) for p in ([part] if part in self.added else self._by_library(part))]
        if "<|" in text:
            return [p for part in self.at_added.split(text) for p in ([part] if part in self.added else _PIECES.findall(part.lower()))]
        return _PIECES.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.split(self.normal(text))] if text else []

    def learn(self, pieces: set[str]) -> None:
        new, first = list(pieces), 0
        ids, ends = self.merges.encode([p.encode() for p in new])
        data, words = ids.tobytes(), list(map(self.word.__getitem__, ids.tolist()))
        for piece, end in zip(new, ends.tolist(), strict=True):
            self.ids[piece] = data[4 * first : 4 * end]
            self.decoded[piece] = " ".join(words[first:end])
            first = end

    def forget(self) -> None:
        while len(self.ids) > REMEMBERED:
            self.ids.popitem()
            self.decoded.popitem()

    def encode(self, many: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit bytes, and the text that they decode to, of each text."""
        split = [self.pieces(t) for t in many]
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        self.learn(new.difference(self.ids))
        for pieces in split:
            yield b"".join(map(self.ids.__getitem__, pieces)), " ".join(map(self.decoded.__getitem__, pieces))
        self.forget()


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it has one, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (c for c in range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_CODECS: dict[str | None, Codec] = {}


def codec(tokenizer: str | None = None) -> Codec:
    """One codec a worker process; its remembered pieces serve all its tasks."""
    if tokenizer not in _CODECS:
        _CODECS[tokenizer] = Codec(tokenizer)
    return _CODECS[tokenizer]


def _coded(batches: Iterator[pa.RecordBatch], tokenizer: str | None) -> Iterator[tuple[pa.Array, list[tuple[bytes, str]]]]:
    own = codec(tokenizer)
    for batch in batches:
        for first, last in steps(byte_view(batch.column(1))[1], STEP):
            part = batch.slice(first, last - first)
            yield part.column(0), own.encode(part.column(1).to_pylist())


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every document, ``ids`` as an array of token ids.

    A null text is empty and has no ids; repeated rows are each encoded; strings of added
    tokens in a text are these tokens. Other columns are not read. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, rows in _coded(batches, tokenizer):
            rows = list(rows)
            values = [doc_id, pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array([d for _, d in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encoded``'s results as digests, without moving them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, rows in _coded(batches, tokenizer):
            out = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, d in rows]
            values = [doc_id, *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
