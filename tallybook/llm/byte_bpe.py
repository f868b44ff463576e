"""Byte-level BPE: encoding to ids by ranked merges and decoding back to bytes.

Every task encodes each distinct word once: the bytes of many words are folded together, lowest rank first in each, with
a rank map that the task loads from the vocabulary file, and the ids are joined back to the words of every document in order.
Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from tallybook.llm.batches import Memo, add_columns, held, id_and_text

RANKS = "byte_bpe_50k.tiktoken"
# above all ranks
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


class Merges:
    """Folds the bytes of many words at once: each round makes the best merge of every word that has one left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), NEVER) for b in range(256)], np.int64)
        merged = sorted(
            (ranks[piece[:i]] << 32 | ranks[piece[i:]], rank)
            for piece, rank in ranks.items()
            for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        )
        self.pair, self.rank = np.array([*merged, (NEVER, NEVER)], np.int64).T.copy()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two pieces make."""
        pair = left << 32 | right
        at = np.searchsorted(self.pair, pair)
        return np.where(self.pair[at] == pair, self.rank[at], NEVER)

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: the adjacent pair of lowest rank becomes one piece (ties: the leftmost), until none is left."""
        out: list[list[int]] = [[self.ranks[w]] if w in self.ranks else [] for w in words]
        which = np.array([k for k, w in enumerate(words) if w and not out[k]], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join([words[k] for k in which.tolist()]), np.uint8)]
        if (ids == NEVER).any():
            raise KeyError("a byte that no rank stands for")
        size = np.array([len(words[k]) for k in which.tolist()], np.int64)
        start = np.cumsum(size) - size
        best = np.append(self._ranked(ids[:-1], ids[1:]), NEVER)[: len(ids)]
        best[start + size - 1] = NEVER
        while len(which):
            least = np.minimum.reduceat(best, start)
            ended = least == NEVER
            if ended.any():
                gone = np.repeat(ended, size)
                pieces, at = ids[gone].tolist(), 0
                for k, n in zip(which[ended].tolist(), size[ended].tolist(), strict=True):
                    out[k] = pieces[at : at + n]
                    at += n
                ids, best = ids[~gone], best[~gone]
                which, size, least = which[~ended], size[~ended], least[~ended]
                if not len(which):
                    break
                start = np.cumsum(size) - size
            found = np.flatnonzero(best == np.repeat(least, size))
            # the leftmost of each word
            at = found[np.searchsorted(found, start)]
            ids[at] = least
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ends = at + 1 == start + size - 1
            ids, best = ids[kept], best[np.append(kept[1:], True)]
            back = np.arange(len(which))
            at, start, size = at - back, start - back, size - 1
            best[at[ends]] = NEVER
            k = at[~ends]
            best[k] = self._ranked(ids[k], ids[k + 1])
            k = at[at > start]
            best[k - 1] = self._ranked(ids[k - 1], ids[k])
        return out


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    return Merges(ranks).fold([word])[0]


class Coder:
    """Encodes and decodes texts; keeps what it knows of distinct words, and of the parts between spaces."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.words = regex.compile(pattern)
        self.letters = r"| ?\p{L}+|" in f"|{pattern}|"
        self.runs = re.compile(r" (?:(?=\s)|(?<=\s ))")
        self.merges = Merges(self.ranks)
        self.folded = Memo(self._encode_words, limit=300_000)
        self.known = Memo(self._encode_chunks)

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that no match of the pattern crosses.

        A single space goes with what follows it. Runs of white space match together, so that a text with a space
        beside another blank is cut at the matches themselves.
        """
        if self.runs.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + r for r in rest]

    def _words_of(self, chunk: str) -> list[str]:
        """The matches of the pattern; letters after one space or none are one match."""
        if self.letters and chunk.isascii() and (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
            return [chunk]
        return self.words.findall(chunk)

    def _encode_words(self, words: list[str]) -> list[tuple[str, int, bytes]]:
        """The ids as decimal text, their number, and the bytes they decode to."""
        folded = self.merges.fold([w.encode("utf-8") for w in words])
        return [(" ".join(map(str, i)), len(i), self.decode(i)) for i in folded]

    def _encode_chunks(self, chunks: list[str]) -> list[tuple[str, int, bytes]]:
        """The same of parts of texts, joined from their words."""
        split = list(map(self._words_of, chunks))
        self.folded.learn(chain.from_iterable(split))
        out = []
        for words in split:
            found = list(map(self.folded.__getitem__, words))
            if len(found) != 1:
                texts, sizes, pieces = zip(*found, strict=True) if found else ((), (), ())
                found = [(" ".join(texts), sum(sizes), b"".join(pieces))]
            out += found
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def _found(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        split = list(map(self.chunks, texts))
        self.known.learn(chain.from_iterable(split))
        for chunks in split:
            yield list(map(self.known.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for f in found for i in f[0].split()] for found in self._found(texts)]

    def digests(self, texts: list[str]) -> list[list]:
        """Columns: number of ids, sha256 of the ids as decimal text, sha256 of the decoded bytes."""
        sizes, ids, decoded = [], [], []
        for found in self._found(texts):
            sizes.append(sum([f[1] for f in found]))
            ids.append(hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
        return [sizes, ids, decoded]


def _coder(path: str, pattern: str) -> Coder:
    """One for each Python worker, for all of its tasks."""
    return held(("byte_bpe", path, pattern), lambda: Coder(path, pattern))


def encode_digests(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row.

    Null text is empty: no ids, the digests of nothing. Repeated rows and null ids are kept as they are; other
    columns are not read. Equal ranks cannot meet in one word but as the same pair, where the leftmost goes first.
    """
    path = os.path.abspath(public_tokenizers.path(ranks))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return add_columns(id_and_text(docs), lambda: _coder(path, pattern).digests, made, ["doc_id"])


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the ids of every text (null: none)."""
    path = os.path.abspath(public_tokenizers.path(ranks))
    return add_columns(
        id_and_text(docs), lambda: lambda texts: [_coder(path, pattern).encode(texts)], "ids array<int>", ["doc_id"]
    )
