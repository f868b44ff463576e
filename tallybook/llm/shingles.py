"""Five-word shingles of texts: hashed for candidates, exact for verification."""

from __future__ import annotations

import numpy as np
import xxhash

from tallybook.llm.batches import Memo

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.uint64(pow(int(_STEP), k, 1 << 64)) for k in range(WORDS)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hasher:
    """64-bit digests of the shingles of a text, in the order of the text."""

    def __init__(self):
        self.known = Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words], limit=400_000)

    def __call__(self, text: str) -> np.ndarray:
        """One digest per five successive words; a shorter text with words has one for all of them."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        try:
            found = list(map(self.known.__getitem__, words))
        except KeyError:
            self.known.learn(words)
            found = list(map(self.known.__getitem__, words))
        h = np.array(found, np.uint64)
        size = min(WORDS, len(h))
        n = len(h) - size + 1
        rolled = h[:n] * _POWERS[0]
        for k in range(1, size):
            rolled += h[k : k + n] * _POWERS[k]
        return mix(rolled + np.uint64(size))


class Numbers:
    """Numbers of the words of texts: equal numbers, equal words. A text that comes again is not split again."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, text: str) -> np.ndarray:
        if text not in self.known:
            number = self.number
            self.known[text] = np.fromiter((number.setdefault(w, len(number)) for w in text.split()), np.int64)
        return self.known[text]


def exact_ids(texts: list[str]) -> list[np.ndarray]:
    """For each text the numbers of its shingles in order: equal numbers, equal words, across these texts."""
    return shingle_ids(list(map(Numbers(), texts)))


def shingle_ids(words: list[np.ndarray]) -> list[np.ndarray]:
    """The same of texts whose words are numbers."""
    sizes = [min(WORDS, len(w)) for w in words]
    counts = [len(w) - s + 1 if s else 0 for w, s in zip(words, sizes, strict=True)]
    # a missing word of a short text has a number of its own
    missing = max((int(w.max()) + 1 for w in words if len(w)), default=0)
    padded = [np.append(w, np.full(WORDS - 1, missing)) for w in words]
    ids = np.concatenate([p[:n] for p, n in zip(padded, counts, strict=True)] or [np.empty(0, np.int64)])
    for k in range(1, WORDS):
        after = np.concatenate([p[k : k + n] for p, n in zip(padded, counts, strict=True)] or [ids])
        _, ids = np.unique(ids * (missing + 1) + after, return_inverse=True)
    return np.split(ids, np.cumsum(counts)[:-1]) if words else []
