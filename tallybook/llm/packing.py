"""Packing of token sequences by exact complements, then best fit.

Pieces are packed by length alone. The table of piece counts per length has at most `size` rows whatever the
input, so the plan is made on counts: single, pair and triple sums are looked up by the gap that a long piece
leaves, and a combination that fills the gap exactly is consumed as often as its lengths are available. What is
left goes by best fit. Each step exhausts a length or places the last of it, which bounds the plan, too. Spark
then numbers the pieces of every length and reads each one's sequence and offset from the plan.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tallybook.llm.batches import held, id_and_text, slices
from tallybook.sources.staging import stage

TOKENIZER = "word_bpe_49k.json"
SIZE = 2048
END = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, number long"

# splitting also cuts at these, which are no white space to the tokenizer
_SEPARATORS = re.compile("[\x1c-\x1f]")
# a letter and the signs after it, at the end of a word
_SIGNS = r"(\pL)([^\s\pL\pN]+)(\s|$)"
# words that are encoded as one text
_TOGETHER = 500
# texts whose distinct words are encoded once: a bound on memory
_SLICE_BYTES = 16_000_000


def _is_latin(word: str) -> bool:
    """Letters that are composed already, each of them one letter to the tokenizer in lower case, too."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))


def _is_plain(text: str) -> bool:
    """Characters up to U+00FF, whose lower case is the tokenizer's, and no special string in any case."""
    if "<|" in text:
        return False
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class Ids:
    """Little-endian unsigned 32-bit ids of whole texts.

    The tokenizer never joins characters across white space, nor letters with the signs after them, and it reads
    lower case, so a text's ids are those of its words in order. Arrow splits the texts and numbers their distinct
    words, the library encodes each of these once, and Arrow puts the ids where the words stand. Words of letters
    alone are encoded many at a time: the last id of each is one that ends a word.
    """

    def __init__(self, path: str):
        # a worker's own thread does all the work
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # ASCII letters in lower case need neither the rules of reading nor the pattern of words
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _encode(self, words: list[str]) -> pa.Array:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return pa.array([np.array(e.ids, "<u4").tobytes() for e in found], pa.large_binary())

    def _encode_together(self, words: pa.Array, tokenizer: Tokenizer) -> pa.Array:
        text = " ".join(words.to_pylist())
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(words):
            return self._encode(words.to_pylist())
        buffers = [None, pa.py_buffer(np.append(0, cuts).astype(np.int64)), pa.py_buffer(ids)]
        return pa.Array.from_buffers(pa.large_binary(), len(words), buffers)

    def _of_words(self, words: pa.Array) -> pa.Array:
        letters = np.array(pc.and_(pc.string_is_ascii(words), pc.utf8_is_alpha(words)), bool)
        rest = np.flatnonzero(~letters)
        latin = np.array([_is_latin(w) for w in words.take(pa.array(rest)).to_pylist()], bool)
        places = np.flatnonzero(letters), rest[latin], rest[~latin]
        ascii_, latin, other = (words.take(pa.array(p)) for p in places)
        found = [
            self._encode_together(some.slice(i, _TOGETHER), tokenizer)
            for some, tokenizer in ((pc.ascii_lower(ascii_), self.letters), (latin, self.tokenizer))
            for i in range(0, len(some), _TOGETHER)
        ]
        found.append(self._encode(other.to_pylist()))
        order = np.empty(len(words), np.int64)
        order[np.concatenate(places)] = np.arange(len(words))
        return pa.concat_arrays(found).take(pa.array(order))

    def _of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.utf8_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._of_words(words.dictionary).take(words.indices)
        _, until, raw = ids.buffers()
        until = np.frombuffer(until, np.int64)[np.asarray(split.offsets)].tolist()
        for i, j in pairwise(until):
            yield raw[i:j].to_pybytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        # Arrow splits where the tokenizer does, but for the separators
        whole = [bool(_SEPARATORS.search(t)) for t in texts]
        plain = [not w and _is_plain(t) for t, w in zip(texts, whole, strict=True)]
        lowered = pa.array([t.lower() for t, p in zip(texts, plain, strict=True) if p], pa.large_string())
        other = pa.array([t for t, p, w in zip(texts, plain, whole, strict=True) if not p and not w], pa.large_string())
        apart = self._of_texts(pc.replace_substring_regex(lowered, _SIGNS, r"\1 \2\3"))
        other = self._of_texts(other)
        for text, p, w in zip(texts, plain, whole, strict=True):
            yield self._encode([text])[0].as_py() if w else next(apart if p else other)


def _ids(path: str) -> Ids:
    """One for each Python worker, for all of its tasks."""
    return held(("packing", path), lambda: Ids(path))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """Every document's ids and the id that ends it, cut after each `size` ids; numbered by task and length."""
    path, end = os.path.abspath(public_tokenizers.path(tokenizer)), np.asarray([END], "<u4").tobytes()
    schema = _parse_datatype_string(PIECES)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, part = _ids(path), Counter(), TaskContext.get().partitionId()
        for batch in slices(batches, size=_SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    cut = ids[k : k + 4 * size]
                    length = len(cut) // 4
                    rows.append((doc_id, k // (4 * size), k // 4, length, zlib.crc32(cut), part, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out
            )

    return id_and_text(docs).mapInArrow(run, schema)


@dataclass(frozen=True)
class Pattern:
    """The same lengths packed together `times` times; the first sequence is number `first`."""

    lengths: tuple[int, ...]
    times: int
    first: int


class _Sums:
    """Available pieces by length, with lookups of one, two or three lengths that sum to a gap."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] else None

    def two(self, gap: int) -> tuple[int, ...] | None:
        """The longest possible first length, so that short pieces stay for later gaps."""
        if gap < 2:
            return None
        low = self.left[1 : gap // 2 + 1]
        high = self.left[gap - len(low) : gap][::-1]
        both = (low > 0) & (high > 0)
        if gap % 2 == 0 and self.left[gap // 2] < 2:
            both[-1] = False
        found = int(np.argmax(both)) if both.any() else -1
        return None if found < 0 else (gap - found - 1, found + 1)

    def three(self, gap: int) -> tuple[int, ...] | None:
        for length in np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1]:
            self.left[length] -= 1
            rest = self.two(gap - int(length))
            self.left[length] += 1
            if rest:
                return (int(length), *rest)
        return None

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[length]) // n for length, n in Counter(lengths).items())

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times


def plan(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that place every piece once: exact fillings first, best fit for the rest."""
    if any(not 0 < length <= size for length in counts):
        raise ValueError(f"lengths must lie between 1 and {size}")
    sums, made, first = _Sums(counts, size), [], 0

    def use(lengths: tuple[int, ...], times: int) -> None:
        nonlocal first
        sums.take(lengths, times)
        made.append(Pattern(lengths, times, first))
        first += times

    if n := int(sums.left[size]):
        use((size,), n)
    for length in range(size - 1, 0, -1):
        for combination in (sums.one, sums.two, sums.three):
            while sums.left[length]:
                # one piece of this length is in use while the others are looked up
                sums.left[length] -= 1
                found = combination(size - length)
                sums.left[length] += 1
                if not found:
                    break
                use((length, *found), sums.times((length, *found)))
    for length in range(size - 1, 0, -1):
        while sums.left[length]:
            bin_, gap = [length], size - length
            sums.left[length] -= 1
            while gap and (fits := np.flatnonzero(sums.left[: gap + 1])).size:
                best = int(fits[-1])
                n = min(gap // best, int(sums.left[best]))
                bin_ += [best] * n
                sums.left[best] -= n
                gap -= n * best
            for placed in bin_:
                sums.left[placed] += 1
            use(tuple(bin_), sums.times(tuple(bin_)))
    return made


class Places:
    """Sequence and offset of the i-th piece of a length, for arrays of pieces."""

    def __init__(self, patterns: list[Pattern]):
        starts, firsts, offsets = defaultdict(list), defaultdict(list), defaultdict(list)
        used: Counter = Counter()
        for p in patterns:
            offset = 0
            for length in p.lengths:
                starts[length].append(used[length])
                firsts[length].append(p.first)
                offsets[length].append(offset)
                used[length] += p.times
                offset += length
        self.of = {k: (starts[k], firsts[k], offsets[k]) for k in starts}

    def __call__(self, length: int, i: int) -> tuple[int, int]:
        starts, firsts, offsets = self.of[length]
        k = bisect_right(starts, i) - 1
        return firsts[k] + i - starts[k], offsets[k]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null text is empty, and still has the id that ends a document; an empty table has no pieces. Repeated rows are
    packed as often as they occur, equal lengths in the order of tasks. Other columns are not read.
    """
    cut = stage(pieces(docs, tokenizer, size))
    # rows: at most `size` lengths for each task of the reading
    counts = stage(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.join(
        counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"]
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("i"))
    # at most `size` rows come to the driver
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(totals, size)))
    schema = _parse_datatype_string(
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    out = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            lengths, numbers = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            found = [at(length, i) for length, i in zip(lengths, numbers, strict=True)]
            added = [pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)]
            kept = [batch.column(k).cast(out.field(k).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays(kept + added, schema=out)

    return numbered.mapInArrow(place, schema)
