"""Toxicity scores of texts that may be disguised: a noisy channel is undone first, then the restored text is scored.

A token with figures or signs among its letters, with a letter repeated, or spelled out letter by letter is a lattice:
each part of it may stand for itself, for a letter that it resembles, for fewer letters, or for nothing. The Viterbi
algorithm takes the cheapest path, by the cost of the channel and of the letters under a trigram model that is counted
over all documents. Words and beginnings of words that labelled toxic texts have and others lack then give the evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tallybook.llm.batches import Memo, add_columns, id_and_text, id_digest, slices, whole_text
from tallybook.sources.staging import stage

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
# bounds of the model: features kept, and the toxic texts that a feature must occur in
FEATURES, LEAST_TEXTS, LEAST_EVIDENCE = 50_000, 3, 12.0
BEGINNINGS = (4, 5, 6)
# costs of the channel, in nats: a sign for a letter, more letters than meant, a sign too many, a sign that parts words
# though a letter follows it
RESEMBLES, REPEATS, DROPS, PARTS_WORDS = 1.5, 1.0, 1.5, 1.5

# the letters of the model; 0 is everything else
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 1
_INDEX = np.zeros(257, np.int32)
_INDEX[[ord(c) for c in LETTERS]] = np.arange(1, SIZE)
_NUMBER = {c: i for i, c in enumerate(LETTERS, 1)}
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_LOOK = re.escape("".join(LOOKS))
_EDGE = ".,;:!?\"'()[]{}«»%*&#-_"
# letters beside what looks like letters, signs between letters, or three letters alike
_SUSPICIOUS = re.compile(rf"[^\W\d_][{_LOOK}]|[{_LOOK}][^\W\d_]|[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d]_+[^\W\d]|([^\W\d_])\1\1")
# three or more signs that stand alone
_SPELLED = re.compile(r"(?<!\S)\S(?:[^\S\n]\S(?!\S)){2,}")
_WORDS = re.compile(r"[^\W\d_]+")
# tokens that are one word and hide nothing: small letters, of which no three alike follow each other, and stops
_STOPS = ".,;:?"
_LETTERS, _ALIKE = "^[a-zß-öø-ÿ]+$", "|".join(c * 3 for c in LETTERS if c.isalpha())


def _cells(text: str) -> Iterator[np.ndarray]:
    """Numbers of the letter trigrams of a text, of which any character but a letter begins a new word."""
    lowered = text.lower()
    before = np.zeros(2, np.int32)
    for k in range(0, len(lowered), 1 << 20):
        codes = np.frombuffer(lowered[k : k + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([before, _INDEX[np.minimum(codes, 256)]])
        first, second, third = x[:-2], x[1:-1], x[2:]
        cells = (np.where(second == 0, 0, first) * SIZE + second) * SIZE + third
        yield cells[(second != 0) | (third != 0)]
        before = x[-2:]


def count_letters(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all documents; SIZE ** 3 cells, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in slices(batches):
            for cells in _cells(" ".join(batch.column(0).to_pylist()) + " "):
                total += np.bincount(cells, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    counted = docs.select(whole_text(docs).alias("text")).mapInArrow(run, "cell int, n long")
    counts = np.zeros(SIZE**3, np.int64)
    for row in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log of the probability of a letter after two others; longer contexts rest on shorter ones."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p = (one + 1) / (one.sum() + SIZE)
    p = (two + 4 * p) / (two.sum(axis=1, keepdims=True) + 4)
    p = (three + 4 * p) / (three.sum(axis=2, keepdims=True) + 4)
    return -np.log(p)


def lattice(token: str) -> list[list[tuple[int, str, float]]]:
    """For each place of a token, the ways on: next place, what is read (a space ends a word), cost of the channel."""
    ways: list[list[tuple[int, str, float]]] = []
    i = 0
    while i < len(token):
        c, end = token[i], i + 1
        while end < len(token) and token[end] == c:
            end += 1
        run = end - i
        ways.extend([] for _ in range(run))
        if c in _NUMBER:
            if run > 2:
                ways[i] += [(end, c, REPEATS), (end, 2 * c, REPEATS)]
            # the run as it stands, letter by letter, so that equal letters in other numbers stay what they are
            for k in range(i, end):
                ways[k].append((k + 1, c, 0.0))
        else:
            for look in LOOKS.get(c, ""):
                ways[i].append((end, look, RESEMBLES))
                if run > 1:
                    ways[i].append((end, look * 2, RESEMBLES))
            ways[i].append((end, " ", PARTS_WORDS if c in LOOKS and token[end : end + 1] in _NUMBER else 0.0))
            if not c.isalnum():
                ways[i].append((end, "", DROPS * (1 if c.isspace() else min(run, 2))))
        i = end
    return ways


class Decoder:
    """The most likely reading of a token, by the channel and the letter model."""

    def __init__(self, costs: np.ndarray):
        self.costs = [[row.tolist() for row in plane] for plane in costs]

    def read(self, token: str) -> list[str]:
        """Words on the cheapest path through the lattice; ties go to the alphabetically first reading of a state."""
        ways, costs, last = lattice(token), self.costs, len(token)
        # for each place the states (last two letters), each with its cost and the way back
        states: list[dict] = [{} for _ in range(last + 1)]
        states[0][0, 0] = (0.0, "", None)
        for i in range(last):
            for context, (cost, *_) in states[i].items():
                for to, read, price in ways[i]:
                    (a, b), total = context, cost + price
                    for c in read:
                        k = _NUMBER.get(c, 0)
                        if not b:
                            a = 0
                        if k or b:
                            total += costs[a][b][k]
                        a, b = b, k
                    known = states[to].get((a, b))
                    if known is None or (total, read) < known[:2]:
                        states[to][a, b] = (total, read, (i, context))
        ends = [
            (cost + (costs[a if b else 0][b][0] if b else 0.0), (a, b)) for (a, b), (cost, *_) in states[last].items()
        ]
        pieces, at = [], (last, min(ends)[1])
        while at is not None:
            _, read, before = states[at[0]][at[1]]
            pieces.append(read)
            at = before
        return "".join(reversed(pieces)).split()


class Reader:
    """Restored words of tokens and texts."""

    def __init__(self, costs: np.ndarray):
        self.decoder = Decoder(costs)

    def words(self, token: str) -> list[str]:
        """Lower-case words of a token, read through the channel where it looks disguised."""
        lowered = token.lower()
        inner = lowered.strip(_EDGE)
        if _SUSPICIOUS.search(inner) or (len(inner) < len(lowered) and _SUSPICIOUS.search(lowered.rstrip("!"))):
            return self.decoder.read(lowered)
        return _WORDS.findall(lowered)

    def spelled(self, text: str) -> list[str]:
        """Words of the passages that are spelled out letter by letter."""
        return [w for m in _SPELLED.finditer(text) for w in self.decoder.read(m.group().lower())]

    def restore(self, text: str) -> str:
        """The text with disguised tokens and passages as they are read; all else stays as it is."""
        pieces, at = [], 0
        for m in _SPELLED.finditer(text):
            pieces += [text[at : m.start()], " ".join(self.decoder.read(m.group().lower()))]
            at = m.end()
        rest = "".join([*pieces, text[at:]])

        def read(m: re.Match) -> str:
            token = m.group()
            found = self.words(token)
            return token if found == _WORDS.findall(token.lower()) else " ".join(found)

        return re.sub(r"\S+", read, rest)


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which end with a star."""
    return (word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k))


def _costs_of(docs: DataFrame) -> np.ndarray:
    """Letter costs of a table; its size is SIZE ** 3 numbers."""
    return letter_costs(count_letters(docs)).astype(np.float32)


def restore_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, restored for every row: the text as the channel is undone.

    Null text is empty. The letter model counts all rows; an empty table gives no rows. Other columns are not read.
    """
    costs = docs.sparkSession.sparkContext.broadcast(_costs_of(docs))

    def make():
        reader = Reader(costs.value)
        return lambda texts: [list(map(reader.restore, texts))]

    return add_columns(id_and_text(docs), make, "restored string", ["doc_id", "text"])


class Tokens:
    """What is known of distinct tokens: here the features, or the evidence, of their words. Bounded by count and length."""

    def __init__(self, reader: Reader, of_word, limit: int = 300_000):
        self.reader = reader

        def value(token: str):
            return [v for w in reader.words(token) for v in of_word(w)]

        self.of_word = of_word
        self.known = Memo(lambda tokens: list(map(value, tokens)), limit=limit)

    def __call__(self, text: str) -> Iterator:
        """Lists of values, one for each distinct token and for the words that are spelled out."""
        tokens = set(text.split())
        self.known.learn(tokens)
        yield from map(self.known.__getitem__, tokens)
        if _SPELLED.search(text):
            yield [v for w in self.reader.spelled(text) for v in self.of_word(w)]


def _feature_counts(training: DataFrame, costs) -> DataFrame:
    """feature, toxic, clean: in how many texts of each label a feature occurs."""
    schema = _parse_datatype_string("feature string, toxic long, clean long")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_token = Tokens(Reader(costs.value), features)
        # texts of both labels in one number
        counts: dict[str, int] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            rows = [(f, n >> 32, n & 0xFFFFFFFF) for f, n in counts.items()]
            for k in range(0, len(rows), 50_000):
                some = zip(*rows[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(some, out, strict=True)], schema=out)
            counts.clear()

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = 1 << 32 if toxic else 1
                for f in set().union(*of_token(text)):
                    counts[f] = counts.get(f, 0) + one
            if len(counts) > 600_000:
                yield from passed_on()
        yield from passed_on()

    counted = training.select("text", "toxic").mapInArrow(run, schema)
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass(frozen=True)
class Model:
    """Letter costs, evidence by feature, and the curve from evidence to score; bounded by SIZE and FEATURES."""

    costs: np.ndarray
    evidence: dict[str, float]
    slope: float
    offset: float

    def of_word(self, word: str) -> list[tuple[str, float]]:
        """The strongest feature of a word with its evidence, or nothing."""
        found = max(((self.evidence.get(f, 0.0), f) for f in features(word)), default=(0.0, ""))
        return [found[::-1]] if found[0] > 0 else []

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def _strongest(values: Iterable) -> float:
    """The sum of the two strongest pieces of evidence of a text."""
    found = {f: e for value in values for f, e in value}
    return float(sum(sorted(found.values(), reverse=True)[:2]))


class Evidence:
    """The strongest evidence of texts, whose distinct tokens are looked up once for all of them."""

    def __init__(self, model: Model):
        self.model, self.tokens = model, Tokens(Reader(model.costs), model.of_word)
        self.whole = pa.array([f for f in model.evidence if not f.endswith("*")], pa.large_string())
        self.beginnings = {
            k: pa.array([f[:k] for f in model.evidence if f.endswith("*") and len(f) == k + 1], pa.large_string()) for k in BEGINNINGS
        }

    def _values(self, tokens: pa.Array) -> tuple[list[int], list[list]]:
        """The tokens that have evidence, and what they have."""
        stems = pc.utf8_rtrim(tokens, _STOPS)
        plain = pc.and_not(pc.match_substring_regex(stems, _LETTERS), pc.match_substring_regex(stems, _ALIKE))
        met = pc.is_in(stems, self.whole)
        for k, known in self.beginnings.items():
            met = pc.or_(met, pc.is_in(pc.utf8_slice_codeunits(stems, 0, k), known))
        plain, met = np.array(plain, bool), np.array(met, bool)
        at, other = np.flatnonzero(plain & met), np.flatnonzero(~plain)
        found = list(map(self.model.of_word, stems.take(pa.array(at)).to_pylist()))
        read = tokens.take(pa.array(other)).to_pylist()
        self.tokens.known.learn(read)
        found += map(self.tokens.known.__getitem__, read)
        some = [(i, v) for i, v in zip(np.append(at, other).tolist(), found, strict=True) if v]
        return [i for i, _ in some], [v for _, v in some]

    def __call__(self, texts: list[str]) -> list[float]:
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        tokens = split.flatten().dictionary_encode()
        at, values = self._values(tokens.dictionary)
        number = np.full(len(tokens.dictionary), -1)
        number[at] = np.arange(len(at))
        met = number[np.asarray(tokens.indices)]
        places = np.flatnonzero(met >= 0)
        of_text: dict[int, list] = {}
        for text, k in zip((np.searchsorted(np.asarray(split.offsets), places, "right") - 1).tolist(), met[places].tolist(), strict=True):
            of_text.setdefault(text, []).append(values[k])
        for i, text in enumerate(texts):
            if _SPELLED.search(text):
                words = self.tokens.reader.spelled(text)
                of_text.setdefault(i, []).append([v for w in words for v in self.model.of_word(w)])
        return [_strongest(of_text.get(i, ())) for i in range(len(texts))]


def _evidence(rows: DataFrame, model, keep: str) -> DataFrame:
    def make():
        of_texts = Evidence(model.value)
        return lambda texts: [of_texts(texts)]

    return add_columns(rows, make, "evidence double", [keep])


def _logistic(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a weak pull that keeps separable classes finite."""
    w = np.zeros(2)
    columns = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ w, -30, 30)))
        pull = np.array([0.1, 0.01])
        slope = columns.T @ (toxic - n * p) - pull * w
        step = np.linalg.solve((columns * (n * p * (1 - p))[:, None]).T @ columns + np.diag(pull), slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, training: DataFrame) -> Model:
    """From rows (text, toxic, calibration): features are counted on some, the curve is fitted on the others."""
    spark = docs.sparkSession
    costs = _costs_of(docs)
    shared = spark.sparkContext.broadcast(costs)
    by_part = training.groupBy("calibration").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    seen = {r["calibration"]: (r["n"], r["toxic"]) for r in by_part.collect()}
    n, toxic = seen.get(False, (0, 0))
    clean = n - toxic
    rate = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)

    def part(k, total, share):
        return F.when(k > 0, k * F.ln(k / (total * share))).otherwise(0.0)

    both = F.col("toxic") + F.col("clean")
    # twice the log-likelihood gained by a rate of its own for toxic texts
    gain = 2 * (part(F.col("toxic"), both, toxic / max(n, 1)) + part(F.col("clean"), both, clean / max(n, 1)))
    chosen = (
        _feature_counts(training.filter("NOT calibration"), shared)
        .filter(F.col("toxic") >= LEAST_TEXTS)
        .select("feature", F.ln(rate[0] / rate[1]).alias("evidence"), gain.alias("gain"))
        .filter((F.col("evidence") > 0) & (F.col("gain") >= LEAST_EVIDENCE))
        .orderBy(F.desc("gain"), "feature")
        .limit(FEATURES)
    )
    evidence = {r["feature"]: r["evidence"] for r in chosen.collect()} if toxic and clean else {}
    prior = math.log((sum(t for _, t in seen.values()) + 0.5) / (sum(n - t for n, t in seen.values()) + 0.5))
    plain = Model(costs, evidence, 1.0, prior)
    n, toxic = seen.get(True, (0, 0))
    if not evidence or not 0 < toxic < n:
        return plain
    measured = _evidence(training.filter("calibration"), spark.sparkContext.broadcast(plain), "toxic")
    # quarters of a nat: evidence is at most twice the logarithm of the number of texts
    bins = (
        measured.groupBy(F.round(F.col("evidence") * 4).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
        .collect()
    )
    x, n, y = (np.array([r[k] for r in bins], float) for k in ("bin", "n", "toxic"))
    return Model(costs, evidence, *_logistic(x / 4, n, y))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of the documents.

    Null texts are scored as empty ones, which have no evidence. A doc_id with several labels is toxic if half of them
    or more say so; null labels and ids give none; equal labelled texts train once. Without a label the score is 0.5,
    without toxic ones the share that add-half smoothing leaves. A null id counts as empty text in the split. Only
    doc_id and text are read from the documents, only doc_id and toxic from the labels.
    """
    rows = id_and_text(docs)
    fold = id_digest(F.col("doc_id")) % FOLDS
    target = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).alias("toxic"))
        .filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
    )
    labelled = rows.filter(fold != HELD_OUT).join(target, "doc_id")
    # copies would count their rare words as often as they occur: digests choose one of them
    digests = labelled.select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"), (fold == CALIBRATION).alias("c"))
    firsts = digests.groupBy("h", "m", "c").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    training = stage(
        labelled.join(firsts, "doc_id", "left_semi").select("text", "toxic", (fold == CALIBRATION).alias("calibration"))
    )
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, training))
    m = model.value
    scored = _evidence(rows, model, "doc_id")
    exponent = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("evidence") * m.slope + m.offset))
    score = 1 / (1 + F.exp(-exponent))
    return scored.select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
