"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic steps.

A random projection with cosines approximates a Gaussian kernel over the standardised statistics. Every task sums
its share of the normal equations, Spark adds the shares, and the driver solves one small system. Training scores,
counted in a fixed number of bins, give a rising calibration curve.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.batches import add_columns, id_and_text, id_digest
from tallybook.llm.quality_rules import STOP_WORDS, SYMBOLS
from tallybook.sources.staging import stage

FOLDS, HELD_OUT = 3, 1
COSINES = 96
WIDTH = 3.0
RIDGE = 1.0
BINS = 512
CLIP = 6.0
STATISTICS = (
    "log_words word_length distinct stop_words symbols bars marks capitals digits letters duplicate_lines "
    "stutter triples line_length commonest compressed"
).split()


def _statistics():
    stop = frozenset(w for words in STOP_WORDS.values() for w in words)

    def measure(text: str) -> list[float]:
        words, chars = text.split(), max(1, len(text))
        n = max(1, len(words))
        lines = [line for line in text.split("\n") if line.strip()]
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        triples = set(zip(words, words[1:], words[2:], strict=False))
        squeezed = text.replace(" ", "")
        return [
            math.log1p(len(words)),
            len(squeezed) / n,
            min(1.0, len(counts) / min(n, 200)),
            sum(counts[w] for w in stop.intersection(counts)) / n,
            sum(map(text.count, SYMBOLS)) / n,
            text.count("|") / n,
            (text.count("!") + text.count("?")) / n,
            sum(map(str.isupper, words)) / n,
            sum(map(text.count, "0123456789")) / chars,
            sum(map(str.isalpha, words)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            sum(map(str.__eq__, words, words[1:])) / n,
            1 - len(triples) / max(1, len(words) - 2),
            math.log1p(len(text) / max(1, len(lines))),
            max(counts.values(), default=0) / n,
            len(zlib.compress(text.encode(), 1)) / chars,
        ]

    return lambda texts: [list(map(measure, texts))]


@dataclass(frozen=True)
class Model:
    """All that scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    spread: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, statistics: np.ndarray) -> np.ndarray:
        x = np.clip((statistics - self.mean) / self.spread, -CLIP, CLIP)
        cosines = np.cos(x @ self.projection + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(x), 1)), cosines])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        raw = self.raw(statistics)
        # a trace of the raw score orders texts on the same step of the curve
        return 0.999 * np.interp(raw, *self.curve) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))


def isotonic(at: np.ndarray, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to the targets: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for w, y in zip(weight, target, strict=True):
        pools.append([w, y, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, y2, n2 = pools.pop()
            w1, y1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * y1 + w2 * y2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), y) for _, y, n in pools])


def _statistics_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("statistics"))
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def _scored(df: DataFrame, model: Model, value: str, calibrated: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            scores = (m.score if calibrated else m.raw)(_statistics_of(batch))
            kept = batch.column(batch.schema.get_field_index(value))
            yield pa.RecordBatch.from_arrays([kept, pa.array(scores)], names=[value, "score"])

    return df.select(value, "statistics").mapInArrow(run, f"{value} {df.schema[value].dataType.simpleString()}, score double")


def fit(training: DataFrame) -> Model:
    """From rows (statistics, target); without targets the scores are 0.5, with equal ones that target."""
    d = len(STATISTICS)
    moments = training.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.get("statistics", F.lit(i))).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.get("statistics", F.lit(i))).alias(f"s{i}") for i in range(d)],
    ).first()
    random = np.random.default_rng(7)
    projection = random.normal(size=(d, COSINES)) / WIDTH
    phase = random.uniform(0, 2 * math.pi, COSINES)
    if not moments["n"]:
        return Model(np.zeros(d), np.ones(d), projection, phase, np.zeros(COSINES + 1), (np.zeros(1), np.full(1, 0.5)))
    mean = np.array([moments[f"m{i}"] for i in range(d)])
    spread = np.array([moments[f"s{i}"] or 1.0 for i in range(d)])
    blank = Model(mean, spread, projection, phase, np.zeros(COSINES + 1), (np.zeros(1), np.zeros(1)))
    size = COSINES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = blank.features(_statistics_of(batch))
            y = np.asarray(batch.column(batch.schema.get_field_index("target")))
            total += x.T @ np.column_stack([x, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"]
        )

    shares = training.mapInArrow(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    system = np.zeros((size, size + 1))
    for r in shares.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        system[r["i"], r["j"]] = r["v"]
    penalty = np.diag([0.0] + [RIDGE] * COSINES)
    weights = np.linalg.solve(system[:, :size] + penalty + 1e-9 * np.eye(size), system[:, size])
    ridge = Model(mean, spread, projection, phase, weights, blank.curve)
    low, high = -0.5, 1.5
    step = (high - low) / BINS
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") - low) / step)))
    counted = (
        _scored(training, ridge, "target", calibrated=False)
        .groupBy(bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("y"), F.avg("score").alias("x"))
        .orderBy("bin")
        .collect()
    )
    x, n, y = (np.array([r[k] for r in counted], float) for k in ("x", "n", "y"))
    return Model(mean, spread, projection, phase, weights, (x, isotonic(x, n, y)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of the documents.

    Null texts are scored as empty ones. Labels are averaged per doc_id, null labels and ids give none; repeated
    documents count as often as they occur. A null id counts as empty text in the split. Only doc_id and text are
    read from the documents, only doc_id and quality from the labels.
    """
    measured = stage(add_columns(id_and_text(docs), _statistics, "statistics array<double>", ["doc_id"]))
    target = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("target"))
        .filter("target IS NOT NULL AND doc_id IS NOT NULL")
    )
    held_out = id_digest(F.col("doc_id")) % FOLDS == HELD_OUT
    training = stage(measured.filter(~held_out).join(target, "doc_id").select("statistics", "target"))
    scores = _scored(measured, fit(training), "doc_id", calibrated=True)
    return scores.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
