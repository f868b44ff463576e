"""Penalised maximum likelihood of the BG/NBD and Gamma-Gamma models.

Spark does the work that grows with the data: customers with equal inputs are merged once, the
merged table is kept, and each step sums the log-likelihood with its first and second derivatives in
one aggregate. Only those sums (at most 15 numbers) come to the driver, which takes a damped Newton
step in the logarithms of the parameters. A step that leads uphill is shortened by one more aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.clv import (
    BgNbd,
    GammaGamma,
    bgnbd_derivatives,
    bgnbd_log_likelihood,
    gamma_gamma_derivatives,
    gamma_gamma_log_likelihood,
)

# Fixed value: weight of the squared parameters in the objective
PENALTY = 0.01
# Fixed value: times are scaled so that the longest is 10 while fitting
SCALED_T = 10.0


# largest slope of the mean log-likelihood, by the logarithm of a parameter, at which a fit ends
AT_REST = 1e-9


def _objective(weighted: DataFrame, expand: Callable[[np.ndarray], dict[str, float]], likelihood, penalty: float):
    """Function from a list of log-parameter vectors to their objective values, by one Spark job."""
    names = list(expand(np.ones(4)))
    mean = F.sum(likelihood({n: F.col(n) for n in names}) * F.col("w")) / F.sum("w")

    def struct(i: int, point: np.ndarray) -> str:
        values = [f"CAST({value!r} AS DOUBLE) AS {name}" for name, value in expand(np.exp(point)).items()]
        return f"struct({i} AS id, {', '.join(values)})"

    def evaluate(points: list[np.ndarray]) -> np.ndarray:
        candidates = ", ".join(struct(i, point) for i, point in enumerate(points))
        sums = weighted.selectExpr("*", f"inline(array({candidates}))").groupBy("id").agg(mean.alias("mean")).collect()
        means = np.full(len(points), -math.inf)
        for row in sums:
            if row["mean"] is not None and math.isfinite(row["mean"]):
                means[row["id"]] = row["mean"]
        return -means + penalty * np.array([float(np.sum(np.exp(2 * point))) for point in points])

    return evaluate


def _slopes(weighted: DataFrame, expand: Callable[[np.ndarray], dict[str, float]], likelihood, derivatives, penalty: float):
    """Function from log parameters to the objective, its gradient and its curvature, by one Spark job."""
    names = list(expand(np.ones(4)))
    p = {n: F.col(n) for n in names}
    first, second = derivatives(p)
    place = {n: i for i, n in enumerate(first)}

    def mean(value, name: str):
        return (F.sum(value * F.col("w")) / F.sum("w")).alias(name)

    sums = [mean(likelihood(p), "value"), *(mean(c, f"d_{n}") for n, c in first.items())]
    sums += [mean(c, f"d_{n}_{o}") for (n, o), c in second.items()]

    def evaluate(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        theta, d = np.exp(point), len(place)
        values = [f"CAST({value!r} AS DOUBLE) AS {name}" for name, value in expand(theta).items()]
        row = weighted.selectExpr("*", f"inline(array(struct({', '.join(values)})))").agg(*sums).first()
        gradient, curvature = np.zeros(d), np.zeros((d, d))
        if any(v is None or not math.isfinite(v) for v in row):
            return math.inf, gradient, curvature
        for n, i in place.items():
            gradient[i] = row[f"d_{n}"]
        for n, o in second:
            i, j = place[n], place[o]
            curvature[i, j] = curvature[j, i] = row[f"d_{n}_{o}"]
        # by the logarithms of the parameters
        curvature = curvature * np.outer(theta, theta) + np.diag(theta * gradient)
        return (
            -row["value"] + penalty * float(np.sum(theta**2)),
            -theta * gradient + 2 * penalty * theta**2,
            -curvature + np.diag(4 * penalty * theta**2),
        )

    return evaluate


def _downhill(gradient: np.ndarray, curvature: np.ndarray, flattest: float) -> np.ndarray:
    """Newton's step; directions of negative curvature are turned downhill, and no logarithm moves by more than 2."""
    values, vectors = np.linalg.eigh(curvature)
    step = -vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), flattest))
    longest = np.max(np.abs(step))
    return step * (2 / longest) if longest > 2 else step


def newton(problem: _Problem, start: np.ndarray, rounds: int = 100, at_rest: float = AT_REST) -> np.ndarray:
    """Newton's method on exact derivatives, one job a step unless the step leads uphill.

    It ends where no slope exceeds `at_rest` or where double precision shows no way down, and raises when that takes
    more than `rounds`.
    """
    here = start
    value, gradient, curvature = problem.slopes(here)
    for _ in range(rounds):
        if np.max(np.abs(gradient)) <= at_rest:
            return here
        step = _downhill(gradient, curvature, 1e-12)
        after = problem.slopes(here + step)
        if not after[0] < value:
            tries = [step * s for s in (0.5, 0.25, 0.1, 0.03, 0.01)]
            tried = problem.evaluate([here + s for s in tries])
            best = int(np.argmin(tried))
            if not tried[best] < value:
                return here
            step = tries[best]
            after = problem.slopes(here + step)
        here = here + step
        value, gradient, curvature = after
    raise ArithmeticError(f"the likelihood is still rising after {rounds} rounds")


def minimise(
    evaluate: Callable[[list[np.ndarray]], np.ndarray], start: np.ndarray, rounds: int = 100, tolerance: float = 1e-7
) -> np.ndarray:
    """Newton's method with finite differences, for objectives without derivatives.

    Directions of negative curvature are turned downhill. It ends where no step lowers the objective by `tolerance`, and raises when that takes more than `rounds`.
    """
    d, h = len(start), 1e-3
    unit = np.eye(d) * h
    here = start
    for _ in range(rounds):
        mixed = [(i, j) for i in range(d) for j in range(i + 1, d)]
        points = [here, *(here + u for u in unit), *(here - u for u in unit)]
        points += [here + unit[i] + unit[j] for i, j in mixed]
        f = evaluate(points)
        ahead, behind = f[1 : d + 1], f[d + 1 : 2 * d + 1]
        gradient = (ahead - behind) / (2 * h)
        curvature = np.diag((ahead - 2 * f[0] + behind) / h**2)
        for (i, j), both in zip(mixed, f[2 * d + 1 :]):
            curvature[i, j] = curvature[j, i] = (both - ahead[i] - ahead[j] + f[0]) / h**2
        step = _downhill(gradient, curvature, 1e-6)
        tries = [here + step * s for s in (2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01)]
        tried = evaluate(tries)
        best = int(np.argmin(tried))
        gain = f[0] - tried[best]
        if not gain > 0:
            return here
        here = tries[best]
        if gain < tolerance:
            return here
    raise ArithmeticError(f"the likelihood is still rising after {rounds} rounds")


class _Problem:
    """Merged customers, kept while the block lasts, and the objective over vectors of log parameters.

    `jobs` counts the aggregates taken over the customers.
    """

    def __init__(self, weighted: DataFrame, expand, likelihood, derivatives, penalty: float):
        self.weighted = weighted.persist(StorageLevel.MEMORY_AND_DISK)
        self.jobs = 0
        self.evaluate = self._counted(_objective(self.weighted, expand, likelihood, penalty))
        self.slopes = self._counted(_slopes(self.weighted, expand, likelihood, derivatives, penalty))

    def _counted(self, evaluate: Callable) -> Callable:
        def run(where):
            self.jobs += 1
            return evaluate(where)

        return run

    def __enter__(self) -> _Problem:
        return self

    def __exit__(self, *_) -> None:
        self.weighted.unpersist()


def _bgnbd(inputs: DataFrame, penalty: float) -> tuple[_Problem, float]:
    """The problem in scaled time, and the scale."""
    longest = inputs.agg(F.max("ModelT")).first()[0]
    scale = SCALED_T / longest if longest else 1.0
    weighted = (
        inputs.groupBy("Repeats", "ModelRecency", "ModelT")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
        .select(
            F.col("Repeats").cast("double").alias("x"),
            (F.col("ModelRecency") * scale).alias("t_x"),
            (F.col("ModelT") * scale).alias("t"),
            "w",
        )
    )

    def expand(theta: np.ndarray) -> dict[str, float]:
        r, alpha, a, b = (float(v) for v in theta[:4])
        gammas = {"lg_r": math.lgamma(r), "lg_ab": math.lgamma(a + b), "lg_b": math.lgamma(b)}
        return {"r": r, "alpha": alpha, "a": a, "b": b, **gammas}

    def likelihood(p):
        return bgnbd_log_likelihood(F.col("x"), F.col("t_x"), F.col("t"), p)

    def derivatives(p):
        return bgnbd_derivatives(F.col("x"), F.col("t_x"), F.col("t"), p)

    return _Problem(weighted, expand, likelihood, derivatives, penalty), scale


def _gamma_gamma(inputs: DataFrame, penalty: float) -> _Problem:
    weighted = (
        inputs.filter((F.col("Repeats") > 0) & (F.col("OrderValue") > 0))
        .groupBy(F.col("Repeats").cast("double").alias("x"), F.col("OrderValue").alias("m"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )

    def expand(theta: np.ndarray) -> dict[str, float]:
        p, q, v = (float(t) for t in theta[:3])
        return {"p": p, "q": q, "v": v, "lg_q": math.lgamma(q)}

    def likelihood(p):
        return gamma_gamma_log_likelihood(F.col("x"), F.col("m"), p)

    def derivatives(p):
        return gamma_gamma_derivatives(F.col("x"), F.col("m"), p)

    return _Problem(weighted, expand, likelihood, derivatives, penalty)


def fit_bgnbd(inputs: DataFrame, penalty: float = PENALTY) -> BgNbd:
    """Parameters from the columns Repeats, ModelRecency and ModelT."""
    problem, scale = _bgnbd(inputs, penalty)
    with problem:
        r, alpha, a, b = (float(v) for v in np.exp(newton(problem, np.zeros(4))))
    return BgNbd(r, alpha / scale, a, b)


def fit_gamma_gamma(inputs: DataFrame, penalty: float = PENALTY) -> GammaGamma:
    """Parameters from the columns Repeats and OrderValue of customers who spent."""
    with _gamma_gamma(inputs, penalty) as problem:
        return GammaGamma(*(float(v) for v in np.exp(newton(problem, np.zeros(3)))))


def bgnbd_objectives(inputs: DataFrame, models: list[BgNbd], penalty: float = PENALTY) -> list[float]:
    """What the fit minimises, at given parameters."""
    problem, scale = _bgnbd(inputs, penalty)
    with problem:
        return problem.evaluate([np.log([m.r, m.alpha * scale, m.a, m.b]) for m in models]).tolist()


def gamma_gamma_objectives(inputs: DataFrame, models: list[GammaGamma], penalty: float = PENALTY) -> list[float]:
    """What the fit minimises, at given parameters."""
    with _gamma_gamma(inputs, penalty) as problem:
        return problem.evaluate([np.log(list(m)) for m in models]).tolist()


def bgnbd_slopes(inputs: DataFrame, model: BgNbd, penalty: float = PENALTY) -> tuple[float, np.ndarray, np.ndarray]:
    """The objective at given parameters, its gradient and its curvature by their logarithms."""
    problem, scale = _bgnbd(inputs, penalty)
    with problem:
        return problem.slopes(np.log([model.r, model.alpha * scale, model.a, model.b]))


def gamma_gamma_slopes(inputs: DataFrame, model: GammaGamma, penalty: float = PENALTY) -> tuple[float, np.ndarray, np.ndarray]:
    """The objective at given parameters, its gradient and its curvature by their logarithms."""
    with _gamma_gamma(inputs, penalty) as problem:
        return problem.slopes(np.log(list(model)))
