"""Customer lifetime value: summaries, BG/NBD and Gamma-Gamma predictions, segments.

BG/NBD: Fader, Hardie, Lee (2005), "Counting Your Customers" the Easy Way. Gamma-Gamma: Fader,
Hardie (2013), The Gamma-Gamma Model of Monetary Value. Their inputs are the number of repeat orders
(Repeats, x), the days from the first to the last order (ModelRecency, t_x), the days from the first
order to the end of the log (ModelT, t) and the revenue per order (OrderValue, m).
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.constants import CLV_LABELS
from tallybook.functions.expressions import digamma, ln_gamma, money, ratio, trigamma, whole_days
from tallybook.functions.quantiles import exact_quantiles
from tallybook.sources.staging import stage


class BgNbd(NamedTuple):
    r: float
    alpha: float
    a: float
    b: float


class GammaGamma(NamedTuple):
    p: float
    q: float
    v: float


def customer_base(tx: DataFrame) -> DataFrame:
    """One row per customer.

    Recency is days since the last purchase and T the days from first to last purchase plus one;
    the models use ModelRecency (first to last) and ModelT (first to the end of the log) instead,
    which is how they define these inputs. The log is read once: it ends at the latest of the
    customers' last dates.
    """
    per_customer = stage(
        tx.groupBy("CustomerID").agg(
            F.min("InvoiceDate").alias("First"),
            F.max("InvoiceDate").alias("Last"),
            F.count_distinct("InvoiceNo").alias("Frequency"),
            money(F.sum("TotalPrice")).alias("MonetaryValue"),
            F.count("TotalPrice").alias("LineCount"),
            ratio(F.sum("TotalPrice"), F.count("TotalPrice")).alias("AvgOrderValue"),
        )
    )
    first, last, end = F.col("First"), F.col("Last"), F.col("End")
    return per_customer.withColumn("End", per_customer.agg(F.max("Last")).scalar()).select(
        "CustomerID",
        whole_days(end, last).alias("Recency"),
        "Frequency",
        "MonetaryValue",
        "LineCount",
        "AvgOrderValue",
        (whole_days(last, first) + 1).alias("T"),
        whole_days(last, first).alias("ModelRecency"),
        whole_days(end, first).alias("ModelT"),
    )


def repeat_customers(base: DataFrame) -> DataFrame:
    return base.filter(F.col("Frequency") > 1)


def enough_repeat_customers(base: DataFrame, more_than: int = 10) -> bool:
    """Whether the models can be fitted."""
    return repeat_customers(base).count() > more_than


def model_inputs(base: DataFrame) -> DataFrame:
    """Repeat customers with the two other model inputs: orders after the first and revenue per order."""
    return repeat_customers(base).select(
        "*",
        (F.col("Frequency") - 1).alias("Repeats"),
        ratio(F.col("MonetaryValue"), F.col("Frequency")).alias("OrderValue"),
    )


# ---- BG/NBD and Gamma-Gamma as column expressions -------------------------------------------


def bgnbd_log_likelihood(x: Column, t_x: Column, t: Column, p: dict[str, Column]) -> Column:
    """Log-likelihood of one customer. `p` also holds ln-gamma of the pure parameters (see `plans`)."""
    r, alpha, a, b = p["r"], p["alpha"], p["a"], p["b"]
    counts = (
        ln_gamma(r + x) - p["lg_r"] + r * F.ln(alpha) + p["lg_ab"] + ln_gamma(b + x) - p["lg_b"] - ln_gamma(a + b + x)
    )
    alive = -(r + x) * F.ln(alpha + t)
    gone = F.ln(a) - F.ln(F.greatest(b + x - 1, F.lit(1e-300))) - (r + x) * F.ln(alpha + t_x)
    top = F.greatest(alive, gone)
    either = top + F.ln(F.exp(alive - top) + F.exp(gone - top))
    return counts + F.when(x > 0, either).otherwise(alive)


def gamma_gamma_log_likelihood(x: Column, m: Column, p: dict[str, Column]) -> Column:
    shape, q, v = p["p"], p["q"], p["v"]
    px = shape * x
    return (
        ln_gamma(px + q)
        - ln_gamma(px)
        - p["lg_q"]
        + q * F.ln(v)
        + (px - 1) * F.ln(m)
        + px * F.ln(x)
        - (px + q) * F.ln(v + m * x)
    )


Derivatives = tuple[dict[str, Column], dict[tuple[str, str], Column]]


def bgnbd_derivatives(x: Column, t_x: Column, t: Column, p: dict[str, Column]) -> Derivatives:
    """First and second derivatives of `bgnbd_log_likelihood` by the parameters; pairs that are missing are 0."""
    r, alpha, a, b = p["r"], p["alpha"], p["a"], p["b"]
    alive = -(r + x) * F.ln(alpha + t)
    gone = F.ln(a) - F.ln(F.greatest(b + x - 1, F.lit(1e-300))) - (r + x) * F.ln(alpha + t_x)
    # the share of the customer's likelihood that falls to having gone, and to being alive
    g = F.when(x > 0, 1 / (1 + F.exp(alive - gone))).otherwise(0.0)
    s = 1 - g
    left = F.when(x > 0, F.greatest(b + x - 1, F.lit(1e-150))).otherwise(1.0)
    of_alive = {"r": -F.ln(alpha + t), "alpha": -(r + x) / (alpha + t)}
    of_gone = {"r": -F.ln(alpha + t_x), "alpha": -(r + x) / (alpha + t_x), "a": 1 / a, "b": -1 / left}
    second_alive = {("r", "alpha"): -1 / (alpha + t), ("alpha", "alpha"): (r + x) / ((alpha + t) * (alpha + t))}
    second_gone = {
        ("r", "alpha"): -1 / (alpha + t_x),
        ("alpha", "alpha"): (r + x) / ((alpha + t_x) * (alpha + t_x)),
        ("a", "a"): -1 / (a * a),
        ("b", "b"): 1 / (left * left),
    }
    all_of = digamma(a + b) - digamma(a + b + x)
    curve = trigamma(a + b) - trigamma(a + b + x)
    first = {
        "r": digamma(r + x) - digamma(r) + F.ln(alpha),
        "alpha": r / alpha,
        "a": all_of,
        "b": all_of + digamma(b + x) - digamma(b),
    }
    second = {
        ("r", "r"): trigamma(r + x) - trigamma(r),
        ("r", "alpha"): 1 / alpha,
        ("alpha", "alpha"): -r / (alpha * alpha),
        ("a", "a"): curve,
        ("a", "b"): curve,
        ("b", "b"): curve + trigamma(b + x) - trigamma(b),
    }
    zero = F.lit(0.0)
    names = list(first)
    apart = {n: of_gone[n] - of_alive.get(n, zero) for n in names}
    for i, n in enumerate(names):
        first[n] = first[n] + s * of_alive.get(n, zero) + g * of_gone[n]
        for o in names[i:]:
            mixed = s * second_alive.get((n, o), zero) + g * second_gone.get((n, o), zero) + s * g * apart[n] * apart[o]
            second[n, o] = second.get((n, o), zero) + mixed
    return first, second


def gamma_gamma_derivatives(x: Column, m: Column, p: dict[str, Column]) -> Derivatives:
    """First and second derivatives of `gamma_gamma_log_likelihood` by the parameters."""
    shape, q, v = p["p"], p["q"], p["v"]
    px, total = shape * x, v + m * x
    first = {
        "p": x * (digamma(px + q) - digamma(px) + F.ln(m) + F.ln(x) - F.ln(total)),
        "q": digamma(px + q) - digamma(q) + F.ln(v) - F.ln(total),
        "v": q / v - (px + q) / total,
    }
    second = {
        ("p", "p"): x * x * (trigamma(px + q) - trigamma(px)),
        ("p", "q"): x * trigamma(px + q),
        ("p", "v"): -x / total,
        ("q", "q"): trigamma(px + q) - trigamma(q),
        ("q", "v"): 1 / v - 1 / total,
        ("v", "v"): -q / (v * v) + (px + q) / (total * total),
    }
    return first, second


def probability_alive(x: Column, t_x: Column, t: Column, model: BgNbd) -> Column:
    r, alpha, a, b = model
    odds = F.lit(a) / (x + (b - 1)) * F.pow((t + alpha) / (t_x + alpha), x + r)
    return F.when(x > 0, 1 / (1 + odds)).otherwise(1.0)


# a series this long means parameters beyond double precision: an error, never a truncated value
MOST_TERMS = 20_000_000


def expected_purchases(days: list[float], weights: list[float], x: Column, t_x: Column, t: Column, model: BgNbd) -> Column:
    """Weighted sum of the expected number of orders within each of `days` from the end of the log.

    The published form holds (1 - (1-z)^(r+x) 2F1(r+x, b+x; c; z)) / (a - 1) with
    z = days / (alpha + T + days). Euler's transformation turns it into
    (1 - (1-z)^(a-1) 2F1(a+b-1-r, a-1; c; z)) / (a - 1), whose series converges fast and has a
    finite limit at a = 1: with e = a - 1 it is -expm1(e ln(1-z)) / e - (1-z)^e S.

    S is a series of some dozens of terms per customer and day for usual parameters, and is summed until its terms
    vanish: Arrow batches in NumPy sum it some
    fifty times faster than a lambda over a sequence of term numbers.
    """
    r, alpha, a, b = model
    e, upper = a - 1, a + b - 1 - r

    @F.pandas_udf("double")
    def if_alive(x: pd.Series, t: pd.Series) -> pd.Series:
        horizon = np.array(days)
        z = horizon / (t.to_numpy()[:, None] + alpha + horizon)
        c = x.to_numpy()[:, None] + (a + b - 1)
        total, term, n = np.zeros_like(z), upper / c * z, 1
        while np.any(np.abs(term) > 1e-14 * (1 - z)):
            if n > MOST_TERMS:
                raise ArithmeticError(f"the series for expected orders has not converged after {n} terms")
            total += term
            term = term * (n + upper) * (n + e) / ((c + n) * (n + 1)) * z
            n += 1
        shrink = np.log1p(-z)
        lost = -shrink if e == 0 else -np.expm1(e * shrink) / e
        return pd.Series((c * (lost - np.exp(e * shrink) * total)) @ np.array(weights))

    return if_alive(x, t) * probability_alive(x, t_x, t, model)


def expected_order_value(x: Column, m: Column, model: GammaGamma) -> Column:
    p, q, v = model
    return (x * m + v) * p / (x * p + (q - 1))


def discounted_value(
    months: int, x: Column, t_x: Column, t: Column, m: Column, bgnbd: BgNbd, gg: GammaGamma, discount: float = 0.01
) -> Column:
    """Expected order value times the discounted expected orders of each 30-day month.

    The sum over months of (E(i) - E(i-1)) w(i) is rearranged to E(i) (w(i) - w(i+1)), so each
    month's expectation is computed once.
    """
    w = [(1 + discount) ** -i for i in range(1, months + 1)] + [0.0]
    days = [30.0 * i for i in range(1, months + 1)]
    weights = [now - later for now, later in zip(w, w[1:])]
    orders = expected_purchases(days, weights, x, t_x, t, bgnbd)
    return orders * expected_order_value(x, m, gg)


def lifetime_value(
    inputs: DataFrame,
    bgnbd: BgNbd,
    gg: GammaGamma,
    horizon_days: int = 180,
    discount: float = 0.01,
    months: int | None = None,
) -> DataFrame:
    """Add Predicted_Purchases, Prob_Alive and CLV.

    CLV runs over whole 30-day months: `months` if given, else the horizon rounded up.
    """
    x = F.col("Repeats").cast("double")
    t_x, t, m = F.col("ModelRecency").cast("double"), F.col("ModelT").cast("double"), F.col("OrderValue")
    return inputs.select(
        "*",
        expected_purchases([float(horizon_days)], [1.0], x, t_x, t, bgnbd).alias("Predicted_Purchases"),
        probability_alive(x, t_x, t, bgnbd).alias("Prob_Alive"),
        discounted_value(months or math.ceil(horizon_days / 30), x, t_x, t, m, bgnbd, gg, discount).alias("CLV"),
    )


def probability_alive_grid(inputs: DataFrame, model: BgNbd) -> DataFrame:
    """P(alive) for every repeat count and recency up to the largest seen, at the largest T."""
    x, t_x = F.col("frequency").cast("double"), F.col("recency").cast("double")
    return (
        inputs.agg(F.max("Repeats").alias("mx"), F.max("ModelT").alias("mt"))
        .select("mx", "mt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mx"))).alias("frequency"))
        # each repeat count is a row of the grid: they are dealt to the tasks before they are spread out
        .repartition("frequency")
        .select("mt", "frequency", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mt"))).alias("recency"))
        .select("frequency", "recency", probability_alive(x, t_x, F.col("mt"), model).alias("Prob_Alive"))
    )


# ---- Reports over a table with CLV ----------------------------------------------------------


def clv_summary(clv: DataFrame) -> DataFrame:
    median = exact_quantiles(clv, "CLV", [0.5]).scalar()
    return clv.agg(F.avg("CLV").alias("Mean"), F.sum("CLV").alias("Total")).select(
        "Mean", median[0].alias("Median"), "Total"
    )


def clv_histogram(clv: DataFrame, bins: int = 50) -> DataFrame:
    """Customers per equal-width bin; the largest value belongs to the last bin."""
    ends = clv.agg(F.struct(F.min("CLV").alias("low"), F.max("CLV").alias("high"))).scalar()
    place = F.try_divide(F.col("CLV") - F.col("Ends.low"), F.col("Ends.high") - F.col("Ends.low"))
    bin_no = F.least(F.floor(F.coalesce(place, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return (
        clv.select("CLV", ends.alias("Ends"))
        .groupBy(F.when(F.col("CLV").isNotNull(), bin_no).alias("Bin"))
        .agg(F.count(F.lit(1)).alias("Customers"))
        .filter(F.col("Bin").isNotNull())
    )


def clv_scatter(clv: DataFrame) -> DataFrame:
    return clv.select("CustomerID", "Prob_Alive", "CLV", "Frequency", "MonetaryValue")


def top_clv(clv: DataFrame, n: int = 20) -> DataFrame:
    return (
        clv.orderBy(F.desc("CLV"), "CustomerID")
        .select("CustomerID", "Frequency", "MonetaryValue", "Prob_Alive", "Predicted_Purchases", "CLV")
        .limit(n)
    )


def clv_quartiles(clv: DataFrame) -> DataFrame:
    """Add CLV_Segment by the quartiles of CLV; a value on an edge belongs below it."""
    q = exact_quantiles(clv, "CLV", [0.25, 0.5, 0.75]).scalar()
    low, medium, high, top = CLV_LABELS
    value, edge = F.col("CLV"), F.col("Edges")
    segment = (
        F.when(value <= edge[0], low)
        .when(value <= edge[1], medium)
        .when(value <= edge[2], high)
        .when(value.isNotNull(), top)
    )
    return clv.withColumn("Edges", q).withColumn("CLV_Segment", segment).drop("Edges")


def segment_profile(segmented: DataFrame) -> DataFrame:
    return (
        segmented.filter(F.col("CLV_Segment").isNotNull())
        .groupBy(F.col("CLV_Segment").alias("Segment"))
        .agg(
            F.count("CustomerID").alias("Count"),
            F.avg("Frequency").alias("Avg_Frequency"),
            F.avg("MonetaryValue").alias("Avg_Monetary"),
            F.avg("Prob_Alive").alias("Avg_Prob_Alive"),
            F.avg("CLV").alias("Avg_CLV"),
        )
    )


def segment_shares(profile: DataFrame) -> DataFrame:
    """Add Percentage, Total_CLV and CLV_Percentage; the totals run over four rows."""
    everything = Window.partitionBy()
    return profile.withColumn("Total_CLV", F.col("Avg_CLV") * F.col("Count")).select(
        "*",
        (ratio(F.col("Count"), F.sum("Count").over(everything)) * 100).alias("Percentage"),
        (ratio(F.col("Total_CLV"), F.sum("Total_CLV").over(everything)) * 100).alias("CLV_Percentage"),
    )


def segment_pies(shares: DataFrame) -> DataFrame:
    return shares.select("Segment", "Count", "Total_CLV")


def customer_value(tx: DataFrame) -> DataFrame:
    """Plain value of each customer, for logs with too few repeat customers to model."""
    return (
        tx.groupBy("CustomerID")
        .agg(F.count_distinct("InvoiceNo").alias("PurchaseCount"), money(F.sum("TotalPrice")).alias("TotalSpend"))
        .withColumn("AvgOrderValue", ratio(F.col("TotalSpend"), F.col("PurchaseCount")))
    )


def top_customer_value(values: DataFrame, n: int = 20) -> DataFrame:
    return values.orderBy(F.desc("TotalSpend"), "CustomerID").limit(n)
