import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.functions.expressions import digamma, ln_gamma, trigamma
from tallybook.functions.quantiles import exact_quantiles
from tallybook.operators import clv
from tallybook.plans import lifetime_value, maximum_likelihood

TRUE = clv.BgNbd(0.8, 30.0, 0.8, 2.5)
MONEY = clv.GammaGamma(6.0, 4.0, 15.0)


def test_ln_gamma(spark):
    points = [0.05, 0.3, 1.0, 2.5, 7.0, 40.0, 300.0, 1e6]
    got = spark.createDataFrame([(p,) for p in points], "z double").select("z", ln_gamma(F.col("z")).alias("g")).collect()
    for r in got:
        assert r.g == pytest.approx(math.lgamma(r.z), rel=1e-11, abs=1e-11)


@pytest.mark.parametrize("n,accuracy", [(1, 100), (3, 100), (5, 100), (2000, 100), (2001, 50)])
def test_exact_quantiles(spark, n, accuracy):
    rng = random.Random(n)
    # a third of the values are equal
    values = [1.0 if rng.random() < 0.33 else rng.lognormvariate(0, 2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    q = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert exact_quantiles(df, "v", q, accuracy).first().Q == pytest.approx(list(np.quantile(values, q)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().Q is None


def published_expected(days, x, t_x, t, model):
    """The published form, with 2F1 as a plain series."""
    r, alpha, a, b = model
    z = days / (alpha + t + days)
    total, term = 1.0, 1.0
    for n in range(2000):
        term *= (r + x + n) * (b + x + n) / ((a + b + x - 1 + n) * (n + 1)) * z
        total += term
    d = 1 + (a / (b + x - 1) * ((alpha + t) / (alpha + t_x)) ** (r + x) if x > 0 else 0)
    return (a + b + x - 1) / (a - 1) * (1 - ((alpha + t) / (alpha + t + days)) ** (r + x) * total) / d


@pytest.mark.parametrize("model", [TRUE, clv.BgNbd(0.3, 5.0, 1.7, 0.6), clv.BgNbd(2.0, 60.0, 1.0 + 1e-9, 3.0)])
def test_expected_purchases(spark, model):
    cases = [(1.0, 10.0, 50.0), (4.0, 90.0, 100.0), (12.0, 300.0, 900.0), (0.0, 0.0, 30.0)]
    df = spark.createDataFrame(cases, "x double, t_x double, t double")
    e = clv.expected_purchases([30.0, 180.0], [0.25, 1.0], *(F.col(c) for c in ("x", "t_x", "t")), model)
    reference = clv.BgNbd(model.r, model.alpha, model.a + (1e-6 if abs(model.a - 1) < 1e-6 else 0), model.b)
    for row in df.select("*", e.alias("e")).collect():
        args = (row.x, row.t_x, row.t, reference)
        expected = 0.25 * published_expected(30.0, *args) + published_expected(180.0, *args)
        assert row.e == pytest.approx(expected, rel=1e-4 if reference != model else 1e-9)


def test_expected_purchases_at_the_limit(spark):
    """a = 1 lies between its neighbours, and a single 365-day horizon of a new customer converges."""
    df = spark.createDataFrame([(1.0, 0.0, 1.0)], "x double, t_x double, t double")
    columns = [F.col(c) for c in ("x", "t_x", "t")]
    values = [
        df.select(clv.expected_purchases([365.0], [1.0], *columns, clv.BgNbd(0.5, 3.0, a, 2.0)).alias("e")).first().e
        for a in (0.999, 1.0, 1.001)
    ]
    assert values[0] > values[1] > values[2] and values[0] - values[2] < 0.05


def simulate(n, seed=7):
    """Repeat customers' summaries drawn from the two models."""
    rng = np.random.default_rng(seed)
    rows = []
    for customer in range(n):
        t = float(rng.integers(100, 400))
        rate, drop = rng.gamma(TRUE.r, 1 / TRUE.alpha), rng.beta(TRUE.a, TRUE.b)
        x, t_x, now = 0, 0.0, 0.0
        while True:
            now += rng.exponential(1 / rate) if rate > 0 else 1e9
            if now > t:
                break
            x, t_x = x + 1, now
            if rng.random() < drop:
                break
        mean = 0.0
        if x:
            nu = rng.gamma(MONEY.q, 1 / MONEY.v)
            mean = float(rng.gamma(MONEY.p, 1 / nu, x).mean())
        rows.append((customer, x, float(t_x), t, mean))
    return rows


def likelihood(spark, df, model):
    r, alpha, a, b = model
    p = {
        "r": F.lit(r),
        "alpha": F.lit(alpha),
        "a": F.lit(a),
        "b": F.lit(b),
        "lg_r": F.lit(math.lgamma(r)),
        "lg_ab": F.lit(math.lgamma(a + b)),
        "lg_b": F.lit(math.lgamma(b)),
    }
    x = F.col("Repeats").cast("double")
    return df.agg(F.avg(clv.bgnbd_log_likelihood(x, F.col("ModelRecency"), F.col("ModelT"), p))).first()[0]


def test_fits_recover_the_models(spark):
    df = spark.createDataFrame(
        simulate(4000), "CustomerID bigint, Repeats bigint, ModelRecency double, ModelT double, OrderValue double"
    ).persist()
    fitted = maximum_likelihood.fit_bgnbd(df, penalty=0.0)
    assert likelihood(spark, df, fitted) >= likelihood(spark, df, TRUE) - 1e-6
    assert fitted.r == pytest.approx(TRUE.r, rel=0.25) and fitted.alpha == pytest.approx(TRUE.alpha, rel=0.3)
    assert fitted.a / (fitted.a + fitted.b) == pytest.approx(TRUE.a / (TRUE.a + TRUE.b), rel=0.25)
    money = maximum_likelihood.fit_gamma_gamma(df, penalty=0.0)
    assert money.p * money.v / (money.q - 1) == pytest.approx(MONEY.p * MONEY.v / (MONEY.q - 1), rel=0.1)
    held = maximum_likelihood.fit_bgnbd(df, penalty=0.01)
    assert sum(v * v for v in (held.r, held.a, held.b)) < sum(v * v for v in (fitted.r, fitted.a, fitted.b))
    df.unpersist()


def log(spark, customers, orders):
    return spark.range(customers * orders).selectExpr(
        "CAST(id AS STRING) AS InvoiceNo",
        f"id % {customers} AS CustomerID",
        f"TIMESTAMP_NTZ'2011-01-01' + make_dt_interval(CAST(pmod(hash(id), 300) AS INT)) AS InvoiceDate",
        "CAST(10 + id % 7 AS DECIMAL(18,4)) AS TotalPrice",
    )


def test_few_repeat_customers_fall_back(spark):
    out = lifetime_value.analyse(log(spark, 10, 3))
    assert out.clv is None and out.customer_value.count() == 10
    values = out.customer_value.filter("CustomerID = 0").first()
    assert values.PurchaseCount == 3 and values.AvgOrderValue == pytest.approx(values.TotalSpend / 3)


def test_whole_analysis(spark):
    out = lifetime_value.analyse(log(spark, 60, 4))
    rows = out.clv.collect()
    assert len(rows) == 60
    assert all(0 < r.Prob_Alive <= 1 and r.Predicted_Purchases >= 0 and r.CLV >= 0 for r in rows)
    labelled = clv.clv_quartiles(out.clv)
    profile = {r.Segment: r for r in clv.segment_shares(clv.segment_profile(labelled)).collect()}
    assert set(profile) == {"Low Value", "Medium Value", "High Value", "Top Value"}
    assert sum(r.Percentage for r in profile.values()) == pytest.approx(100)
    assert profile["Low Value"].Avg_CLV < profile["Top Value"].Avg_CLV
    assert sum(r.Customers for r in clv.clv_histogram(out.clv).collect()) == 60
    top = clv.top_clv(out.clv, 5).collect()
    assert [r.CLV for r in top] == sorted((r.CLV for r in rows), reverse=True)[:5]


def test_equal_values_share_the_lowest_label(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(8)], "CustomerID bigint, CLV double")
    assert {r.CLV_Segment for r in clv.clv_quartiles(df).collect()} == {"Low Value"}
    assert [tuple(r) for r in clv.clv_histogram(df).collect()] == [(0, 8)]


def test_digamma_and_trigamma_against_differences_of_ln_gamma(spark):
    z = [0.05, 0.3, 1.0, 2.5, 7.0, 40.0, 1000.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", digamma(F.col("z")), trigamma(F.col("z"))).collect()
    for v, first, second in rows:
        h = 1e-4 * v
        low, mid, high = (math.lgamma(v + k * h) for k in (-1, 0, 1))
        assert first == pytest.approx((high - low) / (2 * h), rel=1e-5, abs=1e-6)
        assert second == pytest.approx((high - 2 * mid + low) / h**2, rel=1e-2)
    # psi(1) = -0.57721..., psi'(1) = pi^2 / 6; psi(z + 1) - psi(z) = 1 / z
    one = next(r for r in rows if r[0] == 1.0)
    assert one[1] == pytest.approx(-0.5772156649015329, abs=1e-12) and one[2] == pytest.approx(math.pi**2 / 6, abs=1e-11)


def test_slopes_against_differences_and_fits_without_derivatives(spark):
    df = spark.createDataFrame(
        [*simulate(1500), (-1, 0, 0.0, 90.0, 0.0)],
        "CustomerID bigint, Repeats bigint, ModelRecency double, ModelT double, OrderValue double",
    ).persist()
    bgnbd, _ = maximum_likelihood._bgnbd(df, 0.01)
    for make, d in ((lambda: bgnbd, 4), (lambda: maximum_likelihood._gamma_gamma(df, 0.01), 3)):
        with make() as problem:
            at = np.linspace(-0.4, 0.5, d)
            value, gradient, curvature = problem.slopes(at)
            h, unit = 1e-4, np.eye(d) * 1e-4
            f = problem.evaluate([at, *(at + u for u in unit), *(at - u for u in unit)])
            assert value == pytest.approx(f[0], abs=1e-10)
            assert gradient == pytest.approx((f[1 : d + 1] - f[d + 1 :]) / (2 * h), abs=1e-6)
            both = np.array([[problem.slopes(at + s * u)[1] for u in unit] for s in (1, -1)])
            assert curvature == pytest.approx((both[0] - both[1]) / (2 * h), abs=1e-6)
            problem.jobs = 0
            exact = maximum_likelihood.newton(problem, np.zeros(d))
            jobs, problem.jobs = problem.jobs, 0
            plain = maximum_likelihood.minimise(problem.evaluate, np.zeros(d), tolerance=1e-13)
            print(f"{jobs} jobs with derivatives, {problem.jobs} without")
            assert jobs < problem.jobs
            # both settle at one place; differences of values cannot tell it better than this
            assert problem.evaluate([exact])[0] <= problem.evaluate([plain])[0] + 1e-12
            assert exact == pytest.approx(plain, abs=1e-4)
            # started elsewhere, the exact way ends within 1e-6
            assert maximum_likelihood.newton(problem, np.full(d, 0.7)) == pytest.approx(exact, abs=1e-6)
    df.unpersist()
