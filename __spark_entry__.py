"""Registered queries over the driver's tables, with SQL twins in `tallybook.oracle`."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook import oracle  # noqa: E402
from tallybook.constants import CHURN_FEATURES, FORECAST_FEATURES, RFM_METRICS, SEGMENT_NAMES  # noqa: E402
from tallybook.operators import churn, clv, forecast, metrics, overview, recommend, rfm, sketches  # noqa: E402
from tallybook.operators.cleaning import clean  # noqa: E402
from tallybook.plans import churn as churn_plan  # noqa: E402
from tallybook.plans import forecast as forecast_plan  # noqa: E402
from tallybook.plans import forests, lifetime_value, maximum_likelihood, segmentation  # noqa: E402
from tallybook.sources import incremental, sinks  # noqa: E402
from tallybook.sources import transactions as sources  # noqa: E402
from tallybook.sources.staging import shared_folder, stage  # noqa: E402

try:  # the operators for training data are an optional part
    import corpus_pipeline
    from tallybook.llm import queries as training_data
except ModuleNotFoundError as missing:
    # only the part itself may be missing, not a library that it needs
    if missing.name not in ("corpus_pipeline", "tallybook.llm"):
        raise
    corpus_pipeline = training_data = None

SMOKE_DIR = "/root/testdata/sf0.001"
HOT_OWNERS = 5
BGNBD = clv.BgNbd(**oracle.BGNBD)
GAMMA_GAMMA = clv.GammaGamma(**oracle.GAMMA_GAMMA)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(sources.star_schema_transactions(spark, sf_dir))


def plain(df: DataFrame, places: int = 4, **exceptions: int) -> DataFrame:
    """Columns in types that compare across engines: doubles rounded, dates and times as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "double":
            c = F.round(c, exceptions.get(name, places))
        out.append(c.alias(name))
    return df.select(*out)


# ---- rule-based stand-ins, so that operators after a model can be checked exactly -------------


def _clustered(tx: DataFrame) -> DataFrame:
    return rfm.rfm(tx).withColumn("Cluster", F.least(F.lit(5), F.floor(F.col("Frequency") / 3)).cast("int"))


def _named_profile(tx: DataFrame) -> DataFrame:
    return rfm.name_clusters(rfm.cluster_profile(_clustered(tx)))


def _churn_scored(tx: DataFrame) -> DataFrame:
    p = F.col("Recency") / (F.col("Recency") + 100.0)
    return (
        churn.churn_features(tx, oracle.CHURN_DAYS)
        .withColumn("Churn_Probability", p)
        .withColumn("label", F.col("Churned").cast("int"))
        .withColumn("prediction", (p >= 0.6).cast("int"))
    )


def _series(tx: DataFrame) -> DataFrame:
    return forecast.series_features(overview.daily_revenue(tx))


def _naive_forecast(tx: DataFrame) -> DataFrame:
    return forecast.future_features(_series(tx), oracle.HORIZON).withColumn(
        "Predicted_Revenue", F.col("Revenue_Rolling_Mean_7") + 100.0 * F.col("DayOfWeek")
    )


def _naive_test(tx: DataFrame) -> DataFrame:
    tested = forecast.time_split(_series(tx)).filter("NOT IsTrain")
    return forecast.actual_and_predicted(tested.withColumn("prediction", F.col("Revenue_Lag_7")))


def _clv(tx: DataFrame) -> DataFrame:
    inputs = clv.model_inputs(clv.customer_base(tx))
    return clv.lifetime_value(inputs, BGNBD, GAMMA_GAMMA, oracle.CLV_DAYS)


def _kept_clv(tx: DataFrame) -> DataFrame:
    """For reports that read the values several times."""
    return stage(_clv(tx))


def _clv_columns(df: DataFrame) -> DataFrame:
    return plain(
        df.select("CustomerID", "Frequency", "MonetaryValue", "Predicted_Purchases", "Prob_Alive", "CLV")
    )


# ---- queries --------------------------------------------------------------------------------


def _churn_period(tx: DataFrame) -> DataFrame:
    edges = churn.period(tx, oracle.CHURN_DAYS)
    count = F.count(F.lit(1))
    return plain(
        edges.select(
            "Snapshot",
            "Boundary",
            churn.history(tx, oracle.CHURN_DAYS).agg(count).scalar().alias("HistoryLines"),
            churn.outcome(tx, oracle.CHURN_DAYS).agg(count).scalar().alias("OutcomeLines"),
        )
    )


def _at_risk(tx: DataFrame) -> DataFrame:
    return plain(churn.at_risk(_churn_scored(tx), 0.7), Churn_Probability=8)


def _lines_of_products(tx: DataFrame) -> DataFrame:
    """What recommendations and their descriptions read of the log, joined from its tables once."""
    return stage(tx.select("InvoiceNo", "CustomerID", "StockCode", "Description", "Quantity", "TotalPrice"))


def _item_recs(tx: DataFrame, **settings: int) -> DataFrame:
    tx = _lines_of_products(tx)
    found = recommend.describe_products(recommend.item_recommendations(tx, **settings), tx)
    return plain(
        found.select("CustomerID", "Rank", "StockCode", "Description", "Score", "Quantity", "TotalPrice", "Popularity"),
        Popularity=8,
    )


def _item_recs_top5(tx: DataFrame) -> DataFrame:
    """The short view of the recommendations."""
    shown = _item_recs(tx).filter(F.col("Rank") <= 5)
    return shown.select("CustomerID", "Rank", "StockCode", "Description", "Score")


def _user_recs(tx: DataFrame, **settings: int) -> DataFrame:
    tx = _lines_of_products(tx)
    found = recommend.user_recommendations(tx, recommend.similar_customers(tx, **settings))
    described = recommend.describe_products(found, tx, popularity=False)
    return plain(
        described.select("CustomerID", "Rank", "StockCode", "Description", "Score", "Quantity", "TotalPrice"), Score=8
    )


def _customer_lines(tx: DataFrame) -> DataFrame:
    """The lines of the customer with the smallest number."""
    return plain(recommend.customer_lines(tx, tx.agg(F.min("CustomerID")).first()[0]))


def _expected(tx: DataFrame) -> DataFrame:
    inputs = clv.model_inputs(clv.customer_base(tx))
    e = clv.expected_purchases(
        [float(oracle.CLV_DAYS)],
        [1.0],
        F.col("Repeats").cast("double"),
        F.col("ModelRecency").cast("double"),
        F.col("ModelT").cast("double"),
        BGNBD,
    )
    return plain(inputs.select("CustomerID", e.alias("Predicted_Purchases")), places=6)


def _prob_alive(tx: DataFrame) -> DataFrame:
    inputs = clv.model_inputs(clv.customer_base(tx))
    p = clv.probability_alive(
        F.col("Repeats").cast("double"),
        F.col("ModelRecency").cast("double"),
        F.col("ModelT").cast("double"),
        BGNBD,
    )
    return plain(inputs.select("CustomerID", p.alias("Prob_Alive")), places=8)


# a fitted model's figures differ between engines: these queries return what must hold for any fit, row by row


def _elbow(tx: DataFrame) -> DataFrame:
    """The inertia of one cluster, and whether each further cluster lowers it."""
    found = segmentation.elbow(rfm.rfm(tx))
    before = found.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("Before"))
    return found.join(before, "k", "left").select(
        "k",
        F.when(F.col("k") == 1, F.round("inertia", 4)).alias("Inertia_1"),
        ((F.col("k") == 1) | (F.col("inertia") < F.col("Before"))).alias("Falls"),
    )


def _kmeans_segments(tx: DataFrame) -> DataFrame:
    """Every customer's metrics, and whether the segment has the name that its mean spend calls for."""
    segments, _ = segmentation.segment(tx)
    means = segments.groupBy("Segment").agg(F.avg("Monetary").alias("Mean"))
    ranked = means.withColumn("Place", F.row_number().over(Window.orderBy(F.desc("Mean"))))  # one row per segment
    right = F.element_at(F.array(*map(F.lit, SEGMENT_NAMES)), F.col("Place")) == F.col("Segment")
    named = ranked.select("Segment", right.alias("Named"))
    return plain(segments.join(named, "Segment").select("CustomerID", *RFM_METRICS, "Named"))


def _churn_model_scores(tx: DataFrame) -> DataFrame:
    features = churn_plan.labelled(tx)
    p = F.col("Churn_Probability")
    valid = p.between(0, 1) & (F.col("prediction") == (p > 0.5).cast("double"))
    return churn_plan.train(features).predict(features).select("CustomerID", "Churned", valid.alias("Valid"))


def _shares(importance: DataFrame) -> DataFrame:
    total = importance.agg(F.round(F.sum("Importance"), 6)).scalar()  # one row per feature
    return importance.select("Feature", F.col("Importance").between(0, 1).alias("Valid"), total.alias("Total"))


def _churn_importance(tx: DataFrame) -> DataFrame:
    train, _ = churn.split(churn_plan.labelled(tx))
    model = forests.fit_classifier(train, CHURN_FEATURES, "label")
    return _shares(forests.importance(train, model, len(CHURN_FEATURES)))


def _revenue_model(tx: DataFrame) -> DataFrame:
    """The predicted days; a forest's mean lies between the least and the largest revenue, its band around it."""
    found = forecast_plan.analyse(tx, oracle.HORIZON)
    edges = found.series.agg(F.min("Revenue").alias("Least"), F.max("Revenue").alias("Most"))
    within = F.col("Predicted_Revenue").between(F.col("Least"), F.col("Most"))
    around = (F.col("Lower") <= F.col("Predicted_Revenue")) & (F.col("Predicted_Revenue") <= F.col("Upper"))
    rows = forecast_plan.with_band(found).crossJoin(F.broadcast(edges))  # one row
    return plain(rows.select("Date", (within & around).alias("Valid")))


def _revenue_importance(tx: DataFrame) -> DataFrame:
    found = forecast_plan.analyse(tx, oracle.HORIZON)
    if found.model is None:
        return _shares(found.importance)
    return _shares(forests.importance(found.series, found.model, len(FORECAST_FEATURES)))


def _not_beaten(tx: DataFrame, fitted, values: list[float]) -> DataFrame:
    """Whether the fitted parameters, whose objective comes first, do at least as well as all others."""
    row = (min(fitted) > 0, all(values[0] <= v + 1e-6 for v in values[1:]))
    return tx.sparkSession.createDataFrame([row], "Positive boolean, Best boolean")


def _bgnbd_fit(tx: DataFrame) -> DataFrame:
    inputs = clv.model_inputs(clv.customer_base(tx))
    fitted = maximum_likelihood.fit_bgnbd(inputs)
    others = [BGNBD, *[fitted._replace(**{n: getattr(fitted, n) * f}) for n in fitted._fields for f in (0.9, 1.1)]]
    return _not_beaten(tx, fitted, maximum_likelihood.bgnbd_objectives(inputs, [fitted, *others]))


def _gg_fit(tx: DataFrame) -> DataFrame:
    inputs = clv.model_inputs(clv.customer_base(tx))
    fitted = maximum_likelihood.fit_gamma_gamma(inputs)
    others = [GAMMA_GAMMA, *[fitted._replace(**{n: getattr(fitted, n) * f}) for n in fitted._fields for f in (0.9, 1.1)]]
    return _not_beaten(tx, fitted, maximum_likelihood.gamma_gamma_objectives(inputs, [fitted, *others]))


def _likelihoods(tx: DataFrame) -> DataFrame:
    """The mean log-likelihood of both lifetime models at fixed parameters."""
    inputs = clv.model_inputs(clv.customer_base(tx))
    values = (
        maximum_likelihood.bgnbd_objectives(inputs, [BGNBD], penalty=0.0)[0],
        maximum_likelihood.gamma_gamma_objectives(inputs, [GAMMA_GAMMA], penalty=0.0)[0],
    )
    return plain(tx.sparkSession.createDataFrame([tuple(-v for v in values)], "BgNbd double, GammaGamma double"))


def _fit_slopes(tx: DataFrame) -> DataFrame:
    """First and second derivatives of both mean log-likelihoods at fixed parameters, by the logarithms of these."""
    inputs = stage(clv.model_inputs(clv.customer_base(tx)))
    rows = []
    for name, model, slopes in (
        ("BG/NBD", BGNBD, maximum_likelihood.bgnbd_slopes),
        ("Gamma-Gamma", GAMMA_GAMMA, maximum_likelihood.gamma_gamma_slopes),
    ):
        _, gradient, curvature = slopes(inputs, model, penalty=0.0)
        fields = model._fields
        rows += [(name, n, "", -float(gradient[i])) for i, n in enumerate(fields)]
        rows += [(name, n, fields[j], -float(curvature[i, j])) for i, n in enumerate(fields) for j in range(i, len(fields))]
    return plain(tx.sparkSession.createDataFrame(rows, "Model string, Parameter string, Other string, Slope double"))


def _customer_value_fallback(tx: DataFrame) -> DataFrame:
    """The whole lifetime analysis with a gate that no log passes: plain spend of every customer."""
    return plain(lifetime_value.analyse(tx, more_than=1 << 40).customer_value)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    sinks.write_csv(sources.star_schema_transactions(spark, sf_dir), path)
    return plain(rfm.rfm(clean(sources.read_transactions(spark, path))))


def _staged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    sources.stage_transactions(transactions(spark, sf_dir), path)
    return plain(overview.daily_revenue(sources.read_staged_transactions(spark, path)))


def _model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a forest that was saved and read back gives every customer the score of the fresh one."""
    path = shared_folder(spark)
    features = churn_plan.labelled(transactions(spark, sf_dir))
    fitted = churn_plan.train(features)
    first = fitted.predict(features).select("CustomerID", "Churn_Probability")
    if fitted.forest is not None:
        sinks.save_model(fitted.forest, path)
        fitted = churn_plan.ChurnModel(sinks.load_model(path), None)
    again = fitted.predict(features).select("CustomerID", F.col("Churn_Probability").alias("Again"))
    return first.join(again, "CustomerID").select(
        "CustomerID", (F.abs(F.col("Again") - F.col("Churn_Probability")) < 1e-12).alias("Same")
    )


def _revenue_model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a revenue forest that was saved and read back predicts the same for every coming day."""
    path = shared_folder(spark)
    found = forecast_plan.analyse(transactions(spark, sf_dir), oracle.HORIZON)
    days = found.future.select("Date", F.col("Predicted_Revenue").alias("Fresh"))
    if found.model is None:
        return plain(days.select("Date", F.col("Fresh").isNull().alias("Same")))
    sinks.save_model(found.model, path)
    again = sinks.load_model(path).transform(found.future.drop("Predicted_Revenue"))
    same = F.abs(F.col("prediction") - F.col("Fresh")) < 1e-9 * F.abs(F.col("Fresh"))
    return plain(again.select("Date", "prediction").join(days, "Date").select("Date", same.alias("Same")))


def _csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in ISO-8859-1, whose encoding is found from its bytes: the products with an accent in their names."""
    path = shared_folder(spark)
    accented = sources.star_schema_transactions(spark, sf_dir).withColumn(
        "Description", F.concat("Description", F.lit(" é"), F.col("StockCode"))
    )
    accented.write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return recommend.product_lookup(clean(sources.read_transactions(spark, path)))


def _with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a CSV log without a header; the number of the invoice decides what is wrong with a line."""
    raw = sources.star_schema_transactions(spark, sf_dir)
    kind = F.pmod(F.regexp_replace("InvoiceNo", "C", "").cast("bigint"), F.lit(40))

    def spoilt(column: str, when: int, text: str) -> Column:
        return F.when(kind == when, text).otherwise(F.col(column).cast("string")).alias(column)

    line = F.to_csv(
        F.struct(
            "InvoiceNo", "StockCode", "Description", spoilt("Quantity", 3, "six"), spoilt("InvoiceDate", 4, "soon"),
            spoilt("UnitPrice", 5, "1.2.3"), spoilt("CustomerID", 6, "someone"), "Country",
        )
    )
    return raw.select(
        F.when(kind == 0, F.concat(line, F.lit(",more")))
        .when(kind == 1, F.regexp_replace(line, ",[^,]*$", ""))
        .when(kind == 2, F.concat(F.regexp_extract(line, "^[^,]*,[^,]*,", 0), F.lit('"open')))
        .otherwise(line)
        .alias("value")
    )


def _csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad lines of a damaged log by reason, and what the good ones are worth."""
    path = shared_folder(spark)
    _with_faults(spark, sf_dir).write.text(path)
    lines = sources.read_with_reasons(spark, path, columns=sources.TRANSACTION_COLUMNS)
    good, bad = sources.quarantine(lines, shared_folder(spark))
    revenue = clean(good).agg(F.sum("TotalPrice").cast("double")).scalar()
    worth = good.agg(F.lit("good").alias("Reason"), F.count(F.lit(1)).alias("Lines"), F.round(revenue, 4).alias("Revenue"))
    return worth.unionByName(
        bad.groupBy("Reason").agg(F.count(F.lit(1)).alias("Lines"), F.lit(None).cast("double").alias("Revenue"))
    )


def _before_the_last_month(tx: DataFrame) -> DataFrame:
    """The log as it was: without its last month, and without some lines of its first, which came late."""
    edges = tx.agg(F.date_format(F.min("InvoiceDate"), "yyyy-MM").alias("f"), F.date_format(F.max("InvoiceDate"), "yyyy-MM").alias("l"))
    month, first, last = F.date_format("InvoiceDate", "yyyy-MM"), edges.select("f").scalar(), edges.select("l").scalar()
    return tx.filter((month < last) & ((month > first) | ~F.col("InvoiceNo").endswith("1")))


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States of the months in the second refresh of a log, and of the daily revenue derived from it, and that table."""
    log, days = shared_folder(spark), shared_folder(spark)

    def daily(rows: DataFrame) -> DataFrame:
        by_day = rows.groupBy(incremental.MONTH, F.to_date("InvoiceDate").alias("Date"))
        return by_day.agg(F.sum("TotalPrice").cast("double").alias("Revenue"))

    tx = transactions(spark, sf_dir)
    for version in (_before_the_last_month(tx), tx):
        months = incremental.refresh(version, log)
        derived = incremental.refresh_derived(spark, log, days, daily)
    return months, derived, incremental.read(spark, days)


def _incremental_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months, derived, _ = _refreshed(spark, sf_dir)
    return months.join(derived.select(incremental.MONTH, F.col("State").alias("Derived")), incremental.MONTH)


def _incremental_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_refreshed(spark, sf_dir)[2].select("Date", "Revenue"))


def _distinct_sketches(tx: DataFrame) -> DataFrame:
    """Exact distinct counts by month, and whether the counts of merged daily states are within the stated error."""
    month = F.date_format("Date", "yyyy-MM").alias("Month")
    by_country = sketches.merge_distinct(stage(sketches.distinct_states(tx)), month, "Country")
    found = sketches.distinct_counts(sketches.merge_distinct(by_country, "Month")).withColumnsRenamed(
        {name: f"About{name}" for name in sketches.DISTINCT}
    )
    exact = tx.groupBy(F.date_format("InvoiceDate", "yyyy-MM").alias("Month")).agg(
        *[F.count_distinct(c).alias(name) for name, c in sketches.DISTINCT.items()]
    )
    near = [F.abs(F.col(f"About{n}") - F.col(n)) <= sketches.distinct_error() * F.col(n) + 1 for n in sketches.DISTINCT]
    within = near[0] & near[1] & near[2]
    return plain(found.join(exact, "Month").select("Month", "Records", "Revenue", *sketches.DISTINCT, within.alias("Within")))


def _quantile_sketches(tx: DataFrame) -> DataFrame:
    """Exact shares of invoice totals below the quartiles of merged sketches, as whether they are within the rank error."""
    invoices = stage(
        tx.filter("InvoiceNo IS NOT NULL")
        .groupBy("InvoiceNo", "Country", F.date_format("InvoiceDate", "yyyy-MM").alias("Month"))
        .agg(F.sum("TotalPrice").cast("double").alias("Total"))
    )
    states = stage(sketches.quantile_states(invoices, "Total", "Month", "Country"))
    marks = {"Q1": 0.25, "Median": 0.5, "Q3": 0.75}
    found = sketches.quantiles(sketches.merge_quantiles(states, "Country"), marks)
    # a mark's ranks are those of its first and last equal value
    joined = invoices.join(found, "Country").groupBy("Country").agg(
        F.count(F.lit(1)).alias("Invoices"),
        F.min("Values").alias("Values"),
        *[F.avg((F.col("Total") < F.col(m)).cast("double")).alias(f"Below{m}") for m in marks],
        *[F.avg((F.col("Total") <= F.col(m)).cast("double")).alias(f"UpTo{m}") for m in marks],
    )
    # three counts of one row: a sketch of few values is exact, but for the rounding of a rank
    slack = F.lit(1.5 * sketches.rank_error()) + 1 / F.col("Invoices")
    near = [(F.col(f"Below{m}") <= q + slack) & (F.col(f"UpTo{m}") >= q - slack) for m, q in marks.items()]
    return joined.select("Country", "Invoices", (near[0] & near[1] & near[2] & (F.col("Values") == F.col("Invoices"))).alias("Within"))


def _saved_and_read(spark: SparkSession, df: DataFrame, export: Callable[[DataFrame, str], bool]) -> DataFrame:
    """A table that was exported and read back; nothing was written for an empty one."""
    path = shared_folder(spark)
    if not export(df, path):
        return df.limit(0)
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


def _export_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    segments = rfm.segment_points(rfm.assign_segments(_clustered(tx), _named_profile(tx)))
    return plain(_saved_and_read(spark, segments, sinks.export_segments))


def _export_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = churn.at_risk(_churn_scored(transactions(spark, sf_dir)), 0.7)
    return plain(_saved_and_read(spark, found, sinks.export_at_risk), Churn_Probability=8)


def _export_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _naive_forecast(transactions(spark, sf_dir)).select("Date", "Predicted_Revenue")
    return plain(_saved_and_read(spark, days, sinks.export_forecast))


def _export_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved_and_read(spark, _clv_columns(_clv(transactions(spark, sf_dir))), sinks.export_clv)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator or group of operators; each reads its whole tables."""
    on_transactions: dict[str, Callable[[DataFrame], DataFrame]] = {
        # cleaning and overview
        "clean_transactions": plain,
        "preview": lambda tx: plain(overview.preview(tx)),
        "overview_kpis": lambda tx: plain(overview.kpis(tx)),
        "daily_revenue": lambda tx: plain(overview.daily_revenue(tx)),
        "top_countries": lambda tx: plain(overview.top_countries(tx)),
        "top_products": lambda tx: plain(overview.top_products(tx)),
        # segmentation
        "rfm": lambda tx: plain(rfm.rfm(tx)),
        "rfm_scaled": lambda tx: plain(
            rfm.scale(rfm.rfm(tx)).select("CustomerID", *[f"{c}_Scaled" for c in RFM_METRICS]), places=6
        ),
        "cluster_profile": lambda tx: plain(rfm.cluster_profile(_clustered(tx))),
        "cluster_names": lambda tx: plain(rfm.segment_points(rfm.assign_segments(_clustered(tx), _named_profile(tx)))),
        "radar": lambda tx: plain(
            rfm.radar(_named_profile(tx)).select(
                "Segment", "Customer_Count", "Avg_Recency_Norm", "Avg_Frequency_Norm", "Avg_Monetary_Norm"
            ),
            places=6,
        ),
        "segment_sizes": lambda tx: rfm.segment_sizes(_named_profile(tx)),
        "elbow": _elbow,
        "kmeans_segments": _kmeans_segments,
        # churn
        "churn_period": _churn_period,
        "churn_features": lambda tx: plain(churn.churn_features(tx, oracle.CHURN_DAYS), PurchaseFrequency=8),
        "churn_rate": lambda tx: plain(churn.churn_rate(churn.churn_features(tx, oracle.CHURN_DAYS))),
        "recency_histogram": lambda tx: churn.recency_histogram(churn.churn_features(tx, oracle.CHURN_DAYS)),
        "at_risk": _at_risk,
        "accuracy": lambda tx: plain(metrics.accuracy(_churn_scored(tx)), places=8),
        "confusion": lambda tx: metrics.confusion(_churn_scored(tx)),
        "report": lambda tx: plain(metrics.classification_report(_churn_scored(tx)), places=8),
        "churn_model_scores": _churn_model_scores,
        "churn_importance": _churn_importance,
        # forecast
        "forecast_features": lambda tx: plain(_series(tx)),
        "time_split": lambda tx: plain(forecast.time_split(_series(tx)).select("Date", "Revenue", "IsTrain")),
        "future_features": lambda tx: plain(forecast.future_features(_series(tx), oracle.HORIZON)),
        "history_and_forecast": lambda tx: plain(forecast.history_and_forecast(_series(tx), _naive_forecast(tx))),
        "band": lambda tx: plain(
            forecast.band(_naive_forecast(tx), metrics.regression_metrics(_naive_test(tx)).select("RMSE").scalar())
        ),
        "forecast_summary": lambda tx: plain(
            forecast.forecast_summary(_series(tx), _naive_forecast(tx), oracle.HORIZON),
            TotalChange=6,
            DailyMeanChange=6,
        ),
        "actual_and_predicted": lambda tx: plain(_naive_test(tx)),
        "regression_metrics": lambda tx: plain(metrics.regression_metrics(_naive_test(tx)), R2=8),
        "revenue_model": _revenue_model,
        "revenue_importance": _revenue_importance,
        # recommendations
        "basket": recommend.basket,
        "co_occurrence": lambda tx: recommend.co_occurrence(recommend.basket(tx)),
        "product_lookup": recommend.product_lookup,
        "product_descriptions": recommend.product_descriptions,
        "top_units": recommend.top_units,
        "top20_matrix": recommend.top_co_occurrence,
        "customers": recommend.customers,
        "customer_lines": _customer_lines,
        "customer_kpis": lambda tx: plain(recommend.customer_kpis(tx)),
        "customer_top5": lambda tx: plain(recommend.customer_top_products(tx)),
        "product_metrics": lambda tx: plain(recommend.product_metrics(tx), Popularity=8),
        "item_recs": _item_recs,
        "similar_customers": lambda tx: plain(recommend.similar_customers(tx), places=8),
        "user_recs": _user_recs,
        # the ways for products of very many owners, taken by some products of these tables
        "item_recs_hot": lambda tx: _item_recs(tx, hot_owners=HOT_OWNERS),
        "similar_customers_hot": lambda tx: plain(recommend.similar_customers(tx, hot_owners=HOT_OWNERS), places=8),
        "user_recs_hot": lambda tx: _user_recs(tx, hot_owners=HOT_OWNERS),
        "item_recs_top5": _item_recs_top5,
        # lifetime value
        "clv_base": lambda tx: plain(clv.model_inputs(clv.customer_base(tx))),
        "prob_alive": _prob_alive,
        "prob_alive_grid": lambda tx: plain(
            clv.probability_alive_grid(clv.model_inputs(clv.customer_base(tx)), BGNBD), places=8
        ),
        "expected_purchases": _expected,
        "clv": lambda tx: _clv_columns(_clv(tx)),
        "clv_summary": lambda tx: plain(clv.clv_summary(_kept_clv(tx)), Total=2),
        "clv_histogram": lambda tx: clv.clv_histogram(_kept_clv(tx)),
        "clv_scatter": lambda tx: plain(clv.clv_scatter(_clv(tx))),
        "top_clv": lambda tx: _clv_columns(clv.top_clv(_clv(tx))),
        "clv_quartiles": lambda tx: plain(clv.clv_quartiles(_kept_clv(tx)).select("CustomerID", "CLV", "CLV_Segment")),
        "clv_segments": lambda tx: plain(
            clv.segment_shares(clv.segment_profile(clv.clv_quartiles(_kept_clv(tx)))),
            Total_CLV=2,
            Percentage=6,
            CLV_Percentage=6,
        ),
        "clv_pies": lambda tx: plain(
            clv.segment_pies(clv.segment_shares(clv.segment_profile(clv.clv_quartiles(_kept_clv(tx))))), Total_CLV=2
        ),
        "customer_value": lambda tx: plain(clv.customer_value(tx)),
        "top_customer_value": lambda tx: plain(clv.top_customer_value(clv.customer_value(tx))),
        "bgnbd_fit": _bgnbd_fit,
        "gg_fit": _gg_fit,
        "likelihoods": _likelihoods,
        "fit_slopes": _fit_slopes,
        "customer_value_fallback": _customer_value_fallback,
        # states that merge
        "distinct_sketches": _distinct_sketches,
        "quantile_sketches": _quantile_sketches,
    }

    def over_transactions(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(transactions(spark, sf_dir))

    registered = {name: over_transactions(query) for name, query in on_transactions.items()}
    registered["csv_round_trip"] = _csv_round_trip
    registered["staged_round_trip"] = _staged_round_trip
    registered["model_round_trip"] = _model_round_trip
    registered["revenue_model_round_trip"] = _revenue_model_round_trip
    registered["csv_latin1"] = _csv_latin1
    registered["csv_quarantine"] = _csv_quarantine
    registered["incremental_months"] = _incremental_months
    registered["incremental_daily"] = _incremental_daily
    registered["export_segments"] = _export_segments
    registered["export_at_risk"] = _export_at_risk
    registered["export_forecast"] = _export_forecast
    registered["export_clv"] = _export_clv
    if training_data is not None:
        registered |= training_data.queries()
        registered["pipeline"] = corpus_pipeline.run
    return registered


def oracle_sql() -> dict[str, str]:
    twins = oracle.oracle_sql()
    if training_data is not None:
        twins |= training_data.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return twins


def entry(spark: SparkSession) -> DataFrame:
    """Recency, frequency and monetary value of every customer."""
    return queries()["rfm"](spark, SMOKE_DIR)
