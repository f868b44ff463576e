"""RFM, churn and metrics on hand-made rows."""

import datetime as dt

import pytest

from tallybook.operators import churn, metrics, rfm
from tallybook.plans import churn as churn_plan
from tallybook.plans import segmentation

TX = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate timestamp_ntz, "
    "UnitPrice decimal(12,4), CustomerID bigint, Country string, TotalPrice decimal(18,4)"
)


def lines(spark, *rows):
    """rows of (invoice, customer, time, quantity, price)"""
    full = []
    for invoice, customer, when, quantity, price in rows:
        full.append((invoice, "A", "a", quantity, when, price, customer, "UK", price * quantity))
    from decimal import Decimal

    full = [(*r[:5], Decimal(r[5]), *r[6:8], Decimal(r[8])) for r in full]
    return spark.createDataFrame(full, TX)


T0 = dt.datetime(2011, 1, 1, 12)


def test_recency_counts_full_days(spark):
    tx = lines(spark, ("1", 1, T0, 1, 10), ("2", 2, T0 + dt.timedelta(hours=23), 2, 10), ("2", 2, T0, 1, 5))
    got = {r.CustomerID: (r.Recency, r.Frequency, r.Monetary) for r in rfm.rfm(tx).collect()}
    # the snapshot is one day after the last line; 47 hours are one full day
    assert got == {1: (1, 1, 10.0), 2: (1, 1, 25.0)}


def test_scaling_a_constant_column(spark):
    df = spark.createDataFrame([(1, 1, 5, 2.0), (2, 3, 5, 2.0)], "CustomerID bigint, Recency bigint, Frequency bigint, Monetary double")
    rows = rfm.scale(df).orderBy("CustomerID").collect()
    assert [(r.Recency_Scaled, r.Frequency_Scaled) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("k", [2, 6])
def test_cluster_names(spark, k):
    df = spark.createDataFrame(
        [(i, 1, 1, float(i), i) for i in range(k)],
        "CustomerID bigint, Recency bigint, Frequency bigint, Monetary double, Cluster int",
    )
    named = rfm.name_clusters(rfm.cluster_profile(df))
    names = [r.Segment for r in named.orderBy("Avg_Monetary", ascending=False).collect()]
    assert names == ["High Value", "Loyal", "Potential Loyalists", "At Risk", "Segment 5", "Segment 6"][:k]
    radar = rfm.radar(named).collect()
    assert {r.Avg_Recency_Norm for r in radar} == {None}
    assert {min(r.Avg_Monetary_Norm for r in radar), max(r.Avg_Monetary_Norm for r in radar)} == {0.0, 1.0}
    assert sum(r.Percentage for r in radar) == pytest.approx(100, abs=0.1)


def test_elbow_falls_and_segments_cover_everyone(spark):
    rows = [(i, i % 7, 1 + i % 5, float((i * 37) % 100)) for i in range(60)]
    df = spark.createDataFrame(rows, "CustomerID bigint, Recency bigint, Frequency bigint, Monetary double")
    curve = [r.inertia for r in segmentation.elbow(df, largest_k=4).orderBy("k").collect()]
    assert curve[0] == pytest.approx(180.0)  # three columns of variance 1
    assert curve == sorted(curve, reverse=True)
    assert segmentation.cluster(df, 3).select("CustomerID").distinct().count() == 60


def history(spark):
    day = dt.timedelta(days=1)
    return lines(
        spark,
        ("1", 1, T0, 1, 10),
        ("2", 1, T0 + 10 * day, 3, 10),
        ("3", 2, T0, 1, 7),
        ("4", 2, T0 + 200 * day, 1, 7),
        ("5", 3, T0 + 200 * day, 1, 7),
    )


def test_churn_features(spark):
    got = {r.CustomerID: r for r in churn.churn_features(history(spark), 90).collect()}
    assert set(got) == {1, 2}  # customer 3 has no history
    one, two = got[1], got[2]
    assert (one.Recency, one.CustomerAge, one.TotalTransactions, one.OrderCount) == (100, 10, 2, 2)
    assert (one.TotalSpend, one.AvgOrderValue, one.TotalItems, one.AvgItems) == (40.0, 20.0, 4, 2.0)
    assert one.OrderValueStd == pytest.approx(200**0.5) and one.ItemsStd == pytest.approx(2**0.5)
    assert one.PurchaseFrequency == pytest.approx(2 / 11) and one.Churned
    assert (two.TotalTransactions, two.OrderValueStd, two.ItemsStd, two.Churned) == (1, 0.0, 0.0, False)
    rate = churn.churn_rate(churn.churn_features(history(spark), 90)).first()
    assert (rate.Churned, rate.Retained, rate.ChurnRate) == (1, 1, 50.0)


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "CustomerID")
    first = {r.CustomerID for r in churn.split(df.repartition(1))[0].collect()}
    assert first == {r.CustomerID for r in churn.split(df.repartition(16))[0].collect()}
    assert 700 < len(first) < 800


def test_one_class_needs_no_forest(spark):
    features = churn_plan.labelled(history(spark), 90).filter("Churned")
    model = churn_plan.ChurnModel(None, 1.0)
    assert {r.Churn_Probability for r in model.predict(features).collect()} == {1.0}
    assert churn_plan.train(features).forest is None


def test_churn_analysis_learns_a_rule(spark):
    day = dt.timedelta(days=1)
    rows = []
    for c in range(120):
        gone = c % 2 == 0
        for i in range(3):
            rows.append((f"{c}-{i}", c, T0 + (i + (0 if gone else 60 + c % 20)) * day, 1 + c % 3, 5))
        if not gone:
            rows.append((f"{c}-x", c, T0 + 250 * day, 1, 5))
    rows.append(("last", 999, T0 + 300 * day, 1, 5))
    out = churn_plan.analyse(lines(spark, *rows), 90)
    assert out.accuracy.first().Accuracy > 0.95
    scored = out.scored.collect()
    assert len(scored) == 120 and all(0 <= r.Churn_Probability <= 1 for r in scored)
    total = sum(r.Predicted_0 + r.Predicted_1 for r in out.confusion.collect())
    assert total == {r.Class: r.Support for r in out.report.collect()}["accuracy"]
    assert out.importance.count() == 10
    risk = churn.at_risk(out.scored, 0.7).collect()
    assert risk and [r.Churn_Probability for r in risk] == sorted((r.Churn_Probability for r in risk), reverse=True)


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    rows = {r.Class: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].Precision, rows["1"].Recall, rows["1"].F1, rows["1"].Support) == (0.0, 0.0, 0.0, 1)
    assert rows["0"].Precision == pytest.approx(2 / 3) and rows["0"].F1 == pytest.approx(0.8)
    assert rows["accuracy"].F1 == pytest.approx(2 / 3) and rows["macro avg"].F1 == pytest.approx(0.4)
    assert rows["weighted avg"].Recall == pytest.approx(2 / 3)


@pytest.mark.parametrize("parts", [1, 16])
def test_results_do_not_depend_on_layout(spark, parts):
    from tallybook.operators import clv, recommend

    day = dt.timedelta(days=1)
    tx = lines(spark, *[(str(i % 40), i % 9, T0 + (i % 40) * day, 1 + i % 4, 3 + i % 5) for i in range(200)])
    tx = tx.withColumn("StockCode", (tx.Quantity * 3 + tx.CustomerID % 4).cast("string"))

    def results(log):
        found = [
            rfm.rfm(log),
            churn.churn_features(log, 10).drop("OrderValueStd", "ItemsStd"),
            clv.customer_base(log),
            recommend.customer_top_products(log),
            recommend.item_recommendations(log, 3),
            recommend.similar_customers(log, 3),
        ]
        return [sorted(map(tuple, df.select(sorted(df.columns)).collect())) for df in found]

    assert results(tx.repartition(parts)) == results(tx)
