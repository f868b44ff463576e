"""A store refreshed by month, quarantined lines, and states that merge."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallybook.operators import sketches
from tallybook.sources import incremental
from tallybook.sources import transactions as sources

COLUMNS = "InvoiceNo string, InvoiceDate timestamp_ntz, TotalPrice decimal(18,4)"


def log(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("TotalPrice", F.col("TotalPrice").cast("decimal(18,4)")).repartition(3)


def lines(seed, months=("2020-01", "2020-02", "2020-03"), n=12):
    r = random.Random(seed)
    return [
        (f"{m}/{i}", dt.datetime.strptime(f"{m}-{1 + i}", "%Y-%m-%d"), __import__("decimal").Decimal(r.randrange(1, 999)) / 100)
        for m in months
        for i in range(n)
    ]


def files(path):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet")
    }


def per_month(rows):
    return rows.groupBy(incremental.MONTH).agg(F.sum("TotalPrice").alias("Total"), F.count(F.lit(1)).alias("n"))


def states(df):
    return {r[0]: r.State for r in df.collect()}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("InvoiceNo", "InvoiceDate", "TotalPrice").collect())


def test_refresh_equals_a_full_run_and_leaves_other_months(spark, tmp_path):
    path, derived, whole = (str(tmp_path / n) for n in ("log", "derived", "whole"))
    first = lines(1)
    assert set(states(incremental.refresh(log(spark, first), path)).values()) == {"new"}
    incremental.refresh_derived(spark, path, derived, per_month)
    before, before_derived = files(f"{path}/months"), files(f"{derived}/months")

    # a late month, a changed one, a repeated line
    late = [*first[:12], *first[12:23], ("late", dt.datetime(2020, 2, 9), first[0][2]), *first[24:], first[30], *lines(2, ("2020-04",))]
    assert states(incremental.refresh(log(spark, late), path)) == {
        "2020-01": "same", "2020-02": "changed", "2020-03": "changed", "2020-04": "new",
    }
    seen = []

    def derive(rows):
        seen.extend(r[0] for r in rows.select(incremental.MONTH).distinct().collect())
        return per_month(rows)

    assert states(incremental.refresh_derived(spark, path, derived, derive))["2020-01"] == "same"
    assert sorted(seen) == ["2020-02", "2020-03", "2020-04"]
    for was, folder in ((before, path), (before_derived, derived)):
        now = files(f"{folder}/months")
        kept = {f: t for f, t in was.items() if "2020-01" in f}
        assert kept and all(now.get(f) == t for f, t in kept.items())
        assert not any("2020-02" in f and f in now for f in was)

    incremental.refresh(log(spark, late), whole)
    assert rows_of(incremental.read(spark, path)) == rows_of(incremental.read(spark, whole)) == sorted(late)
    got = {tuple(r) for r in incremental.read(spark, derived).select(incremental.MONTH, "Total", "n").collect()}
    assert got == {tuple(r) for r in per_month(incremental.read(spark, whole)).select(incremental.MONTH, "Total", "n").collect()}


def test_refresh_without_change_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    given = lines(3)
    incremental.refresh(log(spark, given), path)
    before = files(path)
    shuffled = given[:]
    random.Random(1).shuffle(shuffled)
    assert set(states(incremental.refresh(log(spark, shuffled), path)).values()) == {"same"}
    assert files(path) == before


def test_months_that_go_and_lines_without_a_date(spark, tmp_path):
    path, derived = str(tmp_path / "log"), str(tmp_path / "derived")
    given = [*lines(4, ("2020-01", "2020-02")), ("undated", None, lines(4)[0][2])]
    assert states(incremental.refresh(log(spark, given), path)) == {"2020-01": "new", "2020-02": "new", "": "new"}
    incremental.refresh_derived(spark, path, derived, per_month)
    assert incremental.read(spark, path).filter("InvoiceMonth = ''").count() == 1
    fewer = given[12:]
    assert states(incremental.refresh(log(spark, fewer), path))["2020-01"] == "gone"
    assert incremental.read(spark, path).count() == len(fewer)
    assert states(incremental.refresh_derived(spark, path, derived, per_month))["2020-01"] == "gone"
    assert incremental.read(spark, derived).count() == 2
    incremental.refresh(log(spark, []), path)
    assert incremental.read(spark, path).count() == 0
    assert set(states(incremental.refresh(log(spark, given), path)).values()) == {"new"}


def test_a_store_that_is_not_there(spark, tmp_path):
    assert incremental.manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="no months"):
        incremental.refresh_derived(spark, str(tmp_path / "none"), str(tmp_path / "d"), per_month)


HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"


def test_bad_lines_are_kept_with_a_reason(spark, tmp_path):
    text = [
        HEADER,
        '1,A,"a ""quoted"", name",6,12/1/2010 8:26,2.55,17850.0,UK',
        "2,A,plain,6,2010-12-01 08:26:00,2.55,,UK",
        "3,A,more,6,12/1/2010 8:26,2.55,17850,UK,extra",
        "4,A,fewer,6",
        '5,A,"open,6,12/1/2010 8:26,2.55,17850,UK',
        "6,A,name,six,12/1/2010 8:26,2.55,17850,UK",
        "7,A,name,6,someday,2.55,17850,UK",
        "8,A,name,6,12/1/2010 8:26,1.2.3,17850,UK",
        "9,A,name,x,12/1/2010 8:26,2.55,nobody,UK",
        "10,,,,,,,",
    ]
    path = tmp_path / "log.csv"
    path.write_text("\n".join(text) + "\n")
    found = sources.read_with_reasons(spark, str(path))
    good, bad = sources.quarantine(found, str(tmp_path / "out"))
    assert {r.InvoiceNo for r in good.collect()} == {"1", "2", "10"}
    assert good.filter("InvoiceNo = '1'").first().Description == 'a "quoted", name'
    reasons = {r.Line.split(",")[0]: (r.Reason, r.Line) for r in bad.collect()}
    assert {k: v[0] for k, v in reasons.items()} == {
        "3": "fields", "4": "fields", "5": "quotes", "6": "Quantity", "7": "InvoiceDate", "8": "UnitPrice", "9": "CustomerID",
    }
    assert all(line in text for _, line in reasons.values())
    typed = {r.InvoiceNo: r for r in sources.read_transactions(spark, str(path)).collect()}
    assert typed["1"].CustomerID == good.filter("InvoiceNo = '1'").first().CustomerID == 17850


def test_states_of_days_merge_to_any_range(spark):
    r = random.Random(5)
    rows = [
        (dt.datetime(2020, 1 + i % 3, 1 + r.randrange(27)), r.choice("AB"), r.randrange(30_000), f"P{r.randrange(3000)}", f"I{i // 2}")
        for i in range(40_000)
    ]
    tx = spark.createDataFrame(rows, "InvoiceDate timestamp_ntz, Country string, CustomerID long, StockCode string, InvoiceNo string")
    tx = tx.withColumn("TotalPrice", F.lit(1).cast("decimal(18,4)"))
    days = sketches.distinct_states(tx)
    once = sketches.distinct_counts(sketches.merge_distinct(days)).first()
    by_country = sketches.merge_distinct(days, "Country")
    twice = sketches.distinct_counts(sketches.merge_distinct(by_country)).first()
    assert once.Records == twice.Records == 40_000
    for name, i in (("Customers", 2), ("Products", 3), ("Invoices", 4)):
        exact = len({row[i] for row in rows})
        assert abs(once[name] - exact) <= sketches.distinct_error() * exact
        assert abs(twice[name] - exact) <= sketches.distinct_error() * exact


def test_quantile_states_merge_within_the_rank_error(spark):
    r = random.Random(6)
    rows = [(f"M{i % 12}", r.choice("AB"), None if i % 100 == 0 else r.expovariate(1)) for i in range(50_000)]
    values = spark.createDataFrame(rows, "Month string, Country string, V double")
    merged = sketches.merge_quantiles(sketches.quantile_states(values, "V", "Month", "Country"), "Country")
    got = {x.Country: x for x in sketches.quantiles(merged, {"Q1": 0.25, "Median": 0.5}).collect()}
    exact = defaultdict(list)
    for _, c, v in rows:
        if v is not None:
            exact[c].append(v)
    for c, vs in exact.items():
        assert got[c].Values == len(vs)
        for name, q in (("Q1", 0.25), ("Median", 0.5)):
            rank = sum(v <= got[c][name] for v in vs) / len(vs)
            assert abs(rank - q) <= 1.5 * sketches.rank_error()
    assert sketches.merge_quantiles(sketches.quantile_states(values.filter("false"), "V", "Month"), "Month").count() == 0
