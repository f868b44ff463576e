"""SQL twins of the registered queries, for checking results with another engine."""

from __future__ import annotations

from tallybook.constants import CHURN_FEATURES, FORECAST_FEATURES

# Parameters shared with the registered queries.
CHURN_DAYS = 90
HORIZON = 30
BGNBD = {"r": 0.8, "alpha": 60.0, "a": 0.7, "b": 2.5}
GAMMA_GAMMA = {"p": 6.0, "q": 4.0, "v": 15000.0}
CLV_DAYS = 180

RAW = """
raw AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         p_name AS Description,
         CAST(l_quantity AS INTEGER) AS Quantity,
         o_orderdate AS InvoiceDate,
         CAST(p_retailprice AS DECIMAL(12,4)) AS UnitPrice,
         o_custkey AS CustomerID,
         n_name AS Country
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

TX = RAW + """,
tx AS (
  SELECT *, CAST(Quantity * UnitPrice AS DECIMAL(18,4)) AS TotalPrice
  FROM raw
  WHERE CustomerID IS NOT NULL AND NOT contains(InvoiceNo, 'C') AND Quantity > 0 AND UnitPrice > 0
)"""

RFM = TX + """,
rfm AS (
  SELECT CustomerID,
         CAST(date_sub('day', max(InvoiceDate), (SELECT max(InvoiceDate) FROM tx) + INTERVAL 1 DAY) AS BIGINT) AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(TotalPrice) AS DOUBLE) AS Monetary
  FROM tx GROUP BY CustomerID
)"""

# Clusters by a rule, so that profiles can be checked without k-means.
PROFILE = RFM + """,
clustered AS (SELECT *, CAST(least(5, Frequency // 3) AS INTEGER) AS Cluster FROM rfm),
profile AS (
  SELECT Cluster, avg(Recency) AS Avg_Recency, avg(Frequency) AS Avg_Frequency, avg(Monetary) AS Avg_Monetary,
         count(*) AS Customer_Count
  FROM clustered GROUP BY Cluster
),
named AS (
  SELECT *, round_even(Customer_Count * 100.0::DOUBLE / sum(Customer_Count) OVER (), 2) AS Percentage,
         row_number() OVER (ORDER BY Avg_Monetary DESC, Cluster) AS rk
  FROM profile
),
segments AS (
  SELECT * EXCLUDE (rk),
         CASE rk WHEN 1 THEN 'High Value' WHEN 2 THEN 'Loyal' WHEN 3 THEN 'Potential Loyalists'
                 WHEN 4 THEN 'At Risk' ELSE 'Segment ' || CAST(rk AS VARCHAR) END AS Segment
  FROM named
)"""

CHURN = TX + f""",
edge AS (SELECT max(InvoiceDate) AS snapshot, max(InvoiceDate) - INTERVAL {CHURN_DAYS} DAY AS boundary FROM tx),
hist AS (SELECT tx.*, boundary FROM tx, edge WHERE InvoiceDate <= boundary),
pred AS (SELECT DISTINCT CustomerID FROM tx, edge WHERE InvoiceDate > boundary),
base AS (
  SELECT CustomerID,
         CAST(date_sub('day', max(InvoiceDate), any_value(boundary)) AS BIGINT) AS Recency,
         CAST(date_sub('day', min(InvoiceDate), max(InvoiceDate)) AS BIGINT) AS CustomerAge,
         count(*) AS TotalTransactions,
         count(DISTINCT InvoiceNo) AS OrderCount,
         CAST(sum(TotalPrice) AS DOUBLE) AS TotalSpend,
         CAST(sum(TotalPrice) AS DOUBLE) / count(*) AS AvgOrderValue,
         coalesce(stddev_samp(CAST(TotalPrice AS DOUBLE)), 0) AS OrderValueStd,
         CAST(sum(Quantity) AS BIGINT) AS TotalItems,
         CAST(sum(Quantity) AS DOUBLE) / count(*) AS AvgItems,
         coalesce(stddev_samp(Quantity), 0) AS ItemsStd
  FROM hist GROUP BY CustomerID
),
features AS (
  SELECT *, OrderCount / CAST(CustomerAge + 1 AS DOUBLE) AS PurchaseFrequency,
         CustomerID NOT IN (SELECT CustomerID FROM pred) AS Churned
  FROM base
),
scored AS (
  SELECT *, Recency / (Recency + 100.0::DOUBLE) AS Churn_Probability,
         CASE WHEN Churned THEN 1 ELSE 0 END AS label,
         CASE WHEN Recency / (Recency + 100.0::DOUBLE) >= 0.6 THEN 1 ELSE 0 END AS prediction
  FROM features
)"""

DAILY = TX + """,
daily AS (
  SELECT CAST(InvoiceDate AS DATE) AS Date, CAST(sum(TotalPrice) AS DOUBLE) AS Revenue
  FROM tx WHERE InvoiceDate IS NOT NULL GROUP BY 1
)"""


def _calendar(source: str) -> str:
    return (
        "SELECT *, CAST(day(Date) AS INTEGER) AS Day, CAST(month(Date) AS INTEGER) AS Month, "
        "CAST(year(Date) AS INTEGER) AS Year, CAST(isodow(Date) - 1 AS INTEGER) AS DayOfWeek, "
        f"CAST(weekofyear(Date) AS INTEGER) AS WeekOfYear FROM {source}"
    )


_LAG = ", ".join(f"lag(Revenue, {n}) OVER (ORDER BY Date) AS Revenue_Lag_{n}" for n in (1, 7, 14, 30))
_ROLL = ", ".join(
    f"{fn}(Revenue) OVER (ORDER BY Date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS Revenue_Rolling_{name}_{w}"
    for w in (7, 14, 30)
    for name, fn in (("Mean", "avg"), ("Std", "stddev_samp"))
)
SERIES = DAILY + f""",
series AS (
  SELECT * FROM (
    SELECT *, {_LAG}, {_ROLL} FROM ({_calendar("daily")}) c
  ) f WHERE Revenue_Lag_30 IS NOT NULL
),
aged AS (SELECT *, row_number() OVER (ORDER BY Date DESC) AS age FROM series),
parted AS (
  SELECT *, row_number() OVER (ORDER BY Date) <= floor(count(*) OVER () * 0.8::DOUBLE) AS IsTrain FROM series
)"""

_LAST = ", ".join(f"max(CASE WHEN age = {n} THEN Revenue END) AS Revenue_Lag_{n}" for n in (1, 7, 14, 30))
_LAST_ROLL = ", ".join(
    f"{fn}(CASE WHEN age <= {w} THEN Revenue END) AS Revenue_Rolling_{name}_{w}"
    for w in (7, 14, 30)
    for name, fn in (("Mean", "avg"), ("Std", "stddev_samp"))
)
FUTURE = SERIES + f""",
last AS (SELECT max(Date) AS last_date, count(*) AS days, {_LAST}, {_LAST_ROLL} FROM aged),
spine AS (
  SELECT CAST(last_date + CAST(i AS INTEGER) AS DATE) AS Date, last.* EXCLUDE (last_date, days)
  FROM last, range(1, {HORIZON + 1}) t(i) WHERE days >= 30
),
future AS ({_calendar("spine")}),
forecast AS (SELECT *, Revenue_Rolling_Mean_7 + 100.0::DOUBLE * DayOfWeek AS Predicted_Revenue FROM future),
tested AS (SELECT Date, Revenue AS Actual, Revenue_Lag_7 AS Predicted FROM parted WHERE NOT IsTrain),
quality AS (
  SELECT sqrt(avg((Actual - Predicted) ** 2)) AS RMSE,
         1 - sum((Actual - Predicted) ** 2) / sum((Actual - m) ** 2) AS R2
  FROM tested, (SELECT avg(Actual) AS m FROM tested)
)"""

BASKET = TX + """,
basket AS (SELECT InvoiceNo, StockCode FROM tx GROUP BY ALL HAVING sum(Quantity) > 0),
owned AS (SELECT CustomerID, StockCode FROM tx GROUP BY ALL HAVING sum(Quantity) > 0),
pairs AS (
  SELECT x.StockCode AS A, y.StockCode AS B, count(*) AS n
  FROM basket x JOIN basket y ON x.InvoiceNo = y.InvoiceNo AND x.StockCode <> y.StockCode
  GROUP BY ALL
),
descriptions AS (
  SELECT StockCode, Description FROM (
    SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY count(*) DESC, Description) AS rn
    FROM tx WHERE Description IS NOT NULL GROUP BY StockCode, Description
  ) WHERE rn = 1
),
lines AS (
  SELECT StockCode, CAST(sum(Quantity) AS BIGINT) AS Quantity, CAST(sum(TotalPrice) AS DOUBLE) AS TotalPrice,
         count(Quantity) AS n
  FROM tx GROUP BY StockCode
),
metrics AS (
  SELECT StockCode, Quantity, TotalPrice,
         (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE) / count(*) OVER () AS Popularity
  FROM lines
)"""

SIMILAR = BASKET + """,
sizes AS (SELECT CustomerID, count(*) AS s FROM owned GROUP BY CustomerID),
common AS (
  SELECT x.CustomerID, y.CustomerID AS SimilarID, count(*) AS c
  FROM owned x JOIN owned y ON x.StockCode = y.StockCode AND x.CustomerID <> y.CustomerID
  GROUP BY ALL
),
alike AS (
  SELECT * FROM (
    SELECT common.CustomerID, SimilarID, c / sqrt(p.s::DOUBLE * q.s) AS Similarity,
           row_number() OVER (PARTITION BY common.CustomerID ORDER BY (c * c)::DOUBLE / q.s DESC, SimilarID) AS Rank
    FROM common JOIN sizes p ON p.CustomerID = common.CustomerID JOIN sizes q ON q.CustomerID = SimilarID
  ) WHERE Rank <= 10
)"""

BASE = TX + """,
base AS (
  SELECT CustomerID,
         CAST(date_sub('day', max(InvoiceDate), (SELECT max(InvoiceDate) FROM tx)) AS BIGINT) AS Recency,
         count(DISTINCT InvoiceNo) AS Frequency,
         CAST(sum(TotalPrice) AS DOUBLE) AS MonetaryValue,
         count(*) AS LineCount,
         CAST(sum(TotalPrice) AS DOUBLE) / count(*) AS AvgOrderValue,
         CAST(date_sub('day', min(InvoiceDate), max(InvoiceDate)) + 1 AS BIGINT) AS T,
         CAST(date_sub('day', min(InvoiceDate), max(InvoiceDate)) AS BIGINT) AS ModelRecency,
         CAST(date_sub('day', min(InvoiceDate), (SELECT max(InvoiceDate) FROM tx)) AS BIGINT) AS ModelT
  FROM tx GROUP BY CustomerID
),
inputs AS (
  SELECT *, Frequency - 1 AS Repeats, MonetaryValue / Frequency AS OrderValue FROM base WHERE Frequency > 1
)"""

_R, _ALPHA, _A, _B = (BGNBD[k] for k in ("r", "alpha", "a", "b"))
_P, _Q, _V = (GAMMA_GAMMA[k] for k in ("p", "q", "v"))


def _alive(x: str, t_x: str, t: str) -> str:
    return (
        f"CASE WHEN {x} > 0 THEN 1 / (1 + {_A}::DOUBLE / ({_B}::DOUBLE + {x} - 1) * "
        f"pow(({_ALPHA}::DOUBLE + {t}) / ({_ALPHA}::DOUBLE + {t_x}), {_R}::DOUBLE + {x})) ELSE 1.0::DOUBLE END"
    )


# The published form with 2F1(r+x, b+x; c; z) as a plain power series.
EXPECTED = BASE + f""",
ends AS (SELECT unnest(range(30, {CLV_DAYS + 1}, 30))::DOUBLE AS h),
args AS (
  SELECT CustomerID, h, Repeats::DOUBLE AS x, ModelRecency::DOUBLE AS tx_, ModelT::DOUBLE AS t,
         {_A}::DOUBLE + {_B}::DOUBLE + Repeats - 1 AS c, h / ({_ALPHA}::DOUBLE + ModelT + h) AS z
  FROM inputs, ends
),
terms AS (
  SELECT CustomerID, h,
         product(({_R}::DOUBLE + x + n - 1) * ({_B}::DOUBLE + x + n - 1) / ((c + n - 1) * n) * z)
           OVER (PARTITION BY CustomerID, h ORDER BY n) AS term
  FROM args, range(1, 301) r(n)
),
hyper AS (SELECT CustomerID, h, 1 + sum(term) AS f FROM terms GROUP BY CustomerID, h),
expected AS (
  SELECT CustomerID, h,
         c / ({_A}::DOUBLE - 1) * (1 - pow(({_ALPHA}::DOUBLE + t) / ({_ALPHA}::DOUBLE + t + h), {_R}::DOUBLE + x) * f)
           * ({_alive("x", "tx_", "t")}) AS e
  FROM args JOIN hyper USING (CustomerID, h)
),
worth AS (
  SELECT CustomerID, sum(step * pow(1.01::DOUBLE, -h / 30)) AS orders
  FROM (SELECT CustomerID, h, e - coalesce(lag(e) OVER (PARTITION BY CustomerID ORDER BY h), 0) AS step FROM expected)
  GROUP BY CustomerID
),
clv AS (
  SELECT inputs.*, e AS Predicted_Purchases, {_alive("Repeats", "ModelRecency", "ModelT")} AS Prob_Alive,
         orders * {_P}::DOUBLE * ({_V}::DOUBLE + Repeats * OrderValue) / ({_P}::DOUBLE * Repeats + {_Q}::DOUBLE - 1) AS CLV
  FROM inputs JOIN worth USING (CustomerID) JOIN expected USING (CustomerID) WHERE expected.h = {CLV_DAYS}
)"""

SEGMENTED = EXPECTED + """,
edges AS (SELECT quantile_cont(CLV, [0.25, 0.5, 0.75]) AS q FROM clv),
quartiles AS (
  SELECT clv.*, CASE WHEN CLV <= q[1] THEN 'Low Value' WHEN CLV <= q[2] THEN 'Medium Value'
                     WHEN CLV <= q[3] THEN 'High Value' ELSE 'Top Value' END AS CLV_Segment
  FROM clv, edges
),
segment AS (
  SELECT CLV_Segment AS Segment, count(*) AS Count, avg(Frequency) AS Avg_Frequency, avg(MonetaryValue) AS Avg_Monetary,
         avg(Prob_Alive) AS Avg_Prob_Alive, avg(CLV) AS Avg_CLV, avg(CLV) * count(*) AS Total_CLV
  FROM quartiles GROUP BY CLV_Segment
)"""


def _r(*columns: str, places: int = 4) -> str:
    """Rounded columns under their own names; adding zero removes a negative zero."""
    return ", ".join(f"round({c}, {places}) + 0 AS {c}" for c in columns)


_FORECAST_COLUMNS = [f"Revenue_Lag_{n}" for n in (1, 7, 14, 30)] + [
    f"Revenue_Rolling_{name}_{w}" for w in (7, 14, 30) for name in ("Mean", "Std")
]
_CALENDAR_COLUMNS = "Day, Month, Year, DayOfWeek, WeekOfYear"
_DATE = "strftime(Date, '%Y-%m-%d') AS Date"
_LINE = (
    "InvoiceNo, StockCode, Description, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, "
    "CAST(UnitPrice AS DOUBLE) AS UnitPrice, CustomerID, Country, CAST(TotalPrice AS DOUBLE) AS TotalPrice"
)
_CLV_COLUMNS = _r("MonetaryValue", "Predicted_Purchases", "Prob_Alive", "CLV")


# Log-likelihoods of one customer; times and alpha are scaled as the fit scales them.
def _bgnbd_likelihood(r: str, al: str, a: str, b: str) -> str:
    return (
        f"lgamma({r} + x) - lgamma({r}) + {r} * ln({al}) + lgamma({a} + {b}) + lgamma({b} + x) - lgamma({b}) "
        f"- lgamma({a} + {b} + x) + ln(pow({al} + t, -({r} + x)) + {a} / ({b} + x - 1) * pow({al} + tx, -({r} + x)))"
    )


def _gg_likelihood(p: str, q: str, v: str) -> str:
    return (
        f"lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v}) + ({p} * x - 1) * ln(m) "
        f"+ {p} * x * ln(x) - ({p} * x + {q}) * ln({v} + m * x)"
    )


_BGNBD_LIKELIHOOD = _bgnbd_likelihood(_R, "al", _A, _B)
_GG_LIKELIHOOD = _gg_likelihood(_P, _Q, _V)
_SCALED = f"""(SELECT CAST(Repeats AS DOUBLE) AS x, CAST(ModelRecency AS DOUBLE) / s AS tx,
                             CAST(ModelT AS DOUBLE) / s AS t, {_ALPHA}::DOUBLE / s AS al, OrderValue AS m
                      FROM inputs, (SELECT max(ModelT) / 10.0::DOUBLE AS s FROM inputs))"""


def _slopes(model: str, parameters: dict[str, str], likelihood) -> str:
    """Differences of the mean log-likelihood by the logarithms of the parameters, one after and two after another."""
    h = "1e-3::DOUBLE"
    moved = [
        f"({value} * exp({h} * ((i = {k})::INTEGER * si + (j = {k})::INTEGER * sj)))"
        for k, value in enumerate(parameters.values())
    ]
    names = "[" + ", ".join(f"'{n}'" for n in parameters) + "]"
    return f"""SELECT '{model}' AS Model, {names}[CAST(i AS INTEGER) + 1] AS Parameter,
               CASE WHEN j < 0 THEN '' ELSE {names}[CAST(j AS INTEGER) + 1] END AS Other,
               round(sum(CASE WHEN j < 0 THEN si / (2 * {h}) ELSE si * sj / (4 * {h} * {h}) END * v), 4) AS Slope
               FROM (SELECT i, j, si, sj, avg({likelihood(*moved)}) AS v
                     FROM {_SCALED}, range(0, {len(moved)}) a(i), range(-1, {len(moved)}) b(j),
                          (VALUES (1), (-1)) c(si), (VALUES (1), (-1)) d(sj)
                     WHERE j >= i OR (j < 0 AND sj = 1) GROUP BY i, j, si, sj)
               GROUP BY i, j"""


def _names(features: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{f}')" for f in features) + ") AS t(Feature)"


def oracle_sql() -> dict[str, str]:
    ctes: dict[str, tuple[str, str]] = {
        "clean_transactions": (TX, f"SELECT {_LINE} FROM tx"),
        "preview": (
            TX,
            f"""SELECT {_LINE} FROM (SELECT * FROM tx ORDER BY tx.InvoiceDate, InvoiceNo, StockCode, Quantity, UnitPrice,
                CustomerID, Country, Description LIMIT 5)""",
        ),
        "overview_kpis": (
            TX,
            """SELECT count(*) AS Records, count(DISTINCT CustomerID) AS Customers,
               count(DISTINCT StockCode) AS Products, count(DISTINCT Country) AS Countries,
               strftime(min(InvoiceDate), '%Y-%m-%d') AS FirstDate, strftime(max(InvoiceDate), '%Y-%m-%d') AS LastDate,
               round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalRevenue,
               round((SELECT avg(s) FROM (SELECT CAST(sum(TotalPrice) AS DOUBLE) AS s FROM tx GROUP BY InvoiceNo)), 4)
                 AS AvgOrderValue
               FROM tx""",
        ),
        "daily_revenue": (DAILY, f"SELECT {_DATE}, {_r('Revenue')} FROM daily"),
        "top_countries": (
            TX,
            """SELECT Country, round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalPrice FROM tx GROUP BY Country
               ORDER BY sum(TotalPrice) DESC, Country LIMIT 10""",
        ),
        "top_products": (
            TX,
            """SELECT StockCode, Description, round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalPrice FROM tx
               WHERE Description IS NOT NULL GROUP BY StockCode, Description
               ORDER BY sum(TotalPrice) DESC, StockCode, Description LIMIT 10""",
        ),
        "rfm": (RFM, f"SELECT CustomerID, Recency, Frequency, {_r('Monetary')} FROM rfm"),
        "rfm_scaled": (
            RFM,
            "SELECT CustomerID, "
            + ", ".join(
                f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0 AS {c}_Scaled"
                for c in ("Recency", "Frequency", "Monetary")
            )
            + " FROM rfm",
        ),
        "cluster_profile": (
            PROFILE,
            f"SELECT Cluster, {_r('Avg_Recency', 'Avg_Frequency', 'Avg_Monetary')}, Customer_Count, Percentage FROM segments",
        ),
        "cluster_names": (
            PROFILE,
            f"""SELECT CustomerID, Recency, Frequency, {_r('Monetary')}, Segment
                FROM clustered JOIN segments USING (Cluster)""",
        ),
        "radar": (
            PROFILE,
            """SELECT Segment, Customer_Count,
               round(1 - (Avg_Recency - min(Avg_Recency) OVER ()) / (max(Avg_Recency) OVER () - min(Avg_Recency) OVER ()), 6)
                 AS Avg_Recency_Norm,
               round((Avg_Frequency - min(Avg_Frequency) OVER ()) / (max(Avg_Frequency) OVER () - min(Avg_Frequency) OVER ()), 6)
                 AS Avg_Frequency_Norm,
               round((Avg_Monetary - min(Avg_Monetary) OVER ()) / (max(Avg_Monetary) OVER () - min(Avg_Monetary) OVER ()), 6)
                 AS Avg_Monetary_Norm
               FROM segments""",
        ),
        "segment_sizes": (PROFILE, "SELECT Segment, Customer_Count FROM segments"),
        "churn_period": (
            CHURN,
            """SELECT strftime(snapshot, '%Y-%m-%d %H:%M:%S') AS Snapshot, strftime(boundary, '%Y-%m-%d %H:%M:%S') AS Boundary,
               (SELECT count(*) FROM hist) AS HistoryLines,
               (SELECT count(*) FROM tx, edge WHERE InvoiceDate > boundary) AS OutcomeLines FROM edge""",
        ),
        "churn_features": (
            CHURN,
            f"""SELECT CustomerID, Recency, CustomerAge, TotalTransactions, OrderCount, TotalItems, Churned,
                {_r('TotalSpend', 'AvgOrderValue', 'OrderValueStd', 'AvgItems', 'ItemsStd')},
                {_r('PurchaseFrequency', places=8)} FROM features""",
        ),
        "churn_rate": (
            CHURN,
            """SELECT count(*) FILTER (Churned) AS Churned, count(*) FILTER (NOT Churned) AS Retained,
               round(avg(CASE WHEN Churned THEN 1.0::DOUBLE ELSE 0 END) * 100, 4) AS ChurnRate FROM features""",
        ),
        "recency_histogram": (
            CHURN,
            """SELECT Churned, CAST(Recency // 30 * 30 AS BIGINT) AS BinStart, count(*) AS Customers
               FROM features GROUP BY 1, 2""",
        ),
        "at_risk": (
            CHURN,
            """SELECT CustomerID, round(Churn_Probability, 8) AS Churn_Probability, Recency, round(TotalSpend, 4) AS TotalSpend,
               OrderCount, round(TotalSpend / (1 + Churn_Probability), 4) AS CLV_Estimation,
               round(TotalSpend / (1 + Churn_Probability) * Churn_Probability, 4) AS Prioritization_Score
               FROM scored WHERE Churn_Probability >= 0.7::DOUBLE""",
        ),
        "accuracy": (
            CHURN,
            "SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 8) AS Accuracy FROM scored",
        ),
        "confusion": (
            CHURN,
            """SELECT Actual, count(*) FILTER (prediction = 0) AS Predicted_0,
               count(*) FILTER (prediction = 1) AS Predicted_1
               FROM (VALUES (0), (1)) AS t(Actual) LEFT JOIN scored ON label = Actual GROUP BY Actual""",
        ),
        "report": (
            CHURN
            + """,
            classes AS (SELECT label AS k FROM scored UNION SELECT prediction FROM scored),
            parts AS (
              SELECT k, count(*) FILTER (label = k AND prediction = k) AS tp, count(*) FILTER (label = k) AS sup,
                     count(*) FILTER (prediction = k) AS pre
              FROM scored, classes GROUP BY k
            ),
            per AS (
              SELECT CAST(k AS VARCHAR) AS Class, CASE WHEN pre = 0 THEN 0 ELSE tp / pre::DOUBLE END AS Precision,
                     CASE WHEN sup = 0 THEN 0 ELSE tp / sup::DOUBLE END AS Recall,
                     CASE WHEN pre + sup = 0 THEN 0 ELSE 2 * tp / (pre + sup)::DOUBLE END AS F1, sup AS Support, tp
              FROM parts
            )""",
            """SELECT Class, round(Precision, 8) AS Precision, round(Recall, 8) AS Recall, round(F1, 8) AS F1,
                 CAST(Support AS BIGINT) AS Support FROM (
                 SELECT Class, Precision, Recall, F1, Support FROM per
                 UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(Support)::DOUBLE, sum(Support) FROM per
                 UNION ALL SELECT 'macro avg', avg(Precision), avg(Recall), avg(F1), sum(Support) FROM per
                 UNION ALL SELECT 'weighted avg', sum(Precision * Support) / sum(Support)::DOUBLE,
                   sum(Recall * Support) / sum(Support)::DOUBLE, sum(F1 * Support) / sum(Support)::DOUBLE, sum(Support)
                   FROM per)""",
        ),
        "forecast_features": (
            SERIES,
            f"SELECT {_DATE}, {_r('Revenue')}, {_CALENDAR_COLUMNS}, {_r(*_FORECAST_COLUMNS)} FROM series",
        ),
        "time_split": (SERIES, f"SELECT {_DATE}, {_r('Revenue')}, IsTrain FROM parted"),
        "future_features": (FUTURE, f"SELECT {_DATE}, {_CALENDAR_COLUMNS}, {_r(*_FORECAST_COLUMNS)} FROM future"),
        "history_and_forecast": (
            FUTURE,
            f"""SELECT {_DATE}, {_r('Historical', 'Forecast')} FROM (
                  SELECT Date, Revenue AS Historical, NULL::DOUBLE AS Forecast FROM series
                  UNION ALL SELECT Date, NULL, Predicted_Revenue FROM forecast)""",
        ),
        "band": (
            FUTURE,
            f"""SELECT {_DATE}, {_r('Predicted_Revenue')}, round(Predicted_Revenue - 1.96::DOUBLE * RMSE, 4) AS Lower,
                round(Predicted_Revenue + 1.96::DOUBLE * RMSE, 4) AS Upper FROM forecast, quality""",
        ),
        "forecast_summary": (
            FUTURE,
            f"""SELECT round(sum(Predicted_Revenue), 4) AS Total,
                round((sum(Predicted_Revenue) / (SELECT sum(Revenue) FROM aged WHERE age <= {HORIZON}) - 1) * 100, 6)
                  AS TotalChange,
                round(avg(Predicted_Revenue), 4) AS DailyMean,
                round((avg(Predicted_Revenue) / (SELECT avg(Revenue) FROM series) - 1) * 100, 6) AS DailyMeanChange,
                (SELECT strftime(Date, '%Y-%m-%d') FROM forecast ORDER BY Predicted_Revenue DESC, Date LIMIT 1) AS PeakDate,
                round(max(Predicted_Revenue), 4) AS PeakRevenue FROM forecast""",
        ),
        "actual_and_predicted": (FUTURE, f"SELECT {_DATE}, {_r('Actual', 'Predicted')} FROM tested"),
        "regression_metrics": (FUTURE, f"SELECT {_r('RMSE')}, {_r('R2', places=8)} FROM quality"),
        "basket": (BASKET, "SELECT InvoiceNo, StockCode FROM basket"),
        "co_occurrence": (BASKET, "SELECT A, B, n FROM pairs"),
        "product_lookup": (TX, "SELECT DISTINCT StockCode, Description FROM tx"),
        "product_descriptions": (BASKET, "SELECT StockCode, Description FROM descriptions"),
        "top_units": (BASKET, "SELECT StockCode, Quantity FROM lines ORDER BY Quantity DESC, StockCode LIMIT 20"),
        "top20_matrix": (
            BASKET
            + """,
            top AS (SELECT StockCode FROM lines ORDER BY Quantity DESC, StockCode LIMIT 20)""",
            """SELECT a.StockCode AS A, a.StockCode || ' - ' || substr(d.Description, 1, 20) || '...' AS Label_A,
               b.StockCode AS B, b.StockCode || ' - ' || substr(e.Description, 1, 20) || '...' AS Label_B,
               coalesce(n, 0) AS n
               FROM top a CROSS JOIN top b LEFT JOIN pairs ON pairs.A = a.StockCode AND pairs.B = b.StockCode
               JOIN descriptions d ON d.StockCode = a.StockCode JOIN descriptions e ON e.StockCode = b.StockCode""",
        ),
        "customer_lines": (TX, f"SELECT {_LINE} FROM tx WHERE CustomerID = (SELECT min(CustomerID) FROM tx)"),
        "customers": (TX, "SELECT DISTINCT CustomerID FROM tx"),
        "customer_kpis": (
            TX,
            """SELECT CustomerID, round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalPurchases,
               count(DISTINCT InvoiceNo) AS Orders, count(DISTINCT StockCode) AS UniqueProducts
               FROM tx GROUP BY CustomerID""",
        ),
        "customer_top5": (
            TX,
            """SELECT CustomerID, StockCode, CAST(q AS BIGINT) AS Quantity, round(CAST(p AS DOUBLE), 4) AS TotalPrice,
               d AS Description, CAST(rn AS INTEGER) AS Rank FROM (
                 SELECT CustomerID, StockCode, sum(Quantity) AS q, sum(TotalPrice) AS p,
                        arg_min(Description, (InvoiceDate, InvoiceNo, Description)) AS d,
                        row_number() OVER (PARTITION BY CustomerID ORDER BY sum(Quantity) DESC, StockCode) AS rn
                 FROM tx GROUP BY CustomerID, StockCode) WHERE rn <= 5""",
        ),
        "product_metrics": (
            BASKET,
            f"SELECT StockCode, Quantity, {_r('TotalPrice')}, {_r('Popularity', places=8)} FROM metrics",
        ),
        "item_recs": (
            BASKET
            + """,
            scores AS (
              SELECT CustomerID, B AS StockCode, CAST(sum(n) AS BIGINT) AS Score
              FROM owned JOIN pairs ON owned.StockCode = A GROUP BY ALL
            ),
            best AS (
              SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY Score DESC, StockCode) AS rn
              FROM scores s WHERE NOT EXISTS (
                SELECT 1 FROM owned o WHERE o.CustomerID = s.CustomerID AND o.StockCode = s.StockCode)
            )""",
            f"""SELECT CustomerID, CAST(rn AS INTEGER) AS Rank, StockCode, Description, Score, Quantity, {_r('TotalPrice')},
                {_r('Popularity', places=8)}
                FROM best LEFT JOIN descriptions USING (StockCode) LEFT JOIN metrics USING (StockCode) WHERE rn <= 10""",
        ),
        "similar_customers": (
            SIMILAR,
            f"SELECT CustomerID, CAST(Rank AS INTEGER) AS Rank, SimilarID, {_r('Similarity', places=8)} FROM alike",
        ),
        "user_recs": (
            SIMILAR
            + """,
            scores AS (
              SELECT s.CustomerID, o.StockCode, CAST(sum(CAST(round(Similarity / 1e-12::DOUBLE) AS BIGINT)) AS BIGINT) AS w
              FROM alike s JOIN owned o ON o.CustomerID = s.SimilarID GROUP BY ALL
            ),
            best AS (
              SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY w DESC, StockCode) AS rn
              FROM scores s WHERE NOT EXISTS (
                SELECT 1 FROM owned o WHERE o.CustomerID = s.CustomerID AND o.StockCode = s.StockCode)
            )""",
            f"""SELECT CustomerID, CAST(rn AS INTEGER) AS Rank, StockCode, Description, round(w * 1e-12::DOUBLE, 8) AS Score,
                Quantity, {_r('TotalPrice')}
                FROM best LEFT JOIN descriptions USING (StockCode) LEFT JOIN metrics USING (StockCode) WHERE rn <= 10""",
        ),
        "elbow": (
            RFM,
            """SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 1 THEN round((SELECT 3.0::DOUBLE * count(*) FROM rfm), 4) END
               AS Inertia_1, true AS Falls FROM range(1, 11) t(k)""",
        ),
        "kmeans_segments": (RFM, f"SELECT CustomerID, Recency, Frequency, {_r('Monetary')}, true AS Named FROM rfm"),
        "churn_model_scores": (CHURN, "SELECT CustomerID, Churned, true AS Valid FROM features"),
        "churn_importance": (TX, f"SELECT *, true AS Valid, 1.0::DOUBLE AS Total FROM {_names(CHURN_FEATURES)}"),
        "revenue_model": (FUTURE, f"SELECT {_DATE}, true AS Valid FROM future"),
        "revenue_importance": (
            SERIES,
            f"""SELECT *, true AS Valid, 1.0::DOUBLE AS Total FROM {_names(FORECAST_FEATURES)}
                WHERE (SELECT count(*) FROM parted WHERE IsTrain) >= 2""",
        ),
        "model_round_trip": (CHURN, "SELECT CustomerID, true AS Same FROM features"),
        "bgnbd_fit": (BASE, "SELECT count(*) > 0 AS Positive, count(*) > 0 AS Best FROM inputs"),
        "gg_fit": (BASE, "SELECT count(*) > 0 AS Positive, count(*) > 0 AS Best FROM inputs"),
        "likelihoods": (
            BASE,
            f"""SELECT round(avg({_BGNBD_LIKELIHOOD}), 4) AS BgNbd, round(avg({_GG_LIKELIHOOD}), 4) AS GammaGamma
                FROM {_SCALED}""",
        ),
        "fit_slopes": (
            BASE,
            _slopes("BG/NBD", {"r": _R, "alpha": "al", "a": _A, "b": _B}, _bgnbd_likelihood)
            + " UNION ALL "
            + _slopes("Gamma-Gamma", {"p": _P, "q": _Q, "v": _V}, _gg_likelihood),
        ),
        "clv_base": (
            BASE,
            f"""SELECT CustomerID, Recency, Frequency, {_r('MonetaryValue')}, LineCount, {_r('AvgOrderValue')}, T,
                ModelRecency, ModelT, Repeats, {_r('OrderValue')} FROM inputs""",
        ),
        "prob_alive": (
            BASE,
            f"SELECT CustomerID, round({_alive('Repeats', 'ModelRecency', 'ModelT')}, 8) AS Prob_Alive FROM inputs",
        ),
        "prob_alive_grid": (
            BASE,
            f"""SELECT CAST(f AS BIGINT) AS frequency, CAST(d AS BIGINT) AS recency, round({_alive('f', 'd', 'mt')}, 8) AS Prob_Alive
                FROM (SELECT max(Repeats) AS mx, max(ModelT) AS mt FROM inputs), range(0, 10000) a(f), range(0, 10000) b(d)
                WHERE f <= mx AND d <= mt""",
        ),
        "expected_purchases": (EXPECTED, f"SELECT CustomerID, {_r('Predicted_Purchases', places=6)} FROM clv"),
        "clv": (EXPECTED, f"SELECT CustomerID, Frequency, {_CLV_COLUMNS} FROM clv"),
        "clv_summary": (
            EXPECTED,
            """SELECT round(avg(CLV), 4) AS Mean, round(quantile_cont(CLV, 0.5), 4) AS Median, round(sum(CLV), 2) AS Total
               FROM clv""",
        ),
        "clv_histogram": (
            EXPECTED,
            """SELECT CAST(least(floor((CLV - lo) / (hi - lo) * 50), 49) AS INTEGER) AS Bin, count(*) AS Customers
               FROM clv, (SELECT min(CLV) AS lo, max(CLV) AS hi FROM clv) GROUP BY 1""",
        ),
        "clv_scatter": (
            EXPECTED,
            f"SELECT CustomerID, Frequency, {_r('Prob_Alive', 'CLV', 'MonetaryValue')} FROM clv",
        ),
        "top_clv": (
            EXPECTED,
            f"SELECT CustomerID, Frequency, {_CLV_COLUMNS} FROM (SELECT * FROM clv ORDER BY clv.CLV DESC, CustomerID LIMIT 20)",
        ),
        "clv_quartiles": (SEGMENTED, f"SELECT CustomerID, {_r('CLV')}, CLV_Segment FROM quartiles"),
        "clv_segments": (
            SEGMENTED,
            f"""SELECT Segment, Count, {_r('Avg_Frequency', 'Avg_Monetary', 'Avg_Prob_Alive', 'Avg_CLV')},
                round(Total_CLV, 2) AS Total_CLV, round(Count * 100.0::DOUBLE / sum(Count) OVER (), 6) AS Percentage,
                round(Total_CLV * 100 / sum(Total_CLV) OVER (), 6) AS CLV_Percentage FROM segment""",
        ),
        "clv_pies": (SEGMENTED, "SELECT Segment, Count, round(Total_CLV, 2) AS Total_CLV FROM segment"),
        "customer_value": (
            TX,
            """SELECT CustomerID, count(DISTINCT InvoiceNo) AS PurchaseCount,
               round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalSpend,
               round(CAST(sum(TotalPrice) AS DOUBLE) / count(DISTINCT InvoiceNo), 4) AS AvgOrderValue
               FROM tx GROUP BY CustomerID""",
        ),
        "top_customer_value": (
            TX,
            """SELECT CustomerID, count(DISTINCT InvoiceNo) AS PurchaseCount,
               round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS TotalSpend,
               round(CAST(sum(TotalPrice) AS DOUBLE) / count(DISTINCT InvoiceNo), 4) AS AvgOrderValue
               FROM tx GROUP BY CustomerID ORDER BY sum(TotalPrice) DESC, CustomerID LIMIT 20""",
        ),
        "csv_round_trip": (RFM, f"SELECT CustomerID, Recency, Frequency, {_r('Monetary')} FROM rfm"),
        "staged_round_trip": (DAILY, f"SELECT {_DATE}, {_r('Revenue')} FROM daily"),
        "revenue_model_round_trip": (FUTURE, f"SELECT {_DATE}, true AS Same FROM forecast"),
        "csv_latin1": (TX, "SELECT DISTINCT StockCode, Description || ' é' || StockCode AS Description FROM tx"),
        "csv_quarantine": (
            RAW,
            """SELECT Reason, count(*) AS Lines,
               CASE WHEN Reason = 'good' THEN round(CAST(sum(CAST(Quantity * UnitPrice AS DECIMAL(38,8)))
                 FILTER (NOT contains(InvoiceNo, 'C') AND Quantity > 0 AND UnitPrice > 0) AS DOUBLE), 4) END AS Revenue
               FROM (SELECT *, CASE CAST(replace(InvoiceNo, 'C', '') AS BIGINT) % 40 WHEN 0 THEN 'fields' WHEN 1 THEN 'fields'
                       WHEN 2 THEN 'quotes' WHEN 3 THEN 'Quantity' WHEN 4 THEN 'InvoiceDate' WHEN 5 THEN 'UnitPrice'
                       WHEN 6 THEN 'CustomerID' ELSE 'good' END AS Reason FROM raw)
               GROUP BY Reason""",
        ),
        "incremental_months": (
            TX,
            """SELECT *, State AS Derived FROM (
                 SELECT InvoiceMonth, count(*) AS Lines,
                   CASE WHEN InvoiceMonth = max(max(InvoiceMonth)) OVER () THEN 'new'
                        WHEN InvoiceMonth = min(min(InvoiceMonth)) OVER () AND bool_or(ends_with(InvoiceNo, '1')) THEN 'changed'
                        ELSE 'same' END AS State
                 FROM (SELECT InvoiceNo, strftime(InvoiceDate, '%Y-%m') AS InvoiceMonth FROM tx) GROUP BY InvoiceMonth)""",
        ),
        "incremental_daily": (DAILY, f"SELECT {_DATE}, {_r('Revenue')} FROM daily"),
        "distinct_sketches": (
            TX,
            """SELECT strftime(InvoiceDate, '%Y-%m') AS Month, count(*) AS Records,
               round(CAST(sum(TotalPrice) AS DOUBLE), 4) AS Revenue, count(DISTINCT CustomerID) AS Customers,
               count(DISTINCT StockCode) AS Products, count(DISTINCT InvoiceNo) AS Invoices, true AS Within
               FROM tx GROUP BY Month""",
        ),
        "quantile_sketches": (
            TX, "SELECT Country, count(DISTINCT InvoiceNo) AS Invoices, true AS Within FROM tx GROUP BY Country"
        ),
        "export_forecast": (FUTURE, f"SELECT {_DATE}, {_r('Predicted_Revenue')} FROM forecast"),
    }
    # what is written and read back, or reached by another way, equals the plain query
    for name, plain in {
        "export_segments": "cluster_names",
        "export_at_risk": "at_risk",
        "export_clv": "clv",
        "customer_value_fallback": "customer_value",
        "item_recs_hot": "item_recs",
        "similar_customers_hot": "similar_customers",
        "user_recs_hot": "user_recs",
    }.items():
        ctes[name] = ctes[plain]
    recommended, listed = ctes["item_recs"]
    ctes["item_recs_top5"] = (
        recommended,
        f"SELECT CustomerID, Rank, StockCode, Description, Score FROM ({listed}) WHERE Rank <= 5",
    )
    return {name: f"WITH {with_part.strip()}\n{select}" for name, (with_part, select) in ctes.items()}
