"""Names, windows and labels that every result has to agree on."""

TRANSACTION_COLUMNS = [
    "InvoiceNo",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "UnitPrice",
    "CustomerID",
    "Country",
]

RFM_METRICS = ["Recency", "Frequency", "Monetary"]

# Segment names by descending average spend; further clusters are "Segment 5", "Segment 6", ...
SEGMENT_NAMES = ["High Value", "Loyal", "Potential Loyalists", "At Risk"]

CHURN_FEATURES = [
    "Recency",
    "CustomerAge",
    "TotalTransactions",
    "OrderCount",
    "TotalSpend",
    "AvgOrderValue",
    "OrderValueStd",
    "TotalItems",
    "AvgItems",
    "ItemsStd",
    "PurchaseFrequency",
]

LAGS = [1, 7, 14, 30]
ROLLING_WINDOWS = [7, 14, 30]
FORECAST_FEATURES = (
    ["Day", "Month", "Year", "DayOfWeek", "WeekOfYear"]
    + [f"Revenue_Lag_{n}" for n in LAGS]
    + [f"Revenue_Rolling_{s}_{w}" for w in ROLLING_WINDOWS for s in ("Mean", "Std")]
)

# CLV quartile labels, lowest first.
CLV_LABELS = ["Low Value", "Medium Value", "High Value", "Top Value"]

# Text forms of InvoiceDate that are understood besides ISO 8601, tried in this order.
DATE_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy"]
