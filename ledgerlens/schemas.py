"""Schemas, enumerations and defaults of the transaction data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the source system's values for results to
# match; they are stated here once, in their natural order.
# ---------------------------------------------------------------------------

# Accepted transaction statuses (exact, case-sensitive).
VALID_STATUSES = ["completed", "pending", "failed"]

# Columns the cleaning step strips of surrounding whitespace, in this order.
TRIM_COLUMNS = ["province", "age_group", "account_type", "merchant", "category", "currency", "status"]

# The 13 columns of the transactions file, in file order.
CSV_COLUMNS = [
    "transaction_id", "customer_id", "province", "age_group", "account_type",
    "merchant", "category", "amount", "currency", "status",
    "txn_date", "txn_month", "txn_year",
]

# Column defaults of the stored tables (a default fills an omitted column only).
ORGANIZATION_DEFAULTS = {"plan": "free", "status": "active", "max_users": 5, "max_rows": 100000}

# Insight types, in prompt order.
# Width of a stored insight's title.
TITLE_LENGTH = 255
INSIGHT_TYPES = ["summary", "anomaly", "recommendation"]

# Insight prompts keyed by type; unknown types fall back to the summary prompt.
INSIGHT_PROMPTS = {
    "summary": "Provide a concise executive summary of this organization's financial transaction data. Highlight the most important trends.",
    "anomaly": "Analyze this transaction data for anomalies, unusual patterns, or outliers that a finance team should be aware of.",
    "recommendation": "Based on this transaction data, provide 2-3 actionable recommendations to optimize spending or improve financial health.",
}
DEFAULT_INSIGHT_TYPE = "summary"

# Placeholder written when no text generator is configured.
PLACEHOLDER_TITLE = "AI insights unavailable"
PLACEHOLDER_CONTENT = "Configure a text generator to enable AI-generated insights."

# Context text layout.
CONTEXT_MONTH_HEADER = "Monthly revenue data:\n"
CONTEXT_CATEGORY_HEADER = "\nCategory breakdown:\n"

# Newest months per org in the insight context, and the insight list size.
CONTEXT_MONTHS = 12
LATEST_INSIGHTS = 20

# Page size of batched inserts.
INSERT_BATCH_ROWS = 500

# Data-quality rule parameters documented for the demo data set.
EXPECTED_ROW_COUNT = 5000
REVENUE_FLOOR = 1000000

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------

MONEY_RAW = T.DecimalType(12, 2)      # raw layer amount
MONEY = T.DecimalType(15, 2)          # tenant layer amount
CONFIDENCE = T.DecimalType(5, 4)

CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in CSV_COLUMNS])

# Widths of the raw table's text columns.
RAW_LENGTHS = {"province": 5, "age_group": 10, "account_type": 20, "merchant": 100, "category": 50, "currency": 5,
               "status": 20, "txn_month": 7}

RAW_TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("province", T.StringType(), False),
    T.StructField("age_group", T.StringType(), False),
    T.StructField("account_type", T.StringType(), False),
    T.StructField("merchant", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("amount", MONEY_RAW, False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("txn_date", T.DateType(), False),
    T.StructField("txn_month", T.StringType(), False),
    T.StructField("txn_year", T.IntegerType(), False),
    T.StructField("ingested_at", T.TimestampNTZType(), False),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("org_id", T.StringType(), False),
    T.StructField("source_id", T.StringType(), True),
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_ref", T.StringType(), True),
    T.StructField("province", T.StringType(), True),
    T.StructField("age_group", T.StringType(), True),
    T.StructField("account_type", T.StringType(), True),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("amount", MONEY, False),
    T.StructField("currency", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("txn_date", T.DateType(), False),
    T.StructField("txn_month", T.StringType(), True),
    T.StructField("txn_year", T.IntegerType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("loaded_at", T.TimestampNTZType(), False),
])

PIPELINE_RUNS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("run_at", T.TimestampNTZType(), False),
    T.StructField("rows_loaded", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("notes", T.StringType(), True),
])

# States of tenant runs: running, then success or failed.
TENANT_RUN_STATES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("org_id", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("rows_loaded", T.LongType(), True),
    T.StructField("rows_failed", T.LongType(), False),
    T.StructField("error", T.StringType(), True),
    T.StructField("at", T.TimestampNTZType(), False),
])

AI_INSIGHTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("org_id", T.StringType(), False),
    T.StructField("run_id", T.StringType(), True),
    T.StructField("type", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("confidence", CONFIDENCE, True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
])

# Stored types of defaulted organization columns.
ORGANIZATION_DEFAULT_TYPES = {"max_users": "int", "max_rows": "bigint"}
