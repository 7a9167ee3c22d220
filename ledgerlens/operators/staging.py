"""Staging projection and row filters (PRJ-1..8).

All are narrow transformations: no shuffle, and every predicate is a plain
column comparison that Catalyst merges and pushes into the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_key, year_int
from ..schemas import VALID_STATUSES

# Staging output columns in order: (source column, output name).
STAGING_COLUMNS = [
    ("id", "txn_pk"),
    ("transaction_id", "transaction_id"),
    ("customer_ref", "customer_ref"),
    ("org_id", "org_id"),
    ("province", "province"),
    ("age_group", "age_group"),
    ("account_type", "account_type"),
    ("merchant", "merchant"),
    ("category", "category"),
    ("amount", "amount"),
    ("currency", "currency"),
    ("status", "status"),
    ("txn_date", "txn_date"),
    ("txn_month", "txn_month"),
    ("txn_year", "txn_year"),
    ("loaded_at", "_loaded_at"),
]


def staged_predicate_sql() -> str:
    """SQL text of the staging row filter (PRJ-2 and PRJ-3 together), for
    aggregates that evaluate a staging measure inside a pass over the source."""
    statuses = ", ".join(f"'{s}'" for s in VALID_STATUSES)
    return f"(amount > 0 AND status IN ({statuses}))"


def filter_positive(df: DataFrame, amount: str = "amount") -> DataFrame:
    """PRJ-2: keep ``amount > 0``; a null amount is dropped."""
    return df.where(F.col(amount) > 0)


def filter_status(df: DataFrame, status: str = "status") -> DataFrame:
    """PRJ-3: exact, case-sensitive status whitelist; null is dropped."""
    return df.where(F.col(status).isin(*VALID_STATUSES))


def stg_transactions(tx: DataFrame) -> DataFrame:
    """PRJ-1: the 16-column staging view over tenant transactions."""
    kept = filter_status(filter_positive(tx))
    return kept.select(*[F.col(src).alias(dst) for src, dst in STAGING_COLUMNS])


def fct_revenue(stg: DataFrame) -> DataFrame:
    """PRJ-4: completed transactions only."""
    return stg.where(F.col("status") == "completed")


def for_tenant(df: DataFrame, org_id: str | None) -> DataFrame:
    """PRJ-5: rows of one tenant.  An unset tenant raises instead of
    silently returning every tenant's rows."""
    if org_id is None or str(org_id) == "":
        raise ValueError("org_id is required: refusing to read across tenants")
    return df.where(F.col("org_id") == F.lit(str(org_id)))


def with_calendar(df: DataFrame, date_col: str = "txn_date") -> DataFrame:
    """PRJ-6: ``txn_month`` (yyyy-MM) and ``txn_year`` from the date."""
    return df.withColumn("txn_month", month_key(date_col)).withColumn("txn_year", year_int(date_col))


def active(df: DataFrame, deleted_col: str = "deleted_at") -> DataFrame:
    """PRJ-7: soft-delete filter."""
    return df.where(F.col(deleted_col).isNull())


def valid_tokens(tokens: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """PRJ-8: not revoked and ``expires_at > as_of`` (strict)."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at") > ts))
