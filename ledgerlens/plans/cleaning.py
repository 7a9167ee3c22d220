"""Cleaning queries (CLN-1..7, PRJ-2/3, AGG-7) over the dirty raw fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import marts as M
from ..operators import staging as S
from ..schemas import CSV_COLUMNS, TRIM_COLUMNS
from ..sources import fixtures as FX
from .oracle import CTE_RAW_DIRTY, CTE_TX_LINE, with_ctes
from .registry import register

RAW = with_ctes(CTE_RAW_DIRTY)
TX_LINE_COLUMNS = ["id", "org_id", "transaction_id", "customer_ref", "province", "age_group",
                   "account_type", "merchant", "category", "amount", "currency", "status",
                   "txn_date", "txn_month", "txn_year", "loaded_at"]

D_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
D_AMOUNT_OK = "(amount_num > 0 AND NOT isnan(amount_num) AND NOT isinf(amount_num))"
D_STATUS_OK = "(status IN ('completed', 'pending', 'failed'))"


def _first_by(table: str, key: str, order: list[str]) -> str:
    """DuckDB: first row per key by ``order`` (nulls first, like Spark's struct order)."""
    order_sql = ", ".join(f"{c} NULLS FIRST" for c in order)
    return (f"SELECT * EXCLUDE (rn, copies) FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY {order_sql}) AS rn, count(*) OVER (PARTITION BY {key}) AS copies FROM {table}) "
            f"WHERE rn = 1")


_RAW_REST = [c for c in CSV_COLUMNS if c != "transaction_id"]
CTE_DEDUP = ("dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "
             "transaction_id ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in ["seq"] + _RAW_REST) +
             ") AS rn, count(*) OVER (PARTITION BY transaction_id) AS copies FROM raw_dirty) WHERE rn = 1)")
# The number and date grammars, stated apart from the operators.
D_NUMBER = ("CASE WHEN regexp_full_match(trim(amount), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            "THEN cast(trim(amount) AS DOUBLE) END")
CTE_TYPED = (f"typed AS (SELECT *, {D_NUMBER} AS amount_num, "
             "CASE WHEN regexp_full_match(trim(txn_date), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(trim(txn_date) AS DATE) END "
             "AS date_val, try_cast(trim(txn_year) AS INTEGER) AS year_val FROM dedup)")


def _strip_or_keep(c: str) -> str:
    return D_STRIP.format(c=c) + f" AS {c}" if c in TRIM_COLUMNS else c


CLEAN_SELECT = (
    "SELECT seq, transaction_id, " + ", ".join(_strip_or_keep(c) for c in [
        "customer_id", "province", "age_group", "account_type", "merchant", "category"]) +
    ", cast(amount_num AS DECIMAL(12,2)) AS amount, " + _strip_or_keep("currency") + ", " +
    _strip_or_keep("status") + ", date_val AS txn_date, txn_month, year_val AS txn_year "
    f"FROM typed WHERE {D_AMOUNT_OK} AND {D_STATUS_OK}")

CTE_CLEAN = "clean AS (" + CLEAN_SELECT + ")"
CLEAN_ALL = with_ctes(CTE_RAW_DIRTY, CTE_DEDUP, CTE_TYPED)


def _raw(spark, sf_dir):
    return FX.raw_dirty(spark, sf_dir)


@register("null_audit", RAW + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count "
    f"FROM raw_dirty" for i, c in enumerate(CSV_COLUMNS)))
def q_null_audit(spark, sf_dir):
    """CLN-1: null count per CSV column."""
    return C.null_audit(_raw(spark, sf_dir), CSV_COLUMNS)


@register("dedupe_first", with_ctes(CTE_TX_LINE) + _first_by("tx_line", "transaction_id", [
    c for c in TX_LINE_COLUMNS if c != "transaction_id"]))
def q_dedupe_first(spark, sf_dir):
    """CLN-2 on line-level transactions (ids repeat); order by every column."""
    lines = FX.tx_line(spark, sf_dir)
    return C.dedupe_first(lines, "transaction_id", [c for c in TX_LINE_COLUMNS if c != "transaction_id"])


@register("cast_amount", RAW + """
SELECT seq, amount AS amount_text, """ + D_NUMBER + """ AS amount_num FROM raw_dirty""")
def q_cast_amount(spark, sf_dir):
    """CLN-3: lenient amount parse."""
    return _raw(spark, sf_dir).select(
        "seq", F.col("amount").alias("amount_text"), C.cast_amount("amount").alias("amount_num"))


@register("filter_positive", RAW + f"""
SELECT seq, transaction_id, amount FROM (
  SELECT seq, transaction_id, CASE WHEN NOT isinf(amount_num) THEN cast(amount_num AS DECIMAL(12,2)) END AS amount
  FROM (SELECT *, {D_NUMBER} AS amount_num FROM raw_dirty))
WHERE amount > 0""")
def q_filter_positive(spark, sf_dir):
    """PRJ-2: positive amounts only, over parsed and rounded amounts (some null, negative or 0.00)."""
    parsed = _raw(spark, sf_dir).select("seq", "transaction_id", C.cast_amount("amount").cast("decimal(12,2)").alias("amount"))
    return S.filter_positive(parsed)


@register("filter_status", RAW + f"SELECT seq, transaction_id, status FROM raw_dirty WHERE {D_STATUS_OK}")
def q_filter_status(spark, sf_dir):
    """PRJ-3: status whitelist (exact, case-sensitive)."""
    return S.filter_status(_raw(spark, sf_dir)).select("seq", "transaction_id", "status")


@register("trim_strings", RAW + "SELECT seq, " + ", ".join(
    D_STRIP.format(c=c) + f" AS {c}" for c in TRIM_COLUMNS) + " FROM raw_dirty")
def q_trim_strings(spark, sf_dir):
    """CLN-5 / FN-5: strip the seven text columns."""
    return C.trim_columns(_raw(spark, sf_dir).select("seq", *TRIM_COLUMNS))


@register("clean_transactions", CLEAN_ALL + CLEAN_SELECT)
def q_clean_transactions(spark, sf_dir):
    """CLN-6: the whole cleaning sequence."""
    return C.clean_transactions(_raw(spark, sf_dir))


# The report's input has unparsable and missing dates as well.
BAD_DATE_SQL = "CASE WHEN seq % 211 = 0 THEN '2025-99-99' WHEN seq % 223 = 0 THEN NULL ELSE txn_date END"


@register("cleaning_report", with_ctes(CTE_RAW_DIRTY.replace("raw_dirty AS", "raw_good AS"),
                                       f"raw_dirty AS (SELECT * REPLACE ({BAD_DATE_SQL} AS txn_date) FROM raw_good)",
                                       CTE_DEDUP, CTE_TYPED) + f"""
SELECT cast(sum(copies) AS BIGINT) AS rows_in,
       cast(sum(copies - 1) AS BIGINT) AS duplicates_removed,
       count(*) FILTER (WHERE NOT coalesce({D_AMOUNT_OK}, false)) AS invalid_amounts_removed,
       count(*) FILTER (WHERE coalesce({D_AMOUNT_OK}, false) AND NOT coalesce({D_STATUS_OK}, false))
         AS unknown_statuses_removed,
       count(*) FILTER (WHERE coalesce({D_AMOUNT_OK}, false) AND coalesce({D_STATUS_OK}, false)) AS rows_out,
       count(*) FILTER (WHERE year_val IS NULL OR (date_val IS NULL AND (txn_date IS NOT NULL OR
         (coalesce({D_AMOUNT_OK}, false) AND coalesce({D_STATUS_OK}, false))))) AS strict_cast_failures
FROM typed""")
def q_cleaning_report(spark, sf_dir):
    """CLN-7: the cleaning counts in one pass."""
    return C.cleaning_report(_raw(spark, sf_dir).withColumn("txn_date", F.expr(BAD_DATE_SQL)))


@register("completed_revenue", with_ctes(CTE_RAW_DIRTY, CTE_DEDUP, CTE_TYPED, CTE_CLEAN) + """
SELECT cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) AS DECIMAL(38,2))
       AS completed_revenue FROM clean""")
def q_completed_revenue(spark, sf_dir):
    """AGG-7: completed revenue over the cleaned rows."""
    return M.completed_revenue(C.clean_transactions(_raw(spark, sf_dir)))
