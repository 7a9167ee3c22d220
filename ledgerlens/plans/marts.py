"""Mart, report, summary and staging queries (PRJ-*, AGG-*, WIN-1, FN-4/7/8)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ..functions.money import format_cad, format_thousands
from ..operators import marts as M
from ..operators import staging as S
from ..sources import fixtures as FX
from .oracle import CTE_FCT, CTE_STG, CTE_TX, d_avg, d_pct, d_sum, with_ctes
from .registry import register

TENANT = "1"                       # tenant used by the single-org queries
INCREMENTAL_SINCE = "2000-01-01 00:00:00"
FAILURE_THRESHOLD = Decimal("33.50")

STG = with_ctes(CTE_TX, CTE_STG)
FCT = with_ctes(CTE_TX, CTE_STG, CTE_FCT)

MONTHLY_SQL = f"""SELECT txn_month, txn_year,
       count(*) AS total_transactions,
       {d_sum()} AS total_revenue,
       {d_avg()} AS avg_transaction,
       count(DISTINCT customer_ref) AS unique_customers,
       count(DISTINCT category) AS categories_active
FROM fct GROUP BY txn_month, txn_year ORDER BY txn_month NULLS LAST"""


def _tx(spark, sf_dir):
    return FX.tx(spark, sf_dir)


def _stg(spark, sf_dir):
    return S.stg_transactions(FX.tx(spark, sf_dir))


@register("scan_transactions", with_ctes(CTE_TX) + "SELECT * FROM tx")
def q_scan_transactions(spark, sf_dir):
    """SRC-2: the tenant transactions table."""
    return _tx(spark, sf_dir)


@register("stg_transactions", STG + "SELECT * FROM stg")
def q_stg_transactions(spark, sf_dir):
    """PRJ-1: staging projection."""
    return _stg(spark, sf_dir)


@register("fct_revenue", FCT + "SELECT * FROM fct")
def q_fct_revenue(spark, sf_dir):
    """PRJ-4: completed-only fact."""
    return S.fct_revenue(_stg(spark, sf_dir))


@register("tenant_filter", with_ctes(CTE_TX) + f"SELECT * FROM tx WHERE org_id = '{TENANT}'")
def q_tenant_filter(spark, sf_dir):
    """PRJ-5: one tenant's rows."""
    return S.for_tenant(_tx(spark, sf_dir), TENANT)


@register("calendar_columns", with_ctes(CTE_TX) + """
SELECT transaction_id, txn_date, strftime(txn_date, '%Y-%m') AS txn_month,
       cast(year(txn_date) AS INTEGER) AS txn_year
FROM tx""")
def q_calendar_columns(spark, sf_dir):
    """PRJ-6 / FN-4: month and year re-derived from the date."""
    return S.with_calendar(_tx(spark, sf_dir).select("transaction_id", "txn_date"))


@register("fct_revenue_by_category", FCT + f"""
SELECT category,
       count(*) AS total_transactions,
       {d_sum()} AS total_revenue,
       {d_avg()} AS avg_transaction,
       cast(min(amount) AS DECIMAL(38,2)) AS min_transaction,
       cast(max(amount) AS DECIMAL(38,2)) AS max_transaction
FROM fct GROUP BY category ORDER BY total_revenue DESC NULLS FIRST, category""")
def q_fct_revenue_by_category(spark, sf_dir):
    """AGG-2: category mart."""
    return M.fct_revenue_by_category(_stg(spark, sf_dir))


@register("fct_monthly_revenue", FCT + MONTHLY_SQL)
def q_fct_monthly_revenue(spark, sf_dir):
    """AGG-1: monthly mart."""
    return M.fct_monthly_revenue(_stg(spark, sf_dir))


@register("fct_revenue_by_province", FCT + f"""
SELECT province,
       count(*) AS total_transactions,
       {d_sum()} AS total_revenue,
       {d_avg()} AS avg_transaction,
       count(DISTINCT customer_ref) AS unique_customers
FROM fct GROUP BY province ORDER BY total_revenue DESC NULLS FIRST, province""")
def q_fct_revenue_by_province(spark, sf_dir):
    """AGG-3: province mart."""
    return M.fct_revenue_by_province(_stg(spark, sf_dir))


@register("fct_status_summary", STG + f"""
SELECT status, total_transactions, total_amount,
       {d_pct('total_transactions', 'sum(total_transactions) OVER ()')} AS pct_of_total
FROM (SELECT status, count(*) AS total_transactions, {d_sum()} AS total_amount
      FROM stg GROUP BY status)
ORDER BY total_transactions DESC""")
def q_fct_status_summary(spark, sf_dir):
    """AGG-4 + WIN-1: status mart with share of total."""
    return M.fct_status_summary(_stg(spark, sf_dir))


@register("pct_of_total", with_ctes(CTE_TX) + f"""
SELECT category, n, {d_pct('n', 'sum(n) OVER ()')} AS pct_of_total
FROM (SELECT category, count(*) AS n FROM tx GROUP BY category)""")
def q_pct_of_total(spark, sf_dir):
    """WIN-1 on its own: share of each category in all transactions."""
    return M.pct_of_total(M.category_counts(_tx(spark, sf_dir)), "n")


@register("category_counts", with_ctes(CTE_TX) + """
SELECT category, count(*) AS n FROM tx GROUP BY category ORDER BY n DESC""")
def q_category_counts(spark, sf_dir):
    """AGG-8: rows per category, all statuses."""
    return M.category_counts(_tx(spark, sf_dir))


@register("kpi_cards", STG + f"""
SELECT cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) AS DECIMAL(38,2))
         AS total_revenue,
       count(*) FILTER (WHERE status = 'completed') AS completed_transactions,
       CASE WHEN count(*) > 0 THEN {d_pct("count(*) FILTER (WHERE status = 'completed')", 'count(*)')} END
         AS completion_rate,
       count(DISTINCT CASE WHEN status = 'completed' THEN province END)
         + CASE WHEN count(*) FILTER (WHERE status = 'completed' AND province IS NULL) > 0
                THEN 1 ELSE 0 END AS active_provinces
FROM stg""")
def q_kpi_cards(spark, sf_dir):
    """AGG-9: KPI cards."""
    return M.kpis(_stg(spark, sf_dir))


@register("rpt_monthly_summary", FCT + f"""
SELECT txn_month, {d_sum()} AS revenue, count(*) AS volume
FROM fct GROUP BY txn_month ORDER BY txn_month""")
def q_rpt_monthly_summary(spark, sf_dir):
    """AGG-10: monthly report."""
    return M.rpt_monthly_summary(S.fct_revenue(_stg(spark, sf_dir)))


@register("rpt_category_breakdown", FCT + f"""
SELECT category, {d_sum()} AS revenue, count(*) AS volume, cast(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM fct GROUP BY category ORDER BY revenue DESC""")
def q_rpt_category_breakdown(spark, sf_dir):
    """AGG-11: category report."""
    return M.rpt_category_breakdown(S.fct_revenue(_stg(spark, sf_dir)))


@register("rpt_province_analysis", FCT + f"""
SELECT province, {d_sum()} AS revenue, count(*) AS volume
FROM fct GROUP BY province ORDER BY revenue DESC""")
def q_rpt_province_analysis(spark, sf_dir):
    """AGG-12: province report."""
    return M.rpt_province_analysis(S.fct_revenue(_stg(spark, sf_dir)))


@register("daily_volume", STG + f"""
SELECT txn_date, count(*) AS total_transactions, {d_sum()} AS total_amount
FROM stg GROUP BY txn_date ORDER BY txn_date""")
def q_daily_volume(spark, sf_dir):
    """AGG-13: per-day volume."""
    return M.daily_volume(_stg(spark, sf_dir))


@register("segment_activity", STG + """
SELECT age_group, account_type, count(*) AS total_transactions,
       cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) AS DECIMAL(38,2))
         AS completed_revenue,
       count(DISTINCT customer_ref) AS unique_customers
FROM stg GROUP BY age_group, account_type""")
def q_segment_activity(spark, sf_dir):
    """AGG-14: activity per customer segment."""
    return M.segment_activity(_stg(spark, sf_dir))


@register("failure_rate", STG + f"""
SELECT txn_month, total_transactions, failed_transactions,
       {d_pct('failed_transactions', 'total_transactions')} AS failure_rate_pct,
       {d_pct('failed_transactions', 'total_transactions')} > {FAILURE_THRESHOLD} AS breached
FROM (SELECT txn_month, count(*) AS total_transactions,
             count(*) FILTER (WHERE status = 'failed') AS failed_transactions
      FROM stg GROUP BY txn_month)""")
def q_failure_rate(spark, sf_dir):
    """AGG-15: monthly failure share against a threshold."""
    return M.failure_rate(_stg(spark, sf_dir), FAILURE_THRESHOLD)


@register("incremental_monthly", FCT + MONTHLY_SQL)
def q_incremental_monthly(spark, sf_dir):
    """AGG-17: the mart built from rows loaded up to a cut-off, then refreshed
    incrementally with the later rows; must equal the full rebuild."""
    stg = _stg(spark, sf_dir)
    since = F.lit(INCREMENTAL_SINCE).cast("timestamp_ntz")
    old_mart = M.fct_monthly_revenue(stg.where(F.col("_loaded_at") <= since))
    return M.refresh_months(stg, old_mart, INCREMENTAL_SINCE)


@register("format_cad", FCT + """
SELECT category, total_revenue,
       'CAD $' || format('{:,.2f}', total_revenue) AS revenue_text
FROM (SELECT category, cast(sum(amount) AS DECIMAL(38,2)) AS total_revenue FROM fct GROUP BY category)""")
def q_format_cad(spark, sf_dir):
    """FN-7: currency text of the category revenue."""
    mart = M.fct_revenue_by_category(_stg(spark, sf_dir))
    return mart.select("category", "total_revenue", format_cad("total_revenue").alias("revenue_text"))


@register("format_k", FCT + """
SELECT province, total_revenue,
       '$' || cast(cast(round(total_revenue / 1000, 0) AS BIGINT) AS VARCHAR) || 'k' AS revenue_k
FROM (SELECT province, cast(sum(amount) AS DECIMAL(38,2)) AS total_revenue FROM fct GROUP BY province)""")
def q_format_k(spark, sf_dir):
    """FN-8: thousands label of the province revenue axis."""
    mart = M.fct_revenue_by_province(_stg(spark, sf_dir))
    return mart.select("province", "total_revenue", format_thousands("total_revenue").alias("revenue_k"))
