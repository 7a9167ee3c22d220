"""Marts, reports and summaries (AGG-1..4, 7..15, 17; WIN-1).

Every mart is one ``groupBy().agg()`` over the staging frame.  Group keys are
low-cardinality (month, category, province, status), so the partial
aggregation before the shuffle collapses each input partition to a handful of
rows: a hot key is pre-aggregated map-side and never lands whole in one task.
Distinct counts are exact; Spark expands them into (key, value) pairs that are
also de-duplicated map-side before the shuffle.

Money follows SQL numeric rules: sums are exact decimals and averages are
rounded once, half away from zero, from the exact quotient
(:mod:`ledgerlens.functions.money`).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import exact_avg, full_avg, money, money_sum, share_pct_sql, scaled_quotient_sql
from .staging import fct_revenue, for_tenant

def _scoped(stg: DataFrame, org_id: str | None) -> DataFrame:
    """Marts ignore tenants unless asked; ``org_id`` scopes them to one."""
    return stg if org_id is None else for_tenant(stg, org_id)


def fct_monthly_revenue(stg: DataFrame, org_id: str | None = None) -> DataFrame:
    """AGG-1: completed revenue per (month, year), month ascending."""
    return (fct_revenue(_scoped(stg, org_id))
            .groupBy("txn_month", "txn_year")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 money_sum().alias("total_revenue"),
                 exact_avg().alias("avg_transaction"),
                 F.countDistinct("customer_ref").alias("unique_customers"),
                 F.countDistinct("category").alias("categories_active"))
            .orderBy(F.col("txn_month").asc_nulls_last(), F.col("txn_year").asc_nulls_last()))


def fct_revenue_by_category(stg: DataFrame, org_id: str | None = None) -> DataFrame:
    """AGG-2: completed revenue per category, revenue descending."""
    return (fct_revenue(_scoped(stg, org_id))
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 money_sum().alias("total_revenue"),
                 exact_avg().alias("avg_transaction"),
                 money("min(amount)").alias("min_transaction"),
                 money("max(amount)").alias("max_transaction"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_last()))


def fct_revenue_by_province(stg: DataFrame, org_id: str | None = None) -> DataFrame:
    """AGG-3: completed revenue per province, revenue descending."""
    return (fct_revenue(_scoped(stg, org_id))
            .groupBy("province")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 money_sum().alias("total_revenue"),
                 exact_avg().alias("avg_transaction"),
                 F.countDistinct("customer_ref").alias("unique_customers"))
            .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("province").asc_nulls_last()))


def pct_of_total(df: DataFrame, n_col: str, out: str = "pct_of_total") -> DataFrame:
    """WIN-1: ``round(100.0 * n / sum(n) over (), 2)`` on already grouped rows.

    The whole-result window gathers the grouped rows into one partition; it is
    applied only after aggregation, where the row count is the number of
    groups, not the number of transactions."""
    total = F.sum(n_col).over(Window.partitionBy())
    return (df.withColumn("_total_n", total)
              .withColumn(out, F.expr(share_pct_sql(n_col, "_total_n")))
              .drop("_total_n"))


def fct_status_summary(stg: DataFrame, org_id: str | None = None) -> DataFrame:
    """AGG-4: every staged status with its count, amount and share."""
    grouped = (_scoped(stg, org_id).groupBy("status")
               .agg(F.count(F.lit(1)).alias("total_transactions"),
                    money_sum().alias("total_amount")))
    return (pct_of_total(grouped, "total_transactions")
            .orderBy(F.col("total_transactions").desc_nulls_first(), F.col("status").asc_nulls_last()))


def completed_revenue(df: DataFrame) -> DataFrame:
    """AGG-7: one number, completed revenue over the given (cleaned) rows."""
    return df.agg(F.expr("cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) "
                         "as decimal(38,2))").alias("completed_revenue"))


def category_counts(df: DataFrame) -> DataFrame:
    """AGG-8: rows per category over all statuses, most frequent first."""
    return (df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("category").asc_nulls_last()))


def kpis(stg: DataFrame) -> DataFrame:
    """AGG-9: dashboard KPI cards in one pass over staging.

    ``total_revenue`` and ``completed_transactions`` are the category-mart
    totals (completed rows only), ``completion_rate`` is the completed share of
    the status mart, and ``active_provinces`` is the province mart's row count
    (a null province is a group of its own there)."""
    completed = "status = 'completed'"
    return stg.agg(
        F.expr(f"cast(coalesce(sum(CASE WHEN {completed} THEN amount END), 0) as decimal(38,2))")
        .alias("total_revenue"),
        F.expr(f"count_if({completed})").alias("completed_transactions"),
        F.expr(f"CASE WHEN count(1) > 0 THEN {share_pct_sql(f'count_if({completed})', 'count(1)')} END")
        .alias("completion_rate"),
        F.expr(f"count(DISTINCT CASE WHEN {completed} THEN province END) "
               f"+ CASE WHEN count_if({completed} AND province IS NULL) > 0 THEN 1 ELSE 0 END")
        .alias("active_provinces"),
    )


def rpt_monthly_summary(fct: DataFrame) -> DataFrame:
    """AGG-10: revenue and volume per month over the completed fact."""
    return (fct.groupBy("txn_month")
            .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume"))
            .orderBy(F.col("txn_month").asc_nulls_last()))


def rpt_category_breakdown(fct: DataFrame) -> DataFrame:
    """AGG-11: revenue, volume and average per category (the average is not rounded)."""
    return (fct.groupBy("category")
            .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume"),
                 full_avg().alias("avg_amount"))
            .orderBy(F.col("revenue").desc_nulls_first(), F.col("category").asc_nulls_last()))


def rpt_province_analysis(fct: DataFrame) -> DataFrame:
    """AGG-12: revenue and volume per province."""
    return (fct.groupBy("province")
            .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume"))
            .orderBy(F.col("revenue").desc_nulls_first(), F.col("province").asc_nulls_last()))


def daily_volume(stg: DataFrame) -> DataFrame:
    """AGG-13: transactions and amount per day (all staged statuses)."""
    return (stg.groupBy("txn_date")
            .agg(F.count(F.lit(1)).alias("total_transactions"), money_sum().alias("total_amount"))
            .orderBy("txn_date"))


def segment_activity(stg: DataFrame) -> DataFrame:
    """AGG-14: activity per (age group, account type): all staged rows, completed
    revenue and distinct customers."""
    return (stg.groupBy("age_group", "account_type")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.expr("cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) "
                        "as decimal(38,2))").alias("completed_revenue"),
                 F.countDistinct("customer_ref").alias("unique_customers"))
            .orderBy(F.col("age_group").asc_nulls_last(), F.col("account_type").asc_nulls_last()))


def failure_rate(stg: DataFrame, threshold_pct: Decimal | float | str = Decimal("5.00")) -> DataFrame:
    """AGG-15: failed share per month and whether it breaches ``threshold_pct``."""
    thr = Decimal(str(threshold_pct))
    return (stg.groupBy("txn_month")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 F.expr("count_if(status = 'failed')").alias("failed_transactions"))
            .withColumn("failure_rate_pct", F.expr(share_pct_sql("failed_transactions", "total_transactions")))
            .withColumn("breached", F.col("failure_rate_pct") > F.lit(thr))
            .orderBy(F.col("txn_month").asc_nulls_last()))


def touched_rows(rows: DataFrame, months: DataFrame, how: str = "left_semi", by_partition: bool = False) -> DataFrame:
    """Rows whose ``txn_month`` is among ``months`` (``left_anti``: is not); a
    null month is a month of its own.

    ``by_partition`` is for a table partitioned by month: the months compare by
    plain equality, so that a selective filter on ``months`` prunes the scan's
    partitions at run time, and the null month is a branch of its own, whose
    scan reads the null partition alone.  There are at most as many months as
    partition folders, so they are broadcast."""
    month = months.withColumnRenamed("txn_month", "_m")
    if not by_partition:
        return rows.join(month, F.col("txn_month").eqNullSafe(F.col("_m")), how)
    month = F.broadcast(month)
    dated = rows.where(F.col("txn_month").isNotNull()).join(
        month.where(F.col("_m").isNotNull()), F.col("txn_month") == F.col("_m"), how)
    undated = rows.where(F.col("txn_month").isNull()).join(
        month.where(F.col("_m").isNull()), F.col("txn_month").eqNullSafe(F.col("_m")), how)
    return dated.unionByName(undated)


def refresh_months(stg: DataFrame, mart: DataFrame, since, org_id: str | None = None) -> DataFrame:
    """AGG-17: incremental refresh of the monthly mart.

    Only months touched by rows loaded after ``since`` are recomputed; the
    other rows are kept from ``mart``.  The result equals a full rebuild.  See
    :func:`fresh_months` for the part that a stored, partitioned mart needs."""
    months = touched_months(_scoped(stg, org_id), since)
    fresh = fresh_months(stg, since, org_id)
    kept = touched_rows(mart, months, "left_anti")
    return (kept.unionByName(fresh)
            .orderBy(F.col("txn_month").asc_nulls_last(), F.col("txn_year").asc_nulls_last()))


def touched_months(stg: DataFrame, since) -> DataFrame:
    """The months of completed rows loaded after ``since``, one row each."""
    return (fct_revenue(stg).where(F.col("_loaded_at") > F.lit(since).cast("timestamp_ntz"))
            .select("txn_month").distinct())


def fresh_months(stg: DataFrame, since, org_id: str | None = None, by_partition: bool = False) -> DataFrame:
    """The monthly mart's rows for the months touched after ``since``.

    ``by_partition`` is for a table partitioned by ``txn_month``: the recompute
    then reads the touched partitions only (:func:`touched_rows`)."""
    scoped = _scoped(stg, org_id)
    return fct_monthly_revenue(touched_rows(scoped, touched_months(scoped, since), by_partition=by_partition))


# Grouping sets of the four dashboard marts, keyed by mart name.
MART_KEYS = ["category", "province", "txn_month", "txn_year", "status"]
MART_SETS = {
    "fct_revenue_by_category": ["category"],
    "fct_revenue_by_province": ["province"],
    "fct_monthly_revenue": ["txn_month", "txn_year"],
    "fct_status_summary": ["status"],
}


def _gid(keys: list[str]) -> int:
    """``grouping_id()`` of a grouping set over MART_KEYS (bit set = key rolled up)."""
    n = len(MART_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(MART_KEYS) if k not in keys)


# Helper grouping sets for the exact distinct counts: (output column, mart,
# counted column).  The helper set is the mart's keys plus the counted column.
DISTINCT_SETS = [
    ("cust_c", "fct_revenue_by_province", "customer_ref"),
    ("cust_c", "fct_monthly_revenue", "customer_ref"),
    ("cat_c", "fct_monthly_revenue", "category"),
]
_PASS_KEYS = MART_KEYS + ["customer_ref"]


def _gid_pass(keys: list[str]) -> int:
    """``grouping_id()`` of a grouping set over MART_KEYS + customer_ref."""
    n = len(_PASS_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(_PASS_KEYS) if k not in keys)


def marts_one_pass(stg: DataFrame, distinct_counts: bool = True) -> DataFrame:
    """The four marts' aggregates in ONE scan of staging (grouping sets).

    Each input row is expanded once per grouping set and combined map-side,
    so the first shuffle carries aggregated rows only.  Completed-only
    measures are conditional aggregates; the status mart uses the
    unconditional ones.

    Distinct counts need no ``count(DISTINCT)`` (which Spark would expand
    again for every set and both counted columns).  Instead a helper set per
    distinct count groups by the mart's keys plus the counted column, and a
    second, map-side-combined aggregation counts the helper groups that hold
    a completed row with a non-null value.  Only the province and monthly
    marts ship (key, customer) pairs.  A hot month's pairs are counted per
    partition before the second shuffle.  The result has one row per group of
    every mart (``_gid`` as :func:`_gid`), which :func:`split_marts` and
    :func:`stack_marts` turn into the marts.

    ``distinct_counts=False`` leaves out the helper sets (``cust_c`` and
    ``cat_c`` are then 0), for consumers such as the quality report that do
    not read them: grouping sets, unlike unused aggregates, are not pruned."""
    comp = "status = 'completed'"
    main = {_gid_pass(keys): _gid(keys) for keys in MART_SETS.values()}
    helpers = {_gid_pass(MART_SETS[mart] + [col]): (out, _gid(MART_SETS[mart]), col)
               for out, mart, col in (DISTINCT_SETS if distinct_counts else [])}
    helper_sets = [MART_SETS[mart] + [col] for _, mart, col in DISTINCT_SETS] if distinct_counts else []
    sets = [MART_SETS[m] for m in MART_SETS] + helper_sets
    first = (stg.groupingSets(sets, *_PASS_KEYS)
             .agg(F.grouping_id().alias("_g"),
                  F.count(F.lit(1)).alias("n_all"),
                  F.expr("sum(amount)").alias("amt_all"),
                  F.expr(f"count_if({comp})").alias("n_c"),
                  F.expr(f"sum(CASE WHEN {comp} THEN amount END)").alias("amt_c"),
                  F.expr(f"min(CASE WHEN {comp} THEN amount END)").alias("min_c"),
                  F.expr(f"max(CASE WHEN {comp} THEN amount END)").alias("max_c")))

    def by_g(mapping: dict, pick) -> Column:
        out = None
        for g, v in mapping.items():
            out = (F.when(F.col("_g") == g, pick(v)) if out is None
                   else out.when(F.col("_g") == g, pick(v)))
        return out

    measures = ["n_all", "amt_all", "n_c", "amt_c", "min_c", "max_c"]
    target = by_g({**main, **{g: v[1] for g, v in helpers.items()}}, F.lit).alias("_gid")
    if not helpers:
        return first.select(*MART_KEYS, target, *measures,
                            F.lit(0).cast("bigint").alias("cust_c"), F.lit(0).cast("bigint").alias("cat_c"))
    is_main = F.col("_g").isin(*main)
    # A helper group counts when it holds a completed row and a non-null value.
    hit_flags = []
    for out in sorted({o for o, _, _ in DISTINCT_SETS}):
        cond = F.lit(False)
        for g, (o, _, col) in helpers.items():
            if o == out:
                cond = cond | ((F.col("_g") == g) & F.col(col).isNotNull())
        hit_flags.append((cond & (F.col("n_c") > 0)).alias(f"_{out}_hit"))
    # A helper row joins its mart's group: the counted column leaves the key
    # (customer_ref is not a mart key; category is nulled on category helpers).
    cat_helpers = [g for g, (_, _, col) in helpers.items() if col == "category"]
    tagged = first.select(
        target,
        F.when(F.col("_g").isin(*cat_helpers), F.lit(None)).otherwise(F.col("category")).alias("category"),
        *[c for c in MART_KEYS if c != "category"], is_main.alias("_main"), *hit_flags, *measures)
    return (tagged.groupBy("_gid", *MART_KEYS)
            .agg(*[F.max(F.when(F.col("_main"), F.col(m))).alias(m) for m in measures],
                 F.count_if("_cust_c_hit").alias("cust_c"), F.count_if("_cat_c_hit").alias("cat_c"))
            .select(*MART_KEYS, "_gid", *measures, "cust_c", "cat_c"))


def split_marts(combined: DataFrame) -> dict[str, DataFrame]:
    """Mart frames from :func:`marts_one_pass` output (equal to the per-mart functions)."""
    avg = F.expr(scaled_quotient_sql("amt_c", "n_c", 2)).alias("avg_transaction")
    revenue = F.col("amt_c").cast("decimal(38,2)").alias("total_revenue")
    done = F.col("n_c") > 0

    def part(name):
        return combined.where(F.col("_gid") == _gid(MART_SETS[name]))

    monthly = (part("fct_monthly_revenue").where(done)
               .select("txn_month", "txn_year", F.col("n_c").alias("total_transactions"), revenue, avg,
                       F.col("cust_c").alias("unique_customers"), F.col("cat_c").alias("categories_active"))
               .orderBy(F.col("txn_month").asc_nulls_last(), F.col("txn_year").asc_nulls_last()))
    category = (part("fct_revenue_by_category").where(done)
                .select("category", F.col("n_c").alias("total_transactions"), revenue, avg,
                        F.col("min_c").cast("decimal(38,2)").alias("min_transaction"),
                        F.col("max_c").cast("decimal(38,2)").alias("max_transaction"))
                .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_last()))
    province = (part("fct_revenue_by_province").where(done)
                .select("province", F.col("n_c").alias("total_transactions"), revenue, avg,
                        F.col("cust_c").alias("unique_customers"))
                .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("province").asc_nulls_last()))
    status = pct_of_total(part("fct_status_summary").select(
        "status", F.col("n_all").alias("total_transactions"),
        F.col("amt_all").cast("decimal(38,2)").alias("total_amount")), "total_transactions")
    status = status.orderBy(F.col("total_transactions").desc_nulls_first(), F.col("status").asc_nulls_last())
    return {"fct_monthly_revenue": monthly, "fct_revenue_by_category": category,
            "fct_revenue_by_province": province, "fct_status_summary": status}


def stack_marts(combined: DataFrame) -> DataFrame:
    """The four marts of :func:`marts_one_pass` as ONE frame tagged by ``model``
    (mart name); columns a mart lacks are null.  Rows and values equal
    :func:`split_marts`, but every mart is read from the same single plan
    branch, so consumers that test all marts run the pass once."""
    gid_to_model = F.create_map(*[x for name, keys in MART_SETS.items()
                                  for x in (F.lit(_gid(keys)), F.lit(name))])
    model = gid_to_model[F.col("_gid")]
    status_mart = model == F.lit("fct_status_summary")
    return (combined
            .where(status_mart | (F.col("n_c") > 0))
            .select(model.alias("model"), *MART_KEYS,
                    F.when(status_mart, F.col("n_all")).otherwise(F.col("n_c")).alias("total_transactions"),
                    F.when(~status_mart, F.col("amt_c").cast("decimal(38,2)")).alias("total_revenue"),
                    F.when(status_mart, F.col("amt_all").cast("decimal(38,2)")).alias("total_amount")))
