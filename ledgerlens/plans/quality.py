"""Data-quality queries (QLT-1..7)."""

from __future__ import annotations

from ..operators import marts as M
from ..operators import quality as Q
from ..operators import staging as S
from ..schemas import EXPECTED_ROW_COUNT, REVENUE_FLOOR, VALID_STATUSES
from ..sources import fixtures as FX
from .oracle import (CTE_FCT, CTE_MEMBERSHIPS, CTE_ORGS, CTE_RAW_DIRTY, CTE_STG, CTE_TOKENS, CTE_TX, CTE_TX_LINE, CTE_USERS,
                     with_ctes)
from .registry import register

SOURCE_NOT_NULL = ["id", "transaction_id", "customer_ref", "amount"]
STATUS_LIST = ", ".join(f"'{s}'" for s in VALID_STATUSES)

# Tables the report's models read in the oracle.
MODEL_TABLES = {
    "fct_revenue_by_category": "mart_category",
    "fct_revenue_by_province": "mart_province",
    "fct_monthly_revenue": "mart_monthly",
    "fct_status_summary": "mart_status",
    "transactions": "tx",
}
CTE_MARTS = """mart_category AS (SELECT category, cast(sum(amount) AS DECIMAL(38,2)) AS total_revenue
                  FROM fct GROUP BY category),
mart_province AS (SELECT province FROM fct GROUP BY province),
mart_monthly AS (SELECT txn_month, txn_year FROM fct GROUP BY txn_month, txn_year),
mart_status AS (SELECT status FROM stg GROUP BY status)"""


def _d_test(t: Q.ColumnTest) -> str:
    table = MODEL_TABLES[t.model]
    head = f"SELECT '{t.model}' AS model, '{t.column}' AS column_name, '{t.test}' AS test, "
    tail = f", '{t.severity}' AS severity"
    c = t.column
    if t.test == "not_null":
        return head + f"count(*) FILTER (WHERE {c} IS NULL) AS failures" + tail + f" FROM {table}"
    if t.test == "unique":
        return (head + f"(SELECT count(*) FROM (SELECT {c} FROM {table} WHERE {c} IS NOT NULL "
                f"GROUP BY {c} HAVING count(*) > 1)) AS failures" + tail)
    values = ", ".join(f"'{v}'" for v in t.values)
    return (head + f"count(DISTINCT CASE WHEN {c} NOT IN ({values}) THEN {c} END) AS failures" + tail +
            f" FROM {table}")


REPORT_SQL = with_ctes(CTE_TX, CTE_STG, CTE_FCT, CTE_MARTS) + "SELECT *, failures = 0 AS passed FROM (\n" + \
    "\nUNION ALL\n".join(_d_test(t) for t in Q.ALL_COLUMN_TESTS) + f"""
UNION ALL
SELECT 'transactions', cast(NULL AS VARCHAR), 'row_count',
       cast(CASE WHEN count(*) = {EXPECTED_ROW_COUNT} THEN 0 ELSE 1 END AS BIGINT), 'warn' FROM tx
UNION ALL
SELECT 'stg_transactions', cast(NULL AS VARCHAR), 'revenue_floor',
       cast(CASE WHEN coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) > {REVENUE_FLOOR}
            THEN 0 ELSE 1 END AS BIGINT), 'warn' FROM stg)"""


@register("dq_not_null", with_ctes(CTE_TX) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS failures FROM tx"
    for c in SOURCE_NOT_NULL))
def q_dq_not_null(spark, sf_dir):
    """QLT-1: null counts of the source's not-null columns, one pass."""
    return Q.not_null_counts(FX.tx(spark, sf_dir), SOURCE_NOT_NULL)


@register("dq_unique", with_ctes(CTE_TX_LINE) + """
SELECT transaction_id, count(*) AS n_occurrences FROM tx_line
WHERE transaction_id IS NOT NULL GROUP BY transaction_id HAVING count(*) > 1""")
def q_dq_unique(spark, sf_dir):
    """QLT-2: repeated transaction ids among line-level transactions."""
    return Q.unique(FX.tx_line(spark, sf_dir), "transaction_id")


@register("dq_accepted_values", with_ctes(CTE_RAW_DIRTY) + f"""
SELECT status, count(*) AS n_occurrences FROM raw_dirty
WHERE status IS NOT NULL AND status NOT IN ({STATUS_LIST}) GROUP BY status""")
def q_dq_accepted_values(spark, sf_dir):
    """QLT-3: raw status values outside the accepted list."""
    return Q.accepted_values(FX.raw_dirty(spark, sf_dir), "status", VALID_STATUSES)


@register("dq_row_count", with_ctes(CTE_TX) + f"""
SELECT count(*) AS actual_rows, cast({EXPECTED_ROW_COUNT} AS BIGINT) AS expected_rows,
       count(*) = {EXPECTED_ROW_COUNT} AS passed, 'warn' AS severity FROM tx""")
def q_dq_row_count(spark, sf_dir):
    """QLT-5: row count against the documented expectation."""
    return Q.row_count_rule(FX.tx(spark, sf_dir), EXPECTED_ROW_COUNT)


@register("dq_revenue_floor", with_ctes(CTE_TX, CTE_STG) + f"""
SELECT cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) AS DECIMAL(38,2))
         AS completed_revenue,
       cast({REVENUE_FLOOR} AS DECIMAL(38,2)) AS revenue_floor,
       coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) > {REVENUE_FLOOR} AS passed,
       'warn' AS severity FROM stg""")
def q_dq_revenue_floor(spark, sf_dir):
    """QLT-6: completed revenue above the documented floor."""
    return Q.revenue_floor_rule(S.stg_transactions(FX.tx(spark, sf_dir)), REVENUE_FLOOR)


@register("dq_report", REPORT_SQL)
def q_dq_report(spark, sf_dir):
    """QLT-7: the 16 column tests and the two rules as one report.

    Three passes over the transactions: the tests on the four marts read them
    stacked from one grouping-sets aggregation; the source table's null,
    accepted-value, row-count and revenue-floor checks are one fused
    aggregation (the floor sums completed rows that pass the staging filter);
    and the ``unique`` test on ``id`` is one grouped count."""
    tx = FX.tx(spark, sf_dir)
    stg = S.stg_transactions(tx)
    mart_tests = [t for t in Q.ALL_COLUMN_TESTS if t.model in M.MART_SETS]
    marts = Q.run_tests_stacked(M.stack_marts(M.marts_one_pass(stg, distinct_counts=False)), mart_tests)
    staged_completed = f"{S.staged_predicate_sql()} AND status = 'completed'"
    rules = [Q.row_count_check("transactions", EXPECTED_ROW_COUNT),
             Q.revenue_floor_check("transactions", REVENUE_FLOOR, where=staged_completed,
                                   label="stg_transactions")]
    source = Q.run_tests({"transactions": tx}, [t for t in Q.ALL_COLUMN_TESTS if t not in mart_tests], rules)
    return marts.unionByName(source)


KEY_TESTS = [
    Q.ColumnTest("memberships", "org_id", "relationships", to="organizations"),
    Q.ColumnTest("memberships", "user_id", "relationships", to="users"),
    Q.ColumnTest("refresh_tokens", "org_id", "relationships", severity="warn", to="organizations"),
    Q.ColumnTest("refresh_tokens", "user_id", "relationships", to="users"),
    Q.ColumnTest("transactions", "org_id", "relationships", to="organizations"),
    Q.ColumnTest("transactions", "source_id", "relationships", to="organizations"),
    Q.ColumnTest("transactions", "customer_ref", "relationships", severity="warn", to="users", to_column="full_name"),
]


def _key_oracle() -> str:
    rows = [f"""SELECT '{t.model}' AS model, '{t.column}' AS column_name, 'relationships' AS test, count(*) AS failures,
  '{t.severity}' AS severity, count(*) = 0 AS passed
FROM {'tx' if t.model == 'transactions' else t.model} c
WHERE c.{t.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {t.to} p WHERE p.{t.to_column} = c.{t.column})""" for t in KEY_TESTS]
    return with_ctes(CTE_TX, CTE_ORGS, CTE_MEMBERSHIPS, CTE_USERS, CTE_TOKENS) + "\nUNION ALL\n".join(rows)


@register("dq_relationships", _key_oracle())
def q_dq_relationships(spark, sf_dir):
    """QLT-4 in QLT-7: the foreign keys of three tables as report rows, one pass over each."""
    models = {"organizations": FX.organizations(spark, sf_dir), "users": FX.users(spark, sf_dir),
              "memberships": FX.memberships(spark, sf_dir), "refresh_tokens": FX.refresh_tokens(spark, sf_dir),
              "transactions": FX.tx(spark, sf_dir)}
    return Q.run_tests(models, KEY_TESTS)
