"""DuckDB restatements of the registered queries (the correctness oracle).

Each query is written from scratch in DuckDB SQL over the driver's raw tables:
the fixture derivation (FIXTURES.md §2) appears as common table expressions,
followed by the operator's own SQL.  Money is exact: averages and shares use
integer arithmetic so that both engines round the exact quotient once.
"""

from __future__ import annotations

from ..sources.fixtures import FIXTURE_EPOCH, ORG_MAX_ROWS, ORG_MAX_USERS

AGE_GROUP_SQL = "['18-25', '26-35', '36-45', '46-55', '55+'][o_custkey % 5 + 1]"
ACCOUNT_TYPE_SQL = "['chequing', 'savings', 'premium'][o_custkey % 3 + 1]"
STATUS_SQL = "MAP {'F': 'completed', 'O': 'pending', 'P': 'failed'}[o_orderstatus]"
MONTH_SQL = "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END"

ORDER_ROWS = ("orders JOIN customer ON o_custkey = c_custkey "
              "JOIN nation ON c_nationkey = n_nationkey")

CTE_TX = f"""tx AS (
  SELECT cast(o_orderkey AS VARCHAR) AS id,
         cast(n_regionkey AS VARCHAR) AS org_id,
         cast(NULL AS VARCHAR) AS source_id,
         'T' || cast(o_orderkey AS VARCHAR) AS transaction_id,
         CASE WHEN o_orderkey % 59 <> 0 THEN c_name END AS customer_ref,
         n_name AS province,
         {AGE_GROUP_SQL} AS age_group,
         {ACCOUNT_TYPE_SQL} AS account_type,
         'M' || cast(o_orderkey % 50 AS VARCHAR) AS merchant,
         CASE WHEN o_orderkey % 71 <> 0 THEN o_orderpriority END AS category,
         cast(CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_totalprice END
              AS DECIMAL(15,2)) AS amount,
         'CAD' AS currency,
         CASE WHEN o_orderkey % 43 = 0 THEN 'REFUNDED' ELSE {STATUS_SQL} END AS status,
         cast(o_orderdate AS DATE) AS txn_date,
         {MONTH_SQL} AS txn_month,
         cast(year(o_orderdate) AS INTEGER) AS txn_year,
         cast(NULL AS VARCHAR) AS metadata,
         cast(o_orderdate AS TIMESTAMP) AS loaded_at
  FROM {ORDER_ROWS})"""

STG_SELECT = """SELECT id AS txn_pk, transaction_id, customer_ref, org_id, province, age_group,
         account_type, merchant, category, amount, currency, status, txn_date, txn_month,
         txn_year, loaded_at AS _loaded_at"""

CTE_STG = f"""stg AS (
  {STG_SELECT}
  FROM tx
  WHERE amount > 0 AND status IN ('completed', 'pending', 'failed'))"""

CTE_FCT = "fct AS (SELECT * FROM stg WHERE status = 'completed')"

CTE_RAW_DIRTY = f"""raw_dirty AS (
  SELECT 2 * o_orderkey + copy AS seq,
         'T' || cast(o_orderkey AS VARCHAR) AS transaction_id,
         c_name AS customer_id,
         n_name AS province,
         {AGE_GROUP_SQL} AS age_group,
         {ACCOUNT_TYPE_SQL} AS account_type,
         'M' || cast(o_orderkey % 50 AS VARCHAR) AS merchant,
         CASE WHEN o_orderkey % 71 = 0 THEN '  ' || o_orderpriority || '  '
              ELSE o_orderpriority END AS category,
         CASE WHEN copy = 1 THEN '1.00' WHEN o_orderkey % 53 = 0 THEN '-5.00'
              WHEN o_orderkey % 59 = 0 THEN 'abc' WHEN o_orderkey % 79 = 0 THEN NULL
              WHEN o_orderkey % 89 = 0 THEN '0.004' WHEN o_orderkey % 83 = 0 THEN '10d'
              WHEN o_orderkey % 101 = 0 THEN '0x1p3' WHEN o_orderkey % 103 = 0 THEN '1e3'
              WHEN o_orderkey % 107 = 0 THEN '  12.50 '
              ELSE cast(cast(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS amount,
         'CAD' AS currency,
         CASE WHEN copy = 1 THEN 'completed' WHEN o_orderkey % 61 = 0 THEN ' completed '
              WHEN o_orderkey % 67 = 0 THEN 'REFUNDED' ELSE {STATUS_SQL} END AS status,
         strftime(o_orderdate, '%Y-%m-%d') AS txn_date,
         {MONTH_SQL} AS txn_month,
         cast(year(o_orderdate) AS VARCHAR) AS txn_year
  FROM {ORDER_ROWS},
       unnest(CASE WHEN o_orderkey % 73 = 0 THEN [0, 1] ELSE [0] END) AS u(copy))"""

CTE_TX_LINE = f"""tx_line AS (
  SELECT cast(o_orderkey AS VARCHAR) AS id,
         cast(n_regionkey AS VARCHAR) AS org_id,
         cast(l_orderkey AS VARCHAR) || '-' || cast(l_linenumber AS VARCHAR) AS transaction_id,
         c_name AS customer_ref,
         n_name AS province,
         {AGE_GROUP_SQL} AS age_group,
         {ACCOUNT_TYPE_SQL} AS account_type,
         s_name AS merchant,
         p_type AS category,
         cast(l_extendedprice AS DECIMAL(15,2)) AS amount,
         'CAD' AS currency,
         {STATUS_SQL} AS status,
         cast(o_orderdate AS DATE) AS txn_date,
         {MONTH_SQL} AS txn_month,
         cast(year(o_orderdate) AS INTEGER) AS txn_year,
         cast(o_orderdate AS TIMESTAMP) AS loaded_at
  FROM lineitem JOIN {ORDER_ROWS} ON l_orderkey = o_orderkey
       JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey)"""

CTE_INSIGHTS = """insights AS (
  SELECT cast(event_id AS VARCHAR) AS id,
         cast(user_id AS VARCHAR) AS org_id,
         cast(NULL AS VARCHAR) AS run_id,
         event_type AS type,
         event_type || ' insight' AS title,
         props AS content,
         CASE WHEN event_id % 7 = 0 THEN NULL
              ELSE cast(least(value / 500, 1.0) AS DECIMAL(5,4)) END AS confidence,
         props AS metadata,
         cast(ts AS TIMESTAMP) AS created_at
  FROM events)"""

SLUG_SQL = ("regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ ', "
            "'abcdefghijklmnopqrstuvwxyz-'), '[^a-z0-9-]', '', 'g')")

CTE_ORGS = f"""organizations AS (
  SELECT cast(r_regionkey AS VARCHAR) AS id, r_name AS name,
         {SLUG_SQL.format(x='r_name')} AS slug,
         'free' AS plan, 'active' AS status,
         {ORG_MAX_USERS} AS max_users, cast({ORG_MAX_ROWS} AS BIGINT) AS max_rows,
         TIMESTAMP '{FIXTURE_EPOCH}' AS created_at, TIMESTAMP '{FIXTURE_EPOCH}' AS updated_at,
         cast(NULL AS TIMESTAMP) AS deleted_at
  FROM region)"""

CTE_MEMBERSHIPS = f"""memberships AS (
  SELECT cast(c_nationkey AS VARCHAR) AS org_id,
         cast(c_custkey AS VARCHAR) AS user_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin'
              WHEN 'FURNITURE' THEN 'viewer' ELSE 'member' END AS role,
         TIMESTAMP '{FIXTURE_EPOCH}' AS joined_at,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{FIXTURE_EPOCH}' END AS deleted_at
  FROM customer)"""

CTE_MEMBERSHIPS_MULTI = CTE_MEMBERSHIPS + f""",
memberships_multi AS (
  SELECT * FROM memberships
  UNION ALL
  SELECT cast((c_nationkey + 1) % 25 AS VARCHAR) AS org_id,
         cast(c_custkey AS VARCHAR) AS user_id,
         'member' AS role,
         TIMESTAMP '{FIXTURE_EPOCH}' + to_days(cast(c_custkey % 45 AS INTEGER) - 1) AS joined_at,
         cast(NULL AS TIMESTAMP) AS deleted_at
  FROM customer WHERE c_custkey % 4 = 0)"""

CTE_USERS = f"""users AS (
  SELECT cast(c_custkey AS VARCHAR) AS id,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         c_name AS full_name,
         CASE WHEN c_custkey % 50 = 0 THEN TIMESTAMP '{FIXTURE_EPOCH}' END AS deleted_at
  FROM customer)"""

CTE_TOKENS = """refresh_tokens AS (
  SELECT cast(o_orderkey AS VARCHAR) AS token,
         cast(o_custkey AS VARCHAR) AS user_id,
         cast(CASE WHEN o_orderkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END
              AS VARCHAR) AS org_id,
         cast(o_orderdate AS TIMESTAMP) + INTERVAL 7 DAY AS expires_at,
         CASE WHEN o_orderstatus = 'P' THEN cast(o_orderdate AS TIMESTAMP) END AS revoked_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def d_round_div(num: str, den: str) -> str:
    """Integer ``num / den`` rounded half away from zero (den > 0)."""
    q = f"((2 * abs({num}) + ({den})) // (2 * ({den})))"
    return f"(CASE WHEN {num} < 0 THEN -{q} ELSE {q} END)"


def d_quotient(dividend: str, divisor: str, scale: int = 2) -> str:
    """Exact ``round(dividend / divisor, scale)`` as DECIMAL(38, scale)."""
    units = f"cast(({dividend}) * {10 ** scale} AS HUGEINT)"
    den = f"cast(({divisor}) AS HUGEINT)"
    step = f"0.{'0' * (scale - 1)}1" if scale > 0 else "1"
    return (f"CASE WHEN ({divisor}) > 0 THEN cast(cast({d_round_div(units, den)} AS DECIMAL(20,0)) "
            f"* {step} AS DECIMAL(38,{scale})) END")


def d_avg(col: str = "amount", scale: int = 2) -> str:
    return d_quotient(f"sum({col})", f"count({col})", scale)


def d_sum(col: str = "amount") -> str:
    return f"cast(sum({col}) AS DECIMAL(38,2))"


def d_pct(part: str, total: str) -> str:
    """Exact ``round(100.0 * part / total, 2)`` for non-negative integers."""
    return (f"cast(cast((20000 * cast({part} AS HUGEINT) + cast({total} AS HUGEINT)) "
            f"// (2 * cast({total} AS HUGEINT)) AS DECIMAL(20,0)) * 0.01 AS DECIMAL(7,2))")
