"""Test-data adapter: the driver's TPC-H-style tables re-shaped into the
transaction data model (FIXTURES.md §2).

Every fixture is a lazy DataFrame over the given parquet tables, so its work
grows with them.  Joins are left to the planner: dimension sides are small
files that the size-checked auto-broadcast picks up, and at scale the
orders ⋈ customer join becomes a shuffle join whose skewed partitions AQE
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from .tables import read_parquet_table, read_table

# Derivation rules of the fixtures.  Shared with the DuckDB oracle text in
# ledgerlens.plans.oracle, which restates them in DuckDB syntax.
AGE_GROUP_SQL = ("CASE o_custkey % 5 WHEN 0 THEN '18-25' WHEN 1 THEN '26-35' "
                 "WHEN 2 THEN '36-45' WHEN 3 THEN '46-55' ELSE '55+' END")
ACCOUNT_TYPE_SQL = "CASE o_custkey % 3 WHEN 0 THEN 'chequing' WHEN 1 THEN 'savings' ELSE 'premium' END"
STATUS_SQL = ("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' "
              "WHEN 'P' THEN 'failed' END")
MONTH_SQL = "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE date_format(o_orderdate, 'yyyy-MM') END"

# Literal parameters of the organization fixture.
ORG_MAX_ROWS = 3000
ORG_MAX_USERS = 60
FIXTURE_EPOCH = "2024-01-01 00:00:00"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, name, sf_dir)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation, joined fact-first.

    Joining the fact to each dimension in turn keeps every dimension a plain
    scan, whose size the planner knows from its files: the nation side is
    always broadcast, the customer side only while it is small (at scale it is
    a shuffle join on the customer key).  Joining the two dimensions first
    would make the planner estimate their join as the product of both sizes
    and broadcast the fact table instead."""
    orders = _t(spark, sf_dir, "orders")
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenant ``transactions`` (FIXTURES §2.1): one row per order.  Some rows break
    the rules that the staging view and the column tests are there for: amounts
    that are not positive, a foreign status, null customers and categories."""
    return _order_rows(spark, sf_dir).selectExpr(
        "cast(o_orderkey as string) AS id",
        "cast(n_regionkey as string) AS org_id",
        "cast(NULL as string) AS source_id",
        "concat('T', cast(o_orderkey as string)) AS transaction_id",
        "CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE c_name END AS customer_ref",
        "n_name AS province",
        f"{AGE_GROUP_SQL} AS age_group",
        f"{ACCOUNT_TYPE_SQL} AS account_type",
        "concat('M', cast(o_orderkey % 50 as string)) AS merchant",
        "CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE o_orderpriority END AS category",
        "cast(CASE WHEN o_orderkey % 41 = 0 THEN -o_totalprice WHEN o_orderkey % 37 = 0 THEN 0 ELSE o_totalprice END "
        "as decimal(15,2)) AS amount",
        "'CAD' AS currency",
        f"CASE WHEN o_orderkey % 43 = 0 THEN 'REFUNDED' ELSE {STATUS_SQL} END AS status",
        "cast(o_orderdate as date) AS txn_date",
        f"{MONTH_SQL} AS txn_month",
        "cast(year(o_orderdate) as int) AS txn_year",
        "cast(NULL as string) AS metadata",
        "cast(o_orderdate as timestamp_ntz) AS loaded_at",
    )


def raw_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV-shaped strings in file order (FIXTURES §2.2).

    ``seq`` is the file position.  Orders with key % 73 = 0 get a second copy
    (one scan: the copy is generated with ``explode`` instead of a union).
    """
    rows = _order_rows(spark, sf_dir).withColumn(
        "copy", F.explode(F.expr("CASE WHEN o_orderkey % 73 = 0 THEN array(0, 1) ELSE array(0) END")))
    return rows.selectExpr(
        "2 * o_orderkey + copy AS seq",
        "concat('T', cast(o_orderkey as string)) AS transaction_id",
        "c_name AS customer_id",
        "n_name AS province",
        f"{AGE_GROUP_SQL} AS age_group",
        f"{ACCOUNT_TYPE_SQL} AS account_type",
        "concat('M', cast(o_orderkey % 50 as string)) AS merchant",
        "CASE WHEN o_orderkey % 71 = 0 THEN concat('  ', o_orderpriority, '  ') "
        "ELSE o_orderpriority END AS category",
        "CASE WHEN copy = 1 THEN '1.00' WHEN o_orderkey % 53 = 0 THEN '-5.00' "
        "WHEN o_orderkey % 59 = 0 THEN 'abc' WHEN o_orderkey % 79 = 0 THEN NULL "
        "WHEN o_orderkey % 89 = 0 THEN '0.004' WHEN o_orderkey % 83 = 0 THEN '10d' "
        "WHEN o_orderkey % 101 = 0 THEN '0x1p3' WHEN o_orderkey % 103 = 0 THEN '1e3' "
        "WHEN o_orderkey % 107 = 0 THEN '  12.50 ' "
        "ELSE cast(cast(o_totalprice as decimal(15,2)) as string) END AS amount",
        "'CAD' AS currency",
        f"CASE WHEN copy = 1 THEN 'completed' WHEN o_orderkey % 61 = 0 THEN ' completed ' "
        f"WHEN o_orderkey % 67 = 0 THEN 'REFUNDED' ELSE {STATUS_SQL} END AS status",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS txn_date",
        f"{MONTH_SQL} AS txn_month",
        "cast(year(o_orderdate) as string) AS txn_year",
    )


def tx_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-level transactions (FIXTURES §2.3); ``transaction_id`` repeats."""
    lineitem = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_type")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # Two fact tables: a sort-merge join on the order key (it spills, and the
    # hash-partitioned scans already satisfy its distribution).  Left to file
    # statistics, a small lineitem file would be broadcast whole instead.
    rows = (lineitem
            .join(_order_rows(spark, sf_dir).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    return rows.selectExpr(
        "cast(o_orderkey as string) AS id",
        "cast(n_regionkey as string) AS org_id",
        "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS transaction_id",
        "c_name AS customer_ref",
        "n_name AS province",
        f"{AGE_GROUP_SQL} AS age_group",
        f"{ACCOUNT_TYPE_SQL} AS account_type",
        "s_name AS merchant",
        "p_type AS category",
        "cast(l_extendedprice as decimal(15,2)) AS amount",
        "'CAD' AS currency",
        f"{STATUS_SQL} AS status",
        "cast(o_orderdate as date) AS txn_date",
        f"{MONTH_SQL} AS txn_month",
        "cast(year(o_orderdate) as int) AS txn_year",
        "cast(o_orderdate as timestamp_ntz) AS loaded_at",
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored insights (``ai_insights``) from the events table."""
    return _t(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) AS id",
        "cast(user_id as string) AS org_id",
        "cast(NULL as string) AS run_id",
        "event_type AS type",
        "concat(event_type, ' insight') AS title",
        "props AS content",
        "CASE WHEN event_id % 7 = 0 THEN NULL "
        "ELSE cast(least(value / 500, 1.0D) as decimal(5,4)) END AS confidence",
        "props AS metadata",
        "cast(ts as timestamp_ntz) AS created_at",
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants from the region table."""
    return _t(spark, sf_dir, "region").selectExpr(
        "cast(r_regionkey as string) AS id",
        "r_name AS name",
        "r_name AS slug",
        "'free' AS plan",
        "'active' AS status",
        f"{ORG_MAX_USERS} AS max_users",
        f"cast({ORG_MAX_ROWS} as bigint) AS max_rows",
        f"timestamp_ntz'{FIXTURE_EPOCH}' AS created_at",
        f"timestamp_ntz'{FIXTURE_EPOCH}' AS updated_at",
        "cast(NULL as timestamp_ntz) AS deleted_at",
    ).withColumn("slug", slugify("name"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One membership per customer: org = nation, role from the market segment."""
    return _t(spark, sf_dir, "customer").selectExpr(
        "cast(c_nationkey as string) AS org_id",
        "cast(c_custkey as string) AS user_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin' "
        "WHEN 'FURNITURE' THEN 'viewer' ELSE 'member' END AS role",
        f"timestamp_ntz'{FIXTURE_EPOCH}' AS joined_at",
        f"CASE WHEN c_acctbal < 0 THEN timestamp_ntz'{FIXTURE_EPOCH}' END AS deleted_at",
    )


def memberships_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships plus a second org for every fourth customer (for TOP-3).

    The second membership joins the next nation, ``c_custkey % 45`` days after
    the epoch, so the earliest-joined pick varies between the two."""
    second = _t(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr(
        "cast((c_nationkey + 1) % 25 as string) AS org_id",
        "cast(c_custkey as string) AS user_id",
        "'member' AS role",
        f"timestamp_ntz'{FIXTURE_EPOCH}' + make_interval(0, 0, 0, cast(c_custkey % 45 as int) - 1) AS joined_at",
        "CAST(NULL AS timestamp_ntz) AS deleted_at",
    )
    return memberships(spark, sf_dir).unionByName(second)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform users from the customer table (every 50th is soft-deleted)."""
    return _t(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) AS id",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS email",
        "c_name AS full_name",
        f"CASE WHEN c_custkey % 50 = 0 THEN timestamp_ntz'{FIXTURE_EPOCH}' END AS deleted_at",
    )


def refresh_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refresh token per order; every tenth points at a foreign org."""
    orders = _t(spark, sf_dir, "orders")
    customer = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).selectExpr(
        "cast(o_orderkey as string) AS token",
        "cast(o_custkey as string) AS user_id",
        "cast(CASE WHEN o_orderkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END "
        "as string) AS org_id",
        "cast(o_orderdate as timestamp_ntz) + INTERVAL 7 DAYS AS expires_at",
        "CASE WHEN o_orderstatus = 'P' THEN cast(o_orderdate as timestamp_ntz) END AS revoked_at",
    )
