"""Tenant queries (AGG-5/6/16, SRC-7/8/9, JON-3/4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade as CA
from ..operators import clean as C
from ..operators import joins as JN
from ..operators import tenancy as TN
from ..schemas import ORGANIZATION_DEFAULT_TYPES, ORGANIZATION_DEFAULTS
from ..functions.text import slugify
from ..sources import fixtures as FX
from ..sources.tables import read_parquet_table
from .cleaning import CTE_CLEAN, CTE_DEDUP, CTE_TYPED
from .marts import TENANT
from .oracle import (CTE_MEMBERSHIPS, CTE_INSIGHTS, CTE_ORGS, CTE_RAW_DIRTY, CTE_TOKENS, CTE_TX, CTE_USERS, SLUG_SQL, d_sum,
                     with_ctes)
from .registry import register

PROMOTE_LOADED_AT = "2025-01-01 00:00:00"

MONTHLY_ALL_SQL = f"""SELECT org_id, month, revenue, volume, month_rank FROM (
  SELECT org_id, month, revenue, volume,
         cast(row_number() OVER (PARTITION BY org_id ORDER BY month DESC NULLS FIRST) AS INTEGER)
           AS month_rank
  FROM (SELECT org_id, txn_month AS month, {d_sum()} AS revenue, count(*) AS volume
        FROM tx WHERE status = 'completed' GROUP BY org_id, txn_month))
WHERE month_rank <= 12 AND month IS NOT NULL"""

CATEGORIES_ALL_SQL = f"""SELECT org_id, category, revenue, volume, avg_amount,
       cast(row_number() OVER (PARTITION BY org_id ORDER BY revenue DESC NULLS FIRST, category)
            AS INTEGER) AS category_rank
FROM (SELECT org_id, category, {d_sum()} AS revenue, count(*) AS volume, cast(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
      FROM tx WHERE status = 'completed' AND category IS NOT NULL GROUP BY org_id, category)"""

QUOTA_ROWS_SQL = """SELECT o.id AS org_id, coalesce(u.rows_used, 0) AS rows_used, o.max_rows,
       coalesce(u.rows_used, 0) > o.max_rows AS over_quota
FROM organizations o LEFT JOIN (SELECT org_id, count(*) AS rows_used FROM tx GROUP BY org_id) u
  ON o.id = u.org_id"""


def _tx(spark, sf_dir):
    return FX.tx(spark, sf_dir)


@register("org_monthly_top12", with_ctes(CTE_TX) + f"""
SELECT month, revenue, volume FROM (
  SELECT txn_month AS month, {d_sum()} AS revenue, count(*) AS volume
  FROM tx WHERE org_id = '{TENANT}' AND status = 'completed'
  GROUP BY txn_month ORDER BY txn_month DESC NULLS FIRST LIMIT 12)
WHERE month IS NOT NULL""")
def q_org_monthly_top12(spark, sf_dir):
    """AGG-5 / TOP-1 for one org."""
    return TN.org_monthly(_tx(spark, sf_dir), TENANT)


@register("org_monthly_top12_all", with_ctes(CTE_TX) + MONTHLY_ALL_SQL)
def q_org_monthly_top12_all(spark, sf_dir):
    """AGG-5 / TOP-1 for every org in one job."""
    return TN.org_monthly_all(_tx(spark, sf_dir))


@register("org_category_breakdown", with_ctes(CTE_TX) + f"""
SELECT category, {d_sum()} AS revenue, count(*) AS volume, cast(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM tx WHERE org_id = '{TENANT}' AND status = 'completed' AND category IS NOT NULL
GROUP BY category ORDER BY revenue DESC""")
def q_org_category_breakdown(spark, sf_dir):
    """AGG-6 for one org."""
    return TN.org_categories(_tx(spark, sf_dir), TENANT)


@register("org_category_breakdown_all", with_ctes(CTE_TX) + CATEGORIES_ALL_SQL)
def q_org_category_breakdown_all(spark, sf_dir):
    """AGG-6 for every org in one job."""
    return TN.org_categories_all(_tx(spark, sf_dir))


@register("default_columns", """
SELECT cast(r_regionkey AS VARCHAR) AS id, r_name AS name, 'free' AS plan, 'active' AS status,
       5 AS max_users, cast(100000 AS BIGINT) AS max_rows
FROM region""")
def q_default_columns(spark, sf_dir):
    """SRC-7: organizations given only id and name receive the column defaults."""
    orgs = FX.organizations(spark, sf_dir).select("id", "name")
    return TN.apply_defaults(orgs, ORGANIZATION_DEFAULTS, required=["id", "name"],
                             types=ORGANIZATION_DEFAULT_TYPES)


@register("promote_new_rows", with_ctes(CTE_TX, CTE_RAW_DIRTY, CTE_DEDUP, CTE_TYPED, CTE_CLEAN) + f"""
SELECT md5(concat_ws(':', '{TENANT}', transaction_id)) AS id, '{TENANT}' AS org_id,
       cast(NULL AS VARCHAR) AS source_id, transaction_id, customer_id AS customer_ref, province,
       age_group, account_type, merchant, category, cast(amount AS DECIMAL(15,2)) AS amount, currency,
       status, txn_date, txn_month, txn_year, cast(NULL AS VARCHAR) AS metadata,
       TIMESTAMP '{PROMOTE_LOADED_AT}' AS loaded_at
FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq) AS rn FROM (
  SELECT * FROM clean UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq, cast(amount + 1 AS DECIMAL(12,2)) AS amount)
  FROM clean WHERE seq % 11 = 0)) WHERE rn = 1) c
WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.org_id = '{TENANT}' AND tx.transaction_id = c.transaction_id)""")
def q_promote_new_rows(spark, sf_dir):
    """SRC-8: cleaned raw rows promoted into one tenant, skipping stored keys;
    every eleventh position is offered again later with another amount."""
    clean = C.clean_transactions(FX.raw_dirty(spark, sf_dir))
    again = F.explode(F.expr("CASE WHEN seq % 11 = 0 THEN array(0, 1) ELSE array(0) END"))
    raw = (clean.withColumn("again", again)
           .withColumn("seq", F.col("seq") + F.col("again") * 1_000_000_000)
           .withColumn("amount", (F.col("amount") + F.col("again")).cast("decimal(12,2)")).drop("again")
           .withColumn("ingested_at", F.lit(PROMOTE_LOADED_AT).cast("timestamp_ntz")))
    return TN.promote(raw, TENANT, _tx(spark, sf_dir))


# Nations offered as orgs, one after the other (``place``): first each under its
# own id and slug, some of which stored orgs hold; then every third one's slug under
# another id, which is refused; then that other id with a slug of its own, which
# goes in, for the refused row never took the id; then that slug once more.
# The oracle walks the offers in order and carries the ids and slugs taken so far.
CTE_ALL_ORGS = f"""offers AS (
  SELECT row_number() OVER (ORDER BY copy, n_nationkey) AS place,
         cast(n_nationkey + CASE copy WHEN 0 THEN 0 WHEN 3 THEN 200 ELSE 100 END AS VARCHAR) AS id, n_name AS name,
         {SLUG_SQL.format(x='n_name')} || CASE WHEN copy >= 2 THEN '-2' ELSE '' END AS slug
  FROM nation, unnest(CASE WHEN n_nationkey % 3 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS u(copy)),
walk AS (
  SELECT cast(0 AS BIGINT) AS place, (SELECT list(id) FROM organizations) AS ids,
         (SELECT list(slug) FROM organizations) AS slugs, false AS goes_in
  UNION ALL
  SELECT o.place,
         CASE WHEN list_contains(ids, o.id) OR list_contains(slugs, o.slug) THEN ids ELSE list_append(ids, o.id) END,
         CASE WHEN list_contains(ids, o.id) OR list_contains(slugs, o.slug) THEN slugs ELSE list_append(slugs, o.slug) END,
         NOT (list_contains(ids, o.id) OR list_contains(slugs, o.slug))
  FROM walk JOIN offers o ON o.place = walk.place + 1),
all_orgs AS (
  SELECT * FROM organizations
  UNION ALL
  SELECT id, name, slug, 'free' AS plan, 'active' AS status, {FX.ORG_MAX_USERS} AS max_users,
         cast({FX.ORG_MAX_ROWS} AS BIGINT) AS max_rows, TIMESTAMP '{FX.FIXTURE_EPOCH}' AS created_at,
         TIMESTAMP '{FX.FIXTURE_EPOCH}' AS updated_at, cast(NULL AS TIMESTAMP) AS deleted_at
  FROM offers JOIN walk USING (place) WHERE goes_in)"""


@register("insert_if_absent", with_ctes(CTE_ORGS, CTE_ALL_ORGS).replace("WITH", "WITH RECURSIVE", 1) + "SELECT * FROM all_orgs")
def q_insert_if_absent(spark, sf_dir):
    """SRC-9: nations offered as new orgs; id or slug conflicts, with stored
    orgs or with orgs that went in before, are skipped."""
    orgs = FX.organizations(spark, sf_dir)
    copies = F.explode(F.expr("CASE WHEN n_nationkey % 3 = 0 THEN array(0, 1, 2, 3) ELSE array(0) END"))
    offers = (read_parquet_table(spark, sf_dir, "nation").withColumn("copy", copies)
              .selectExpr("copy", "n_nationkey", "cast(n_nationkey + CASE copy WHEN 0 THEN 0 WHEN 3 THEN 200 ELSE 100 END as string) AS id",
                          "n_name AS name")
              .withColumn("slug", F.concat(slugify("name"), F.expr("CASE WHEN copy >= 2 THEN '-2' ELSE '' END"))))
    incoming = _with_org_defaults(offers, "copy", "n_nationkey")
    return TN.insert_if_absent(orgs, incoming, [["id"], ["slug"]], order=["copy", "n_nationkey"])


def _with_org_defaults(df, *more):
    return df.select(
        *more, "id", "name", "slug", F.lit("free").alias("plan"), F.lit("active").alias("status"),
        F.lit(FX.ORG_MAX_USERS).alias("max_users"), F.lit(FX.ORG_MAX_ROWS).cast("bigint").alias("max_rows"),
        F.lit(FX.FIXTURE_EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.lit(FX.FIXTURE_EPOCH).cast("timestamp_ntz").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"))


@register("quota_rows", with_ctes(CTE_TX, CTE_ORGS) + QUOTA_ROWS_SQL)
def q_quota_rows(spark, sf_dir):
    """AGG-16: rows per org against the row quota."""
    return TN.quota_rows(FX.organizations(spark, sf_dir), _tx(spark, sf_dir))


@register("quota_users", with_ctes(CTE_ORGS, CTE_MEMBERSHIPS) + """
SELECT o.id AS org_id, coalesce(u.users_used, 0) AS users_used, o.max_users,
       coalesce(u.users_used, 0) > o.max_users AS over_quota
FROM organizations o LEFT JOIN (SELECT org_id, count(*) AS users_used FROM memberships
                                WHERE deleted_at IS NULL GROUP BY org_id) u ON o.id = u.org_id""")
def q_quota_users(spark, sf_dir):
    """AGG-16: active members per org against the user quota."""
    return TN.quota_users(FX.organizations(spark, sf_dir), FX.memberships(spark, sf_dir))


@register("relationships", with_ctes(CTE_ORGS, CTE_MEMBERSHIPS) + """
SELECT * FROM memberships m
WHERE m.org_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM organizations o WHERE o.id = m.org_id)""")
def q_relationships(spark, sf_dir):
    """JON-3 / QLT-4: memberships whose org does not exist."""
    return TN.orphans(FX.memberships(spark, sf_dir), FX.organizations(spark, sf_dir), "org_id", "id")


@register("cascade_purge", with_ctes(CTE_TX, CTE_ORGS) + f""",
quota AS ({QUOTA_ROWS_SQL})
SELECT * FROM tx WHERE NOT EXISTS (SELECT 1 FROM quota q WHERE q.over_quota AND q.org_id = tx.org_id)""")
def q_cascade_purge(spark, sf_dir):
    """JON-4: remove the transactions of purged orgs (here: orgs over their row quota)."""
    tx = _tx(spark, sf_dir)
    orgs = FX.organizations(spark, sf_dir)
    purged = TN.quota_rows(orgs, tx).where("over_quota")
    return TN.purge_orgs(tx, purged, deleted_key="org_id", organizations=orgs)


@register("cascade_purge_all", with_ctes(CTE_TX, CTE_ORGS, CTE_MEMBERSHIPS, CTE_USERS, CTE_TOKENS, CTE_INSIGHTS) + f""",
gone_orgs AS (SELECT org_id AS id FROM ({QUOTA_ROWS_SQL}) WHERE over_quota),
gone_users AS (SELECT id FROM users WHERE deleted_at IS NOT NULL)
SELECT 'organizations' AS table_name, id AS row_key FROM organizations WHERE id IN (SELECT id FROM gone_orgs)
UNION ALL SELECT 'users', id FROM gone_users
UNION ALL SELECT 'transactions', id FROM tx WHERE org_id IN (SELECT id FROM gone_orgs)
UNION ALL SELECT 'ai_insights', id FROM insights WHERE org_id IN (SELECT id FROM gone_orgs)
UNION ALL SELECT 'memberships', concat_ws('/', org_id, user_id) FROM memberships
  WHERE org_id IN (SELECT id FROM gone_orgs) OR user_id IN (SELECT id FROM gone_users)
UNION ALL SELECT 'refresh_tokens', token FROM refresh_tokens
  WHERE org_id IN (SELECT id FROM gone_orgs) OR user_id IN (SELECT id FROM gone_users)""")
def q_cascade_purge_all(spark, sf_dir):
    """JON-4: what goes from every table when the orgs over their row quota and the
    soft-deleted users are deleted."""
    tx, orgs, users = _tx(spark, sf_dir), FX.organizations(spark, sf_dir), FX.users(spark, sf_dir)
    roots = {"organizations": TN.quota_rows(orgs, tx).where("over_quota").select(F.col("org_id").alias("id")),
             "users": users.where("deleted_at IS NOT NULL")}
    flagged, _ = CA.close_delete({"organizations": orgs, "users": users, "transactions": tx,
                                  "ai_insights": FX.insights(spark, sf_dir), "memberships": FX.memberships(spark, sf_dir),
                                  "refresh_tokens": FX.refresh_tokens(spark, sf_dir)}, roots)
    keys = {"memberships": "concat_ws('/', org_id, user_id)", "refresh_tokens": "token"}
    parts = [df.where("_gone").select(F.lit(name).alias("table_name"), F.expr(keys.get(name, "id")).alias("row_key"))
             for name, df in flagged.items()]
    return reduce(DataFrame.unionAll, parts)


CUSTOMER_DIM_SQL = [
    "cast(c_custkey as string) AS customer_id",
    "n_name AS province",
    FX.AGE_GROUP_SQL.replace("o_custkey", "c_custkey") + " AS age_group",
    FX.ACCOUNT_TYPE_SQL.replace("o_custkey", "c_custkey") + " AS account_type",
]


@register("attach_customer", f"""
WITH customers AS (SELECT {', '.join(CUSTOMER_DIM_SQL).replace('as string', 'AS VARCHAR')}
                   FROM customer JOIN nation ON c_nationkey = n_nationkey),
     raw AS (SELECT 'T' || cast(o_orderkey AS VARCHAR) AS transaction_id,
                    cast(o_custkey AS VARCHAR) AS customer_id,
                    cast(o_totalprice AS DECIMAL(15,2)) AS amount FROM orders)
SELECT r.customer_id, r.transaction_id, r.amount, c.province, c.age_group, c.account_type
FROM raw r JOIN customers c ON r.customer_id = c.customer_id""")
def q_attach_customer(spark, sf_dir):
    """JON-5: transactions denormalised with their customer's attributes."""
    customer = read_parquet_table(spark, sf_dir, "customer")
    nation = read_parquet_table(spark, sf_dir, "nation")
    customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(*CUSTOMER_DIM_SQL)
    raw = read_parquet_table(spark, sf_dir, "orders").selectExpr(
        "concat('T', cast(o_orderkey as string)) AS transaction_id",
        "cast(o_custkey as string) AS customer_id", "cast(o_totalprice as decimal(15,2)) AS amount")
    return JN.attach_customer(raw, customers)
