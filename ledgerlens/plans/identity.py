"""Identity queries (PRJ-7/8, TOP-3, JON-1/2, FN-6, QLT-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import identity as ID
from ..operators import staging as S
from ..sources import fixtures as FX
from ..sources.tables import read_parquet_table
from .oracle import (CTE_MEMBERSHIPS, CTE_MEMBERSHIPS_MULTI, CTE_TOKENS, CTE_USERS, SLUG_SQL,
                     with_ctes)
from .registry import register

AS_OF = "2001-07-01 00:00:00"

PRIMARY_SQL = """SELECT org_id, user_id, role, joined_at, deleted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY joined_at NULLS FIRST,
         org_id NULLS FIRST, role NULLS FIRST, deleted_at NULLS FIRST) AS rn
  FROM memberships_multi WHERE deleted_at IS NULL) WHERE rn = 1"""

# (source label, table, key column, text column) of the names that get slugs.
SLUG_SOURCES = [
    ("region", "region", "r_regionkey", "r_name"),
    ("nation", "nation", "n_nationkey", "n_name"),
    ("customer", "customer", "c_custkey", "c_name"),
    ("part", "part", "p_partkey", "p_name"),
    ("document", "documents", "doc_id", "text"),
]


@register("active_rows", with_ctes(CTE_MEMBERSHIPS) + "SELECT * FROM memberships WHERE deleted_at IS NULL")
def q_active_rows(spark, sf_dir):
    """PRJ-7: memberships not soft-deleted."""
    return S.active(FX.memberships(spark, sf_dir))


@register("valid_tokens", with_ctes(CTE_TOKENS) + f"""
SELECT * FROM refresh_tokens WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{AS_OF}'""")
def q_valid_tokens(spark, sf_dir):
    """PRJ-8: unrevoked tokens that expire strictly after ``as_of``."""
    return S.valid_tokens(FX.refresh_tokens(spark, sf_dir), AS_OF)


@register("primary_membership", with_ctes(CTE_MEMBERSHIPS_MULTI) + PRIMARY_SQL)
def q_primary_membership(spark, sf_dir):
    """TOP-3: one active membership per user (earliest joined, then org)."""
    return ID.primary_membership(FX.memberships_multi(spark, sf_dir))


@register("resolve_users", with_ctes(CTE_USERS, CTE_MEMBERSHIPS_MULTI) + f""",
primary_m AS ({PRIMARY_SQL})
SELECT u.email, u.id AS user_id, p.org_id, p.role
FROM users u JOIN primary_m p ON u.id = p.user_id
WHERE u.deleted_at IS NULL""")
def q_resolve_users(spark, sf_dir):
    """JON-1: user → primary org and role."""
    return ID.resolve_users(FX.users(spark, sf_dir), FX.memberships_multi(spark, sf_dir))


@register("token_roles", with_ctes(CTE_TOKENS, CTE_MEMBERSHIPS) + f"""
SELECT t.token, t.user_id, t.org_id, coalesce(m.role, '') AS role
FROM refresh_tokens t
LEFT JOIN (SELECT * FROM memberships WHERE deleted_at IS NULL) m
  ON t.user_id = m.user_id AND t.org_id = m.org_id
WHERE t.revoked_at IS NULL AND t.expires_at > TIMESTAMP '{AS_OF}'""")
def q_token_roles(spark, sf_dir):
    """JON-2: valid token → role (empty when the membership is missing)."""
    return ID.token_roles(FX.refresh_tokens(spark, sf_dir), FX.memberships(spark, sf_dir), AS_OF)


@register("slugify", "\nUNION ALL\n".join(
    f"SELECT '{label}' AS source, cast({key} AS VARCHAR) AS key, {SLUG_SQL.format(x=text)} AS slug "
    f"FROM {table}" for label, table, key, text in SLUG_SOURCES))
def q_slugify(spark, sf_dir):
    """FN-6: slugs of every region, nation, customer and part name and of
    every document's whole text."""
    parts = [read_parquet_table(spark, sf_dir, table).select(
        F.lit(label).alias("source"), F.col(key).cast("string").alias("key"), slugify(text).alias("slug"))
        for label, table, key, text in SLUG_SOURCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("slug_conflicts", f"""
SELECT slug, count(*) AS n_candidates, count(*) - 1 AS n_rejected
FROM (SELECT {SLUG_SQL.format(x='p_name')} AS slug FROM part)
WHERE slug IS NOT NULL GROUP BY slug HAVING count(*) > 1""")
def q_slug_conflicts(spark, sf_dir):
    """QLT-8: org names taken from part names collide on their slug."""
    names = read_parquet_table(spark, sf_dir, "part").select(slugify("p_name").alias("slug"))
    return ID.conflicts(names, "slug")
