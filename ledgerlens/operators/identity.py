"""Identity lookups restated as table operators (PRJ-7/8, TOP-3, JON-1/2, QLT-8).

The service resolves one user or one token per request; here the same rules
run for all users or tokens at once, as joins keyed on the user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import dedupe_first
from .staging import active, valid_tokens


def primary_membership(memberships: DataFrame) -> DataFrame:
    """TOP-3: one active membership per user.

    The service takes an arbitrary one (``LIMIT 1`` without an order); this
    picks the earliest ``joined_at``, then the smallest ``org_id``.  It is a
    first-row window, which Spark limits per partition before the shuffle, so
    a user in very many orgs leaves each partition as one row."""
    return dedupe_first(active(memberships), ["user_id"], ["joined_at", "org_id"])


def resolve_users(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """JON-1: active users with their primary org and role; users without an
    active membership are not resolved (inner join)."""
    people = active(users).select(F.col("id").alias("user_id"), "email")
    member = primary_membership(memberships).select("user_id", "org_id", "role")
    return people.join(member, "user_id").select("email", "user_id", "org_id", "role")


def token_roles(tokens: DataFrame, memberships: DataFrame, as_of: dt.datetime | str) -> DataFrame:
    """JON-2: valid tokens with the role of their (user, org); a missing
    membership leaves the role empty, as the service ignores that error."""
    live = valid_tokens(tokens, as_of).select("token", "user_id", "org_id")
    roles = active(memberships).select("user_id", "org_id", "role")
    return (live.join(roles, ["user_id", "org_id"], "left")
            .select("token", "user_id", "org_id", F.coalesce("role", F.lit("")).alias("role")))


def conflicts(df: DataFrame, keys: list[str] | str) -> DataFrame:
    """QLT-8: unique-key collisions: key values seen more than once, with the
    number of rows that a unique constraint would reject (all but the first).
    Null keys never collide."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    not_null = None
    for k in keys:
        cond = F.col(k).isNotNull()
        not_null = cond if not_null is None else not_null & cond
    return (df.where(not_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"))
            .where(F.col("n_candidates") > 1)
            .withColumn("n_rejected", F.col("n_candidates") - 1))
