"""Tenant scope that cannot be forgotten (PRJ-5).

Every tenant table is a temporary view over a session variable.  Readers query
the view by its name and get the current tenant's rows; with no tenant set the
query fails instead of reading across tenants.  The variable is a constant to the
optimizer, so the predicate reaches the scan as ``org_id = '...'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VARIABLE = "ledgerlens_tenant"
UNSET = "no tenant is set: refusing to read across tenants"


def create_tenant_views(spark: SparkSession, tables: dict[str, DataFrame], org_column: str = "org_id") -> None:
    """A view of each table under its name, scoped to the session's tenant; no
    tenant is set at first.  Queries see the tenant as of their making."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    for name, df in tables.items():
        if org_column not in df.columns:
            raise ValueError(f"{name} has no column {org_column}")
        whole = f"_{name}_of_all_tenants"
        df.createOrReplaceTempView(whole)
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM `{whole}` "
                  f"WHERE `{org_column}` = coalesce(nullif(session.{VARIABLE}, ''), raise_error('{UNSET}'))")


def set_tenant(spark: SparkSession, org_id: str | None) -> None:
    """The tenant of the queries made from here on; None unsets it."""
    spark.sql(f"SET VARIABLE {VARIABLE} = CAST(:org AS STRING)", args={"org": None if org_id is None else str(org_id)})
