"""Deletes closed over the key graph (JON-4).

Foreign keys are data.  A delete starts from root keys and follows the cascading
keys, tables in the order of their references, so each table is read once with
all its keys checked in that pass.  A row that stays and refers to a deleted row
by a key that does not cascade refuses the whole delete.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    cascade: bool = True
    parent_key: str = "id"


# The foreign keys of the stored tables.
FOREIGN_KEYS = [
    ForeignKey("memberships", "org_id", "organizations"),
    ForeignKey("memberships", "user_id", "users"),
    ForeignKey("memberships", "invited_by", "users", cascade=False),
    ForeignKey("refresh_tokens", "user_id", "users"),
    ForeignKey("refresh_tokens", "org_id", "organizations"),
    ForeignKey("subscriptions", "org_id", "organizations"),
    ForeignKey("data_sources", "org_id", "organizations"),
    ForeignKey("data_sources", "created_by", "users", cascade=False),
    ForeignKey("transactions", "org_id", "organizations"),
    ForeignKey("transactions", "source_id", "data_sources", cascade=False),
    ForeignKey("pipeline_runs", "org_id", "organizations"),
    ForeignKey("pipeline_runs", "source_id", "data_sources", cascade=False),
    ForeignKey("pipeline_runs", "triggered_by", "users", cascade=False),
    ForeignKey("ai_insights", "org_id", "organizations"),
    ForeignKey("ai_insights", "run_id", "pipeline_runs", cascade=False),
    ForeignKey("audit_logs", "org_id", "organizations"),
    ForeignKey("audit_logs", "user_id", "users", cascade=False),
]


class RefusedDelete(RuntimeError):
    """Rows that stay refer to rows that the delete would remove."""


def table_order(tables: list[str], keys: list[ForeignKey]) -> list[str]:
    """Parents before children; a cycle of keys raises."""
    left, out = set(tables), []
    while left:
        free = sorted(t for t in left if not any(k.child == t and k.parent in left for k in keys))
        if not free:
            raise ValueError(f"the keys of {', '.join(sorted(left))} form a cycle")
        out += free
        left -= set(free)
    return out


def close_delete(tables: dict[str, DataFrame], roots: dict[str, DataFrame],
                 keys: list[ForeignKey] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table with ``_gone`` (the delete removes the row), and the refusals:
    ``child, column, parent, rows`` for each non-cascading key that rows which stay
    hold to rows that go.

    ``roots`` gives the rows to delete by their ``id``.  Columns and tables that
    are absent have no keys; a null key refers to nothing.  Keys of deleted rows
    are distinct and joined without a hint: the planner broadcasts a side that its
    statistics show to be small, and splits a skewed one otherwise."""
    keys = [k for k in (FOREIGN_KEYS if keys is None else keys)
            if k.child in tables and k.parent in tables and k.column in tables[k.child].columns]
    flagged: dict[str, DataFrame] = {}
    doomed: dict[tuple[str, str], DataFrame] = {}

    def mark(df: DataFrame, column: str, side: DataFrame, name: str) -> DataFrame:
        return df.join(side.select(F.col("_key").alias(f"{name}_key"), F.lit(True).alias(name)), F.col(column) == F.col(f"{name}_key"),
                       "left").drop(f"{name}_key")

    found = []
    for table in table_order(list(tables), keys):
        df, cascades, refuses = tables[table], [], {}
        if table in roots:
            df = mark(df, "id", roots[table].select(F.col("id").alias("_key")).where("_key IS NOT NULL").distinct(), "_root")
            cascades.append("_root")
        for i, k in enumerate(k for k in keys if k.child == table):
            if (side := doomed.get((k.parent, k.parent_key))) is not None:
                df = mark(df, k.column, side, f"_fk{i}")
                if k.cascade:
                    cascades.append(f"_fk{i}")
                else:
                    refuses[f"_fk{i}"] = k
        known = lambda name: F.coalesce(F.col(name), F.lit(False))
        gone = reduce(Column.__or__, [known(c) for c in cascades], F.lit(False))
        whole = df.withColumn("_gone", gone)
        flagged[table] = whole.drop(*cascades, *refuses)
        if cascades:
            for key in {k.parent_key for k in keys if k.parent == table}:
                doomed[table, key] = whole.where("_gone").select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
        if refuses:
            counts = whole.agg(*[F.count_if(~F.col("_gone") & known(name)).alias(name) for name in refuses])
            rows = F.array(*[F.struct(F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), F.lit(k.parent).alias("parent"),
                                      F.col(name).alias("rows")) for name, k in refuses.items()])
            found.append(counts.select(F.inline(rows)).where("rows > 0"))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return flagged, spark.createDataFrame([], "child string, column string, parent string, rows long")
    return flagged, reduce(DataFrame.unionAll, found)


def purge_set(spark: SparkSession, path: str, roots: dict[str, DataFrame], keys: list[ForeignKey] | None = None,
              partition_by: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Delete ``roots`` and all that hangs on them from a stored table set, in one
    commit; the number of rows removed from each table.  A refusal raises
    :class:`RefusedDelete` and changes nothing, and so does a load that was
    committed meanwhile (:class:`~ledgerlens.sources.commits.ConcurrentLoad`).
    Only version folders that hold a deleted row are written anew."""
    at = commits.snapshot(spark, path)
    tables = {name: commits.read_snapshot(spark, path, at, name, keep_version=True) for name in at.tables}
    flagged, refusals = close_delete(tables, roots, keys)
    refused = refusals.collect()
    if refused:
        raise RefusedDelete("; ".join(f"{r.rows} rows of {r.child}.{r.column} refer to deleted {r.parent}" for r in refused))
    removed = {name: {r["v"]: r["count"] for r in df.where("_gone").groupBy("v").count().collect()} for name, df in flagged.items()}
    touched = {name: [f for f in at.tables[name] if f.rpartition("v=")[2] in own] for name, own in removed.items() if own}
    if touched:
        load = commits.Load(spark, path, {name: "append" for name in touched}, conflict="fail", base=at, merged=touched)
        try:
            for name, folders in touched.items():
                kept = flagged[name].where(~F.col("_gone") & F.col("v").isin(list(removed[name]))).drop("_gone", "v")
                kept.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(load.folder(name))
        except BaseException:
            load.abandon()
            raise
        load.commit()
    return {name: sum(own.values()) for name, own in removed.items()}
