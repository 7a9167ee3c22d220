"""Plan-shape guards over every registered query."""

import os

import pytest

from ledgerlens.operators import marts as M
from ledgerlens.operators import staging as S
from ledgerlens.plans import QUERIES
from ledgerlens.sources import fixtures as FX
from ledgerlens.sources import sinks as K

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins_or_row_udfs(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op} in plan"


def test_filters_and_columns_reach_the_scan(spark, sf_dir, scratch):
    """On a stored transactions table the staging/mart predicates are pushed
    into the parquet scan and only the used columns are read."""
    path = os.path.join(scratch, "transactions")
    FX.tx(spark, sf_dir).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        mart = M.fct_revenue_by_category(S.stg_transactions(spark.read.parquet(path)))
        plan = mart._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ["GreaterThan(amount,0.00)", "In(status, [completed,failed,pending])",
                   "EqualTo(status,completed)"]:
        assert pushed in plan
    assert "ReadSchema: struct<category:string,amount:decimal(15,2),status:string>" in plan


@pytest.mark.parametrize("name", ["cascade_purge", "relationships"])
def test_small_key_sets_are_broadcast(spark, sf_dir, name):
    """Purged orgs (bounded by their stored parent table) and parent keys are
    broadcast, so the fact side is never shuffled on org."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, plan


def test_refresh_prunes_to_the_touched_months(spark, sf_dir, scratch):
    """On the stored, month-partitioned table the recompute scan is pruned at
    run time to the touched months, the null month's scan to its own folder,
    and the refresh equals a full rebuild of those months."""
    path = os.path.join(scratch, "transactions")
    K.append_transactions(FX.tx(spark, sf_dir), path)
    stg = S.stg_transactions(K.read_transactions(spark, path))
    since = "2001-05-01 00:00:00"
    fresh = M.fresh_months(stg, since, by_partition=True)
    rows = sorted(map(tuple, fresh.collect()), key=str)
    plan = fresh._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [isnull(txn_month" in plan, plan
    months = {r.txn_month for r in M.touched_months(stg, since).collect()}
    full = M.fct_monthly_revenue(stg).collect()
    assert 0 < len(rows) < len(full)
    assert rows == sorted([tuple(r) for r in full if r.txn_month in months], key=str)


def test_quality_report_reads_the_fact_three_times(spark, sf_dir):
    """Marts (one grouping-sets pass), fused source checks, and the unique id test."""
    plan = QUERIES["dq_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 3, plan
