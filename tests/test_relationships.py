"""QLT-4 as a test of the report and as a load contract."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import quality as Q
from ledgerlens.plans import QUERIES
from ledgerlens.sources import sinks as K
from test_sinks import LOADED_AT, _write_csv


def test_many_keys_in_one_pass(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "id string, n int")
    child = spark.createDataFrame([("a", 1, "x")] * 3 + [("z", 9, "y"), ("z", 2, None), (None, None, "w")], "p string, n int, other string")
    tests = [Q.ColumnTest("c", "p", "relationships", to="parents"),
             Q.ColumnTest("c", "n", "relationships", to="parents", to_column="n"),
             Q.ColumnTest("c", "other", "relationships", to="parents", severity="warn"),
             Q.ColumnTest("c", "p", "not_null")]
    report = Q.run_tests({"c": child, "parents": parents}, tests)
    assert {(r.column_name, r.test): (r.failures, r.passed) for r in report.collect()} == {
        ("p", "relationships"): (2, False), ("n", "relationships"): (1, False), ("other", "relationships"): (5, False), ("p", "not_null"): (1, False)}
    empty = Q.run_tests({"c": child.limit(0), "parents": parents}, tests)
    assert all(r.passed for r in empty.collect())
    with pytest.raises(ValueError, match="parents"):
        Q.run_tests({"c": child}, tests)


def test_one_scan_of_each_child(spark, sf_dir):
    plan = QUERIES["dq_relationships"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 2, plan          # tokens and transactions: three and two keys in one pass each


def test_a_load_contract(spark, sf_dir, scratch):
    csv, raw_path, runs = (os.path.join(scratch, x) for x in ("in.csv", "raw", "runs"))
    _write_csv(spark, sf_dir, csv)
    known = K.read_transactions_csv(spark, csv).select(F.col("customer_id").alias("id")).distinct().checkpoint()
    contract = [Q.ColumnTest("raw", "customer_id", "relationships", to="customers")]
    assert K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT, contracts=contract, parents={"customers": known}) > 0
    before = K.current_version(spark, raw_path)
    with pytest.raises(Q.QualityError, match="customer_id relationships"):
        K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT, contracts=contract, parents={"customers": known.limit(3)})
    assert K.current_version(spark, raw_path) == before
