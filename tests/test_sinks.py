"""Loads, run log, CSV I/O, insight store and the incremental stream."""

import datetime as dt
import glob
import os
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import insights as IN
from ledgerlens.operators.clean import clean_transactions
from ledgerlens.operators import marts as M
from ledgerlens.operators import quality as Q
from ledgerlens.operators import staging as S
from ledgerlens.schemas import CSV_COLUMNS, PLACEHOLDER_TITLE
from ledgerlens.sources import fixtures as FX
from ledgerlens.sources import sinks as K

LOADED_AT = dt.datetime(2025, 6, 1, 12, 0, 0)


def _fitting(raw):
    """The dirty fixture within the raw table's constraints: short province codes, every month given."""
    return raw.withColumn("province", F.substring("province", 1, 5)).withColumn("txn_month", F.substring("txn_date", 1, 7))


def _write_csv(spark, sf_dir, path, bad_date=False):
    raw = _fitting(FX.raw_dirty(spark, sf_dir))
    if bad_date:
        raw = raw.withColumn("txn_date", F.when(F.col("seq") == 2, F.lit("2025-99-99")).otherwise(F.col("txn_date")))
    K.write_transactions_csv(raw.orderBy("seq"), path)
    return raw


def test_csv_round_trip_keeps_file_order(spark, sf_dir, scratch):
    path = os.path.join(scratch, "transactions.csv")
    raw = _write_csv(spark, sf_dir, path)
    back = K.read_transactions_csv(spark, path)
    assert back.columns == ["seq"] + CSV_COLUMNS
    assert K.extract_summary(back) == {"rows": raw.count(), "columns": CSV_COLUMNS}
    # Same cleaning result whether the order comes from seq or from the file position.
    a = sorted(map(tuple, clean_transactions(raw).drop("seq").collect()), key=str)
    b = sorted(map(tuple, clean_transactions(back).drop("seq").collect()), key=str)
    assert a == b


def test_null_tokens(spark, scratch):
    path = os.path.join(scratch, "na.csv")
    with open(path, "w") as f:
        f.write(",".join(CSV_COLUMNS) + "\n")
        f.write("T1,NA,null,N/A,,m,c,NaN,CAD,completed,2025-01-01,2025-01,2025\n")
    row = K.read_transactions_csv(spark, path).first()
    assert row.customer_id is None and row.province is None and row.age_group is None
    assert row.amount is None and row.account_type is None and row.merchant == "m"


def test_ingest_twice_equals_once_and_failure_keeps_old(spark, sf_dir, scratch):
    csv = os.path.join(scratch, "in.csv")
    _write_csv(spark, sf_dir, csv)
    raw_path, runs = os.path.join(scratch, "raw"), os.path.join(scratch, "runs")
    n1 = K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT)
    first = sorted(map(tuple, K.read_versioned(spark, raw_path).collect()))
    n2 = K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT)
    second = sorted(map(tuple, K.read_versioned(spark, raw_path).collect()))
    assert n1 == n2 == len(first) and first == second
    ids = sorted(r.id for r in K.read_versioned(spark, raw_path).select("id").collect())
    assert ids == list(range(1, n1 + 1))          # dense, restarting at 1

    bad = os.path.join(scratch, "bad.csv")
    _write_csv(spark, sf_dir, bad, bad_date=True)
    with pytest.raises(Exception):
        K.ingest(spark, bad, raw_path, runs, loaded_at=LOADED_AT)
    assert sorted(map(tuple, K.read_versioned(spark, raw_path).collect())) == first
    log = spark.read.parquet(runs).orderBy("run_at").collect()
    assert [r.status for r in log] == ["success", "success", "failed"]
    assert log[-1].rows_loaded == 0 and "strict cast failed" in log[-1].notes
    versions = glob.glob(os.path.join(raw_path, "v=*"))
    assert K.current_version(spark, raw_path) in versions and len(versions) == 2       # current, superseded


def test_dense_ids_follow_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("seq"))
    out = K.with_load_columns(df, LOADED_AT, "seq").collect()
    assert sorted((r.seq, r.id) for r in out) == [(i, i + 1) for i in range(1000)]
    assert {r.ingested_at for r in out} == {LOADED_AT}


def test_build_all_writes_marts(spark, sf_dir, scratch):
    tx = FX.tx(spark, sf_dir)
    counts = K.build_all(spark, tx, scratch, blocking=())
    with pytest.raises(Q.QualityError):            # the null month breaks a not_null test
        K.build_all(spark, tx, scratch)
    stg = S.stg_transactions(tx)
    for name, n in counts.items():
        stored = K.read_versioned(spark, os.path.join(scratch, name))
        ref = getattr(M, name)(stg)
        assert n == ref.count()
        assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_quality_report_and_enforce(spark):
    df = spark.createDataFrame([("a", "completed"), ("a", "REFUNDED"), (None, None), ("b", "REFUNDED")],
                               "id string, status string")
    tests = [Q.ColumnTest("t", "id", "not_null"), Q.ColumnTest("t", "id", "unique"),
             Q.ColumnTest("t", "status", "accepted_values", ("completed", "pending", "failed"))]
    report = {(r.column_name, r.test): r.failures for r in Q.run_tests({"t": df}, tests).collect()}
    assert report == {("id", "not_null"): 1, ("id", "unique"): 1, ("status", "accepted_values"): 1}
    with pytest.raises(Q.QualityError):
        Q.enforce(Q.run_tests({"t": df}, tests))
    ok = spark.createDataFrame([("a", "completed")], "id string, status string")
    Q.enforce(Q.run_tests({"t": ok}, tests))


def test_placeholder_and_stub_generator(spark, sf_dir, scratch):
    requests = IN.insight_requests(IN.insight_context(FX.tx(spark, sf_dir)))
    placeholder = IN.generate_insights(requests).collect()
    assert {r.title for r in placeholder} == {PLACEHOLDER_TITLE}
    assert {r.confidence for r in placeholder} == {Decimal("0.0000")}

    def stub(batch: pd.DataFrame) -> pd.DataFrame:
        lines = batch["data"].str.count("\n")
        return pd.DataFrame({"response": [
            '{"title": "%s for %s", "content": "%d lines", "confidence": %s}' % (t, o, n, "0.75" if t != "anomaly" else "12")
            for t, o, n in zip(batch["type"], batch["org_id"], lines)]})

    parsed = IN.split_insights(IN.generate_insights(requests, stub))
    rows = parsed.collect()
    assert len(rows) == requests.count()
    assert all(r.valid_json for r in rows)
    assert {r.stored for r in rows if r.type == "anomaly"} == {False}
    assert {r.confidence for r in rows if r.type != "anomaly"} == {Decimal("0.7500")}

    store = os.path.join(scratch, "ai_insights")
    IN.store_insights(parsed.where("stored"), store, created_at=LOADED_AT)
    stored = spark.read.parquet(store)
    assert stored.count() == sum(r.stored for r in rows)
    assert stored.where("run_id IS NOT NULL OR metadata IS NOT NULL").count() == 0


def test_parse_insight_json_edge_rows(spark):
    df = spark.createDataFrame([
        ('{"title": "t", "content": "c", "confidence": 0.5}',),
        ('{"title": "t"}',),
        ('{"title": "t", "content": "c", "confidence": 0.5, "extra": 1}',),
        ("not json",),
        ('{"title": "t", "content": "c", "confidence": 12}',),
    ], "response string")
    rows = IN.split_insights(df).collect()
    assert [(r.valid_json, r.title, r.content, r.confidence, r.stored) for r in rows] == [
        (True, "t", "c", Decimal("0.5000"), True),
        (True, "t", "", Decimal("0.0000"), True),
        (True, "t", "c", Decimal("0.5000"), True),
        (False, None, None, None, False),
        (True, "t", "c", None, False),
    ]


def _halves(raw):
    """Two batches split at the median file position (both non-empty)."""
    mid = raw.agg(F.percentile_approx("seq", 0.5)).first()[0]
    first, second = raw.where(F.col("seq") < mid), raw.where(F.col("seq") >= mid)
    assert first.count() > 0 and second.count() > 0
    return first, second


def test_incremental_stream_equals_full_rebuild(spark, sf_dir, scratch):
    from ledgerlens.operators.clean import clean_transactions
    from ledgerlens.operators.tenancy import promote
    from ledgerlens.streaming.incremental import start_incremental_ingest

    raw = FX.raw_dirty(spark, sf_dir)
    src = os.path.join(scratch, "incoming")
    os.makedirs(src)
    first, second = _halves(raw)
    K.write_transactions_csv(first.orderBy("seq").coalesce(1), os.path.join(scratch, "part1"))
    K.write_transactions_csv(second.orderBy("seq").coalesce(1), os.path.join(scratch, "part2"))
    tx_path, mart_path, ckpt = (os.path.join(scratch, x) for x in ("tx", "mart", "ckpt"))

    for part in ("part1", "part2"):
        for f in glob.glob(os.path.join(scratch, part, "*.csv")):
            os.link(f, os.path.join(src, f"{part}.csv"))
        q = start_incremental_ingest(spark, src, tx_path, mart_path, ckpt, org_id="7")
        q.awaitTermination(300)

    stored = K.read_transactions(spark, tx_path)
    full = promote(clean_transactions(raw).withColumn("ingested_at", F.lit(LOADED_AT)), "7",
                   spark.createDataFrame([], stored.schema))
    key = ["transaction_id", "amount", "status", "category"]
    assert sorted(map(tuple, stored.select(*key).collect())) == sorted(map(tuple, full.select(*key).collect()))
    mart = spark.read.parquet(mart_path)
    expected = M.fct_monthly_revenue(S.stg_transactions(stored))
    cols = expected.columns
    assert sorted(map(tuple, mart.select(*cols).collect()), key=str) == \
        sorted(map(tuple, expected.collect()), key=str)


def test_replayed_batch_still_refreshes_its_months(spark, sf_dir, scratch):
    """A batch whose rows were appended by a failed attempt (before the mart
    write) is replayed with a new load stamp: the mart must still equal a
    full rebuild."""
    from ledgerlens.operators.tenancy import promote
    from ledgerlens.streaming.incremental import process_batch

    raw = FX.raw_dirty(spark, sf_dir)
    first, second = _halves(raw)
    tx_path, mart_path = os.path.join(scratch, "tx"), os.path.join(scratch, "mart")
    process_batch(first, 0, org_id="7", tx_path=tx_path, mart_path=mart_path, loaded_at=LOADED_AT)
    # The crashed attempt of batch 1: rows appended, mart not refreshed.
    stored = K.read_transactions(spark, tx_path)
    again = promote(clean_transactions(second).withColumn("ingested_at", F.lit(LOADED_AT + dt.timedelta(hours=1))),
                    "7", stored)
    K.append_transactions(again, tx_path)
    process_batch(second, 1, org_id="7", tx_path=tx_path, mart_path=mart_path,
                  loaded_at=LOADED_AT + dt.timedelta(hours=2))
    stored = K.read_transactions(spark, tx_path)
    assert stored.count() == stored.select("org_id", "transaction_id").distinct().count()
    expected = M.fct_monthly_revenue(S.stg_transactions(stored))
    mart = spark.read.parquet(mart_path).select(*expected.columns)
    assert sorted(map(tuple, mart.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_csv_dialect_round_trip(spark, scratch):
    """Doubled quotes, commas and line breaks in fields survive writing and reading."""
    names = ['Joe "Big" Diner, Ltd', "two\nlines", 'say ""', "plain", " padded "]
    rows = [(f"T{i}", "c", "ON", "18-25", "savings", n, "x", "1.00", "CAD", "completed", "2025-01-01", "2025-01", "2025")
            for i, n in enumerate(names)]
    path = os.path.join(scratch, "dialect.csv")
    K.write_transactions_csv(spark.createDataFrame(rows, CSV_COLUMNS), path)
    back = K.read_transactions_csv(spark, path)
    assert sorted(map(tuple, back.select(*CSV_COLUMNS).collect())) == sorted(rows)


def _csv_file(path, header, *lines):
    with open(path, "w") as f:
        f.write("\n".join([",".join(header), *lines]) + "\n")
    return path


def test_csv_header_and_field_count(spark, scratch):
    good = 'T1,c,ON,18-25,savings,"Joe ""Big"" Diner, Ltd",x,1.00,CAD,completed,2025-01-01,2025-01,2025'
    swapped = CSV_COLUMNS[:2] + [CSV_COLUMNS[3], CSV_COLUMNS[2]] + CSV_COLUMNS[4:]
    row = K.read_transactions_csv(spark, _csv_file(os.path.join(scratch, "a.csv"), swapped, good)).first()
    assert (row.province, row.age_group, row.merchant) == ("18-25", "ON", 'Joe "Big" Diner, Ltd')
    with pytest.raises(Exception):
        K.read_transactions_csv(spark, _csv_file(os.path.join(scratch, "b.csv"), CSV_COLUMNS, good + ",more")).collect()
    with pytest.raises(ValueError, match="txn_year"):
        K.read_transactions_csv(spark, _csv_file(os.path.join(scratch, "c.csv"), CSV_COLUMNS[:-1], good))


def test_constraints_stop_a_load_and_the_whole_error_is_logged(spark, sf_dir, scratch):
    csv, raw_path, runs = (os.path.join(scratch, x) for x in ("in.csv", "raw", "runs"))
    _write_csv(spark, sf_dir, csv)
    said = {}
    n = K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT, report=said.__setitem__)
    assert said["cleaning"]["rows_out"] == n and said["extract"]["rows"] == said["cleaning"]["rows_in"]
    assert said["nulls"]["amount"] > 0 and said["completed_revenue"] > 0
    before = K.current_version(spark, raw_path)
    for column, value, message in [("merchant", "x" * 101, "too long"), ("province", "", "not-null"), ("txn_date", "z" * 5000, "z" * 5000)]:
        bad = os.path.join(scratch, f"bad_{column}.csv")
        K.write_transactions_csv(_fitting(FX.raw_dirty(spark, sf_dir)).withColumn(column, F.lit(value)), bad)
        with pytest.raises(Exception):
            K.ingest(spark, bad, raw_path, runs, loaded_at=LOADED_AT)
        assert K.current_version(spark, raw_path) == before
        last = spark.read.parquet(runs).orderBy(F.desc("run_at")).first()
        assert last.status == "failed" and message in last.notes


def test_store_insights_leaves_out_what_is_not_stored(spark, scratch):
    df = spark.createDataFrame([("o", "summary", '{"title": "t", "content": "c"}'), ("o", "summary", "[1]"), ("o", "summary", None)],
                               "org_id string, type string, response string")
    path = os.path.join(scratch, "insights")
    IN.store_insights(IN.split_insights(df), path, created_at=LOADED_AT)
    assert [(r.title, r.content) for r in spark.read.parquet(path).collect()] == [("t", "c")]


def test_insight_json_rule(spark):
    texts = ['{"confidence": "high"}', '{"title": 5}', '{"title": "t"} words', '{"Title": "A", "CONFIDENCE": 0.5}', "null",
             '[{"title": "t"}]', '{"title": "a"}, {"title": "b"}', "{'title': 'x'}", '{"title": null}', '{"content": {"x": 1}}',
             '{"title": "a"}],[{"b": 2}', '{"title": "a"}, "y": {"b": 2}', ' {"title": "pad"} ', ""]
    rows = IN.split_insights(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert [(r.valid_json, r.title) for r in rows] == [
        (False, None), (False, None), (False, None), (True, "A"), (True, ""), (False, None), (False, None), (False, None),
        (True, ""), (False, None), (False, None), (False, None), (True, "pad"), (False, None)]
    assert rows[3].confidence == Decimal("0.5000")


def test_tenant_run_log(spark, scratch):
    path = os.path.join(scratch, "tenant_runs")
    one = K.log_tenant_run(spark, path, "7", "running", at=LOADED_AT)
    two = K.log_tenant_run(spark, path, "8", "running", at=LOADED_AT)
    later = LOADED_AT + dt.timedelta(minutes=5)
    K.log_tenant_run(spark, path, "7", "failed", one, rows_loaded=0, rows_failed=3, error="e" * 9000, at=later)
    rows = {r.id: r for r in K.tenant_runs(spark, path).collect()}
    assert (rows[one].status, rows[one].rows_failed, len(rows[one].error)) == ("failed", 3, 9000)
    assert (rows[one].started_at, rows[one].finished_at) == (LOADED_AT, later)
    assert (rows[two].status, rows[two].finished_at) == ("running", None)


def test_contracts_stop_a_load(spark, sf_dir, scratch):
    csv, raw_path, runs = (os.path.join(scratch, x) for x in ("in.csv", "raw", "runs"))
    _write_csv(spark, sf_dir, csv)
    keys = [Q.ColumnTest("raw", "transaction_id", "unique"), Q.ColumnTest("raw", "transaction_id", "not_null")]
    assert K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT, contracts=keys) > 0
    before = K.current_version(spark, raw_path)
    with pytest.raises(Q.QualityError):
        K.ingest(spark, csv, raw_path, runs, loaded_at=LOADED_AT, contracts=[Q.ColumnTest("raw", "category", "accepted_values", ("none",))])
    assert K.current_version(spark, raw_path) == before
