"""Edge frames for the semantics that are easy to get wrong."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.money import exact_avg, money_sum, share_pct_sql
from ledgerlens.functions.dates import parse_date_lenient
from ledgerlens.functions.text import slugify, strip_unicode
from ledgerlens.operators import clean as C
from ledgerlens.operators import marts as M
from ledgerlens.operators import staging as S
from ledgerlens.operators import tenancy as TN
from ledgerlens.schemas import CSV_COLUMNS, TRANSACTIONS


def _raw_rows(spark, rows):
    """Raw CSV-shaped rows: dict per row, missing columns get valid defaults."""
    base = {"transaction_id": "T0", "customer_id": "c", "province": "BC", "age_group": "18-25",
            "account_type": "savings", "merchant": "m", "category": "groceries", "amount": "10.00",
            "currency": "CAD", "status": "completed", "txn_date": "2025-01-05", "txn_month": "2025-01",
            "txn_year": "2025"}
    data = []
    for i, r in enumerate(rows):
        full = dict(base, **r)
        data.append((i, *[full[c] for c in CSV_COLUMNS]))
    schema = T.StructType([T.StructField("seq", T.LongType())] +
                          [T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    return spark.createDataFrame(data, schema)


def test_average_rounds_once(spark):
    """G1: sum 15000.01 over 3,000,003 rows: exact mean 0.0049999.. → 0.00."""
    df = spark.range(3_000_003).select(
        F.when(F.col("id") < 1_500_001, F.lit(Decimal("0.01"))).otherwise(F.lit(Decimal("0.00")))
        .cast("decimal(15,2)").alias("amount"))
    row = df.agg(exact_avg().alias("exact"), F.round(F.avg("amount"), 2).alias("spark_avg"),
                 money_sum().alias("total")).first()
    assert row.total == Decimal("15000.01")
    assert row.exact == Decimal("0.00")
    assert row.spark_avg == Decimal("0.01")   # the double rounding the helper avoids


def test_average_half_away_from_zero(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.02"),)], "amount decimal(15,2)")
    assert df.agg(exact_avg().alias("a")).first().a == Decimal("0.02")   # 0.015 → 0.02
    neg = spark.createDataFrame([(Decimal("-0.01"),), (Decimal("-0.02"),)], "amount decimal(15,2)")
    assert neg.agg(exact_avg().alias("a")).first().a == Decimal("-0.02")


def test_share_rounding(spark):
    df = spark.createDataFrame([(1, 8)], "n long, total long")
    assert df.select(F.expr(share_pct_sql("n", "total")).alias("p")).first().p == Decimal("12.50")
    df = spark.createDataFrame([(1, 3)], "n long, total long")
    assert df.select(F.expr(share_pct_sql("n", "total")).alias("p")).first().p == Decimal("33.33")


def test_percentages_sum_to_100(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    mart = M.fct_status_summary(S.stg_transactions(FX.tx(spark, sf_dir)))
    total = sum(r.pct_of_total for r in mart.collect())
    assert abs(total - Decimal("100")) <= Decimal("0.02")


def test_mart_totals_agree(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    stg = S.stg_transactions(FX.tx(spark, sf_dir))
    completed = M.completed_revenue(stg).first().completed_revenue
    for mart in (M.fct_revenue_by_category(stg), M.fct_revenue_by_province(stg), M.fct_monthly_revenue(stg)):
        assert sum(r.total_revenue for r in mart.collect()) == completed
    kpi = M.kpis(stg).first()
    assert kpi.total_revenue == completed
    assert kpi.active_provinces == M.fct_revenue_by_province(stg).count()


def test_dedupe_precedes_validation(spark):
    """G4: first copy invalid → the valid second copy is lost as well."""
    raw = _raw_rows(spark, [
        {"transaction_id": "A", "amount": "-5.00"},
        {"transaction_id": "A", "amount": "1.00"},
        {"transaction_id": "B", "amount": "3.00"},
        {"transaction_id": "B", "amount": "-1.00"},
    ])
    out = {r.transaction_id: r.amount for r in C.clean_transactions(raw).collect()}
    assert out == {"B": Decimal("3.00")}
    report = C.cleaning_report(raw).first()
    assert (report.rows_in, report.duplicates_removed, report.invalid_amounts_removed, report.rows_out) == \
        (4, 2, 1, 1)


def test_null_keys_dedupe_as_equal(spark):
    raw = _raw_rows(spark, [{"transaction_id": None, "amount": "1.00"},
                            {"transaction_id": None, "amount": "2.00"}])
    out = C.clean_transactions(raw).collect()
    assert [r.amount for r in out] == [Decimal("1.00")]


def test_status_filter_precedes_trim(spark):
    """G5: ' completed ' is dropped, not normalised; the flag changes that."""
    raw = _raw_rows(spark, [{"transaction_id": "A", "status": " completed "},
                            {"transaction_id": "B", "status": "REFUNDED"},
                            {"transaction_id": "C", "status": "pending", "category": "  travel\t"}])
    out = C.clean_transactions(raw).collect()
    assert [(r.transaction_id, r.status, r.category) for r in out] == [("C", "pending", "travel")]
    normalized = C.clean_transactions(raw, normalize_first=True).collect()
    assert sorted(r.transaction_id for r in normalized) == ["A", "C"]


def test_amount_parsing(spark):
    """G7 / G10: lenient parse; infinities, NaN and non-numbers are dropped;
    0.004 passes the test and is stored as 0.00."""
    raw = _raw_rows(spark, [
        {"transaction_id": "inf", "amount": "inf"},
        {"transaction_id": "nan", "amount": "NaN"},
        {"transaction_id": "exp", "amount": "1e3"},
        {"transaction_id": "pad", "amount": " 12.5 "},
        {"transaction_id": "empty", "amount": ""},
        {"transaction_id": "na", "amount": None},
        {"transaction_id": "tiny", "amount": "0.004"},
        {"transaction_id": "text", "amount": "abc"},
    ])
    out = {r.transaction_id: r.amount for r in C.clean_transactions(raw).collect()}
    assert out == {"exp": Decimal("1000.00"), "pad": Decimal("12.50"), "tiny": Decimal("0.00")}


def test_strict_cast_raises_after_dedupe(spark):
    """G6: a bad date fails the run even when its row would be filtered out."""
    raw = _raw_rows(spark, [{"transaction_id": "A", "amount": "-1.00", "txn_date": "2025-13-45"},
                            {"transaction_id": "B"}])
    with pytest.raises(Exception, match="strict cast failed"):
        C.clean_transactions(raw).collect()
    with pytest.raises(C.CleaningError):
        C.check_strict(raw)


def test_strict_cast_ignores_dropped_duplicates(spark):
    raw = _raw_rows(spark, [{"transaction_id": "A"},
                            {"transaction_id": "A", "txn_date": "not a date", "txn_year": "x"}])
    assert C.clean_transactions(raw).count() == 1
    assert C.check_strict(raw) == 0


def test_null_year_fails(spark):
    raw = _raw_rows(spark, [{"transaction_id": "A", "txn_year": None}])
    with pytest.raises(Exception, match="strict cast failed"):
        C.clean_transactions(raw).collect()


def test_unicode_strip(spark):
    """G16: tabs and no-break spaces are stripped, inner spaces kept."""
    df = spark.createDataFrame([("\tBritish Columbia  ",), (" ON　",)], "p string")
    assert [r.s for r in df.select(strip_unicode("p").alias("s")).collect()] == \
        ["British Columbia", "ON"]


def test_slugify(spark):
    df = spark.createDataFrame([("Acme Corp-West  2",), ("Café Ünïcode!",), ("Kelvin",)], "n string")
    assert [r.s for r in df.select(slugify("n").alias("s")).collect()] == \
        ["acme-corp-west--2", "caf-ncode", "elvin"]


def test_null_month_uses_a_top12_slot(spark, sf_dir):
    """G3: null month sorts first, takes a slot, then is dropped."""
    rows = [("o", "completed", None, Decimal("1.00"))] + \
        [("o", "completed", f"2025-{m:02d}", Decimal("2.00")) for m in range(1, 13)]
    tx = spark.createDataFrame(rows, "org_id string, status string, txn_month string, amount decimal(15,2)")
    single = [r.month for r in TN.org_monthly(tx, "o").collect()]
    batched = [r.month for r in TN.org_monthly_all(tx).orderBy(F.col("month").desc()).collect()]
    assert len(single) == 11 and single[0] == "2025-12" and single[-1] == "2025-02"
    assert batched == single


def test_tenant_filter_requires_org(spark):
    df = spark.createDataFrame([("1",)], "org_id string")
    with pytest.raises(ValueError):
        S.for_tenant(df, None)
    with pytest.raises(ValueError):
        S.for_tenant(df, "")


def test_defaults_fill_only_omitted_columns(spark):
    df = spark.createDataFrame([("a", None)], "id string, currency string")
    out = TN.apply_defaults(df, {"currency": "CAD", "plan": "free"}).first()
    assert out.currency is None and out.plan == "free"
    with pytest.raises(Exception, match="not-null"):
        TN.apply_defaults(df, {"currency": "CAD"}, required=["currency"]).collect()


def test_incremental_equals_full(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    stg = S.stg_transactions(FX.tx(spark, sf_dir))
    for since in ["1996-06-01 00:00:00", "2001-01-01 00:00:00"]:
        old = M.fct_monthly_revenue(stg.where(F.col("_loaded_at") <= F.lit(since).cast("timestamp_ntz")))
        inc = sorted(map(tuple, M.refresh_months(stg, old, since).collect()), key=str)
        full = sorted(map(tuple, M.fct_monthly_revenue(stg).collect()), key=str)
        assert inc == full


def test_one_pass_marts_equal_individual(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    stg = S.stg_transactions(FX.tx(spark, sf_dir))
    parts = M.split_marts(M.marts_one_pass(stg))
    for name, df in parts.items():
        ref = getattr(M, name)(stg)
        assert df.columns == ref.columns
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_stacked_marts_equal_split(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    combined = M.marts_one_pass(S.stg_transactions(FX.tx(spark, sf_dir)))
    stacked = M.stack_marts(combined)
    for name, df in M.split_marts(combined).items():
        keep = [c for c in df.columns if c in stacked.columns]
        mine = stacked.where(F.col("model") == name).select(*keep)
        assert sorted(map(tuple, mine.collect()), key=str) == \
            sorted(map(tuple, df.select(*keep).collect()), key=str)


def test_stacked_tests_equal_per_model(spark):
    from ledgerlens.operators import quality as Q
    a = spark.createDataFrame([("x", "completed"), ("x", "REFUNDED"), (None, None), ("y", "REFUNDED")],
                              "k string, status string")
    b = spark.createDataFrame([("2025-01", 1), ("2025-01", 2), ("2025-02", 3)], "k string, n int")
    empty = spark.createDataFrame([], "k string, status string")
    tests = [Q.ColumnTest("a", "k", "not_null"), Q.ColumnTest("a", "k", "unique"),
             Q.ColumnTest("a", "status", "accepted_values", ("completed", "pending", "failed")),
             Q.ColumnTest("b", "k", "unique"), Q.ColumnTest("b", "k", "not_null"),
             Q.ColumnTest("e", "k", "unique"), Q.ColumnTest("e", "k", "not_null")]
    stacked = (a.withColumn("model", F.lit("a"))
               .unionByName(b.withColumn("model", F.lit("b")), allowMissingColumns=True)
               .unionByName(empty.withColumn("model", F.lit("e")), allowMissingColumns=True))
    got = {(r.model, r.column_name, r.test): (r.failures, r.passed)
           for r in Q.run_tests_stacked(stacked, tests).collect()}
    ref = {(r.model, r.column_name, r.test): (r.failures, r.passed)
           for r in Q.run_tests({"a": a, "b": b, "e": empty}, tests).collect()}
    assert got == ref
    assert got[("b", "k", "unique")] == (1, False) and got[("e", "k", "not_null")] == (0, True)


def test_org_summaries_one_pass_equal_separate(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    tx = FX.tx(spark, sf_dir)
    both = TN.org_summaries_all(tx)
    months = both.where("is_month").select("org_id", "month", "revenue", "volume", "month_rank")
    ref_m = TN.org_monthly_all(tx).select("org_id", "month", "revenue", "volume", "month_rank")
    cats = both.where("NOT is_month").select("org_id", "category", "revenue", "volume", "category_rank")
    ref_c = TN.org_categories_all(tx).select("org_id", "category", "revenue", "volume", "category_rank")
    for mine, ref in [(months, ref_m), (cats, ref_c)]:
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_promote_small_batch_gives_the_same_rows(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    # Half the keys are stored already, so both new and repeated keys occur.
    stored = FX.tx(spark, sf_dir).withColumn("org_id", F.lit("7")).where(F.col("id").cast("long") % 2 == 0)
    batch = (C.clean_transactions(FX.raw_dirty(spark, sf_dir))
             .withColumn("ingested_at", F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")))
    plain = TN.promote(batch, "7", stored)
    small = TN.promote(batch, "7", stored, batch_is_small=True)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert small.count() > 0


def test_promote_keeps_the_first_of_a_batch_and_refuses_null_keys(spark):
    raw = _raw_rows(spark, [{"transaction_id": "A", "amount": "1.00"}, {"transaction_id": "B"}])
    batch = C.clean_transactions(raw).withColumn("ingested_at", F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"))
    again = batch.withColumn("seq", F.col("seq") + 100).withColumn("amount", F.lit(9).cast("decimal(12,2)"))
    none = spark.createDataFrame([], TRANSACTIONS)
    out = {r.transaction_id: r.amount for r in TN.promote(again.unionByName(batch), "7", none).collect()}
    assert len(out) == 2 and out["A"] == Decimal("1.00")
    with pytest.raises(Exception, match="not-null"):
        TN.promote(batch.withColumn("transaction_id", F.lit(None).cast("string")), "7", none).collect()


def test_insert_if_absent_resolves_conflicts_within_the_batch(spark):
    target = spark.createDataFrame([("1", "a")], "id string, slug string")
    new = spark.createDataFrame([("3", "b"), ("2", "b"), ("1", "c"), ("4", "a"), ("5", None), ("6", None)], "id string, slug string")
    out = TN.insert_if_absent(target, new, [["id"], ["slug"]], order=["id"])
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "a"), ("2", "b"), ("5", None), ("6", None)]


def test_number_and_date_grammar(spark):
    texts = ["10d", "10f", "0x1p3", "1e3", " 12.5 ", ".5", "5.", "+1", "-1", "1e", "", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(C.cast_amount("t").alias("n")).collect()] == \
        [None, None, None, 1000.0, 12.5, 0.5, 5.0, 1.0, -1.0, None, None, None]
    dates = spark.createDataFrame([(t,) for t in ["2025", "2025-1", "2025-01-05 garbage", "2025-01-05Tjunk", " 2025-01-05 ", "2025-02-30"]], "t string")
    assert [str(r.d) for r in dates.select(parse_date_lenient("t").alias("d")).collect()] == \
        ["None", "None", "None", "None", "2025-01-05", "None"]


def test_null_date_fails_only_in_a_kept_row(spark):
    dropped = _raw_rows(spark, [{"transaction_id": "A", "amount": "-1", "txn_date": None}, {"transaction_id": "B"}])
    assert [r.transaction_id for r in C.clean_transactions(dropped).collect()] == ["B"]
    assert C.check_strict(dropped) == 0
    kept = _raw_rows(spark, [{"transaction_id": "A", "txn_date": None}])
    with pytest.raises(Exception, match="strict cast failed"):
        C.clean_transactions(kept).collect()


def test_results_come_in_their_stated_order(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    stg = S.stg_transactions(FX.tx(spark, sf_dir))
    months = [r.txn_month for r in M.fct_monthly_revenue(stg).collect()]
    assert months == sorted(months, key=lambda m: (m is None, m)) and months[-1] is None
    for mart in (M.fct_revenue_by_category(stg), M.fct_revenue_by_province(stg)):
        revenue = [r.total_revenue for r in mart.collect()]
        assert revenue == sorted(revenue, reverse=True)


def test_one_pass_without_distinct_counts_keeps_measures(spark, sf_dir):
    from ledgerlens.sources import fixtures as FX
    stg = S.stg_transactions(FX.tx(spark, sf_dir))
    cols = M.MART_KEYS + ["_gid", "n_all", "amt_all", "n_c", "amt_c", "min_c", "max_c"]
    full = M.marts_one_pass(stg).select(*cols)
    lean = M.marts_one_pass(stg, distinct_counts=False)
    assert sorted(map(tuple, lean.select(*cols).collect()), key=str) == \
        sorted(map(tuple, full.collect()), key=str)


def test_stacked_tests_with_no_tests_is_an_empty_report(spark):
    from ledgerlens.operators import quality as Q
    stacked = spark.createDataFrame([("a", "x")], "model string, k string")
    out = Q.run_tests_stacked(stacked, [])
    assert out.columns == ["model", "column_name", "test", "failures", "severity", "passed"]
    assert out.count() == 0
