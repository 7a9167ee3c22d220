"""Property and skew tests."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.money import exact_avg, share_pct_sql
from ledgerlens.operators import clean as C
from ledgerlens.operators import insights as IN
from ledgerlens.operators import tenancy as TN

cents = st.integers(min_value=-10**12, max_value=10**12)


@settings(max_examples=25, deadline=None)
@given(st.lists(cents, min_size=1, max_size=40))
def test_exact_avg_matches_decimal(spark, values):
    amounts = [Decimal(v).scaleb(-2) for v in values]
    df = spark.createDataFrame([(a,) for a in amounts], "amount decimal(15,2)")
    got = df.agg(exact_avg().alias("a"), exact_avg(scale=6).alias("a6")).first()
    mean = sum(amounts) / Decimal(len(amounts))   # exact enough at 28 digits for these sizes
    assert got.a == mean.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    assert got.a6 == mean.quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)


@settings(max_examples=25, deadline=None)
@given(st.integers(min_value=0, max_value=10**9), st.integers(min_value=1, max_value=10**9))
def test_share_matches_decimal(spark, part, extra):
    total = part + extra
    df = spark.createDataFrame([(part, total)], "n long, t long")
    got = df.select(F.expr(share_pct_sql("n", "t")).alias("p")).first().p
    want = (Decimal(100) * part / Decimal(total)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    assert got == want


def test_hot_key_dedupe_is_whole(spark):
    """A key holding a third of all rows: the first copy survives, nothing else is lost."""
    n = 300_000
    df = spark.range(0, n, 1, 12).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), F.col("id").cast("string")))
        .alias("transaction_id"),
        (F.col("id") % 7).cast("string").alias("payload"))
    out = C.dedupe_first(df, "transaction_id", "seq")
    assert out.count() == 1 + (n - n // 3)
    assert out.where("transaction_id = 'HOT'").first().seq == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan      # limited before the shuffle


def test_hot_org_top_k_and_latest(spark):
    """One org owning most rows still yields whole per-org answers."""
    rows = spark.range(0, 120_000, 1, 8).select(
        F.when(F.col("id") % 3 != 0, F.lit("big")).otherwise((F.col("id") % 50).cast("string")).alias("org_id"),
        F.lit("completed").alias("status"),
        F.format_string("20%02d-%02d", (F.col("id") % 20).cast("int"), (F.col("id") % 12 + 1).cast("int"))
        .alias("txn_month"),
        F.lit(Decimal("1.00")).cast("decimal(15,2)").alias("amount"))
    top = TN.org_monthly_all(rows)
    counts = {r.org_id: r.c for r in top.groupBy("org_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert counts["big"] == 12 and len(counts) == 51
    insights = rows.select(F.col("org_id"), F.lit("summary").alias("type"), F.lit("t").alias("title"),
                           F.lit("c").alias("content"), F.lit(None).cast("decimal(5,4)").alias("confidence"),
                           F.col("txn_month").alias("id"),
                           F.to_timestamp(F.concat(F.col("txn_month"), F.lit("-01"))).cast("timestamp_ntz")
                           .alias("created_at"))
    latest = IN.latest_insights_all(insights)
    per_org = {r.org_id: (r.c, r.t) for r in latest.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("c"), F.max("total").alias("t")).collect()}
    assert per_org["big"] == (20, 20)


def test_sizing_conf_bounds():
    from ledgerlens.session import sizing_conf
    big = sizing_conf(100 * 10**12, 8000)
    assert 30_000 < int(big["spark.sql.shuffle.partitions"]) < 50_000       # a tenth of 100 TB in 256 MiB parts
    bigger = sizing_conf(1000 * 10**12, 8000)
    assert int(bigger["spark.sql.shuffle.partitions"]) > 9 * int(big["spark.sql.shuffle.partitions"])   # no cap
    assert sizing_conf(10 * 2**30, 100)["spark.sql.shuffle.partitions"] == "300"   # 3 per core floor
    assert big["spark.sql.files.maxPartitionBytes"] == "1024m"


keys = st.one_of(st.none(), st.sampled_from(["x", "y", "z", "w"]))
statuses = st.one_of(st.none(), st.sampled_from(["completed", "pending", "failed", "REFUNDED", " completed "]))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(keys, statuses), max_size=12), st.lists(st.tuples(keys, statuses), max_size=12))
def test_stacked_tests_match_brute_force(spark, rows_a, rows_b):
    """Column tests over models stacked in one frame equal a direct count per model."""
    from collections import Counter

    from ledgerlens.operators import quality as Q
    accepted = ("completed", "pending", "failed")
    tests = [Q.ColumnTest(m, c, t, accepted if t == "accepted_values" else ())
             for m in ("a", "b") for c, t in [("k", "not_null"), ("k", "unique"), ("status", "unique"),
                                              ("status", "accepted_values")]]
    data = [("a", k, s) for k, s in rows_a] + [("b", k, s) for k, s in rows_b]
    stacked = spark.createDataFrame(data, "model string, k string, status string")
    got = {(r.model, r.column_name, r.test): r.failures for r in Q.run_tests_stacked(stacked, tests).collect()}

    def brute(rows, col, test):
        vals = [r[col] for r in rows]
        seen = Counter(v for v in vals if v is not None)
        if test == "not_null":
            return sum(v is None for v in vals)
        if test == "unique":
            return sum(1 for n in seen.values() if n > 1)
        return sum(1 for v in seen if v not in accepted)

    for (m, rows) in [("a", rows_a), ("b", rows_b)]:
        for c, col in [("k", 0), ("status", 1)]:
            for t in ("not_null", "unique", "accepted_values"):
                if (m, c, t) in got:
                    assert got[(m, c, t)] == brute(rows, col, t), (m, c, t)


mart_rows = st.lists(st.tuples(
    st.one_of(st.none(), st.sampled_from(["food", "travel"])),            # category
    st.one_of(st.none(), st.sampled_from(["BC", "ON"])),                  # province
    st.one_of(st.none(), st.sampled_from(["2025-01", "2025-02"])),        # txn_month
    st.one_of(st.none(), st.sampled_from([2025, 2026])),                  # txn_year
    st.sampled_from(["completed", "pending", "failed"]),                  # status
    st.one_of(st.none(), st.sampled_from(["c1", "c2", "c3"])),            # customer_ref
    st.integers(min_value=1, max_value=10**6)), max_size=25)              # amount in cents


@settings(max_examples=10, deadline=None)
@given(mart_rows)
def test_one_pass_marts_match_per_mart_functions(spark, rows):
    """Helper-set distinct counts equal count(DISTINCT), with nulls in every key."""
    from ledgerlens.operators import marts as M
    data = [(c, p, m, y, s, cu, Decimal(a).scaleb(-2)) for c, p, m, y, s, cu, a in rows]
    stg = spark.createDataFrame(data, "category string, province string, txn_month string, txn_year int, "
                                      "status string, customer_ref string, amount decimal(15,2)")
    for name, df in M.split_marts(M.marts_one_pass(stg)).items():
        ref = getattr(M, name)(stg)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, ref.collect()), key=str), name


def test_configure_applies_sizing_only_when_asked(spark):
    from ledgerlens.session import configure, sizing_conf
    keys = list(sizing_conf(1, 1))
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        configure(spark)
        assert {k: spark.conf.get(k, None) for k in keys} == before
        configure(spark, input_bytes=1000 * 2**30, total_cores=100)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "400"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1024m"
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_org_purge_and_hot_month_refresh_are_whole(spark):
    """One org and one month hold a third of all rows: the purge drops exactly
    that org's rows, and the incremental refresh equals a full rebuild."""
    from ledgerlens.operators import marts as M
    n = 300_000
    tx = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 97 AS string) END AS org_id",
        "CASE WHEN id % 3 = 0 THEN '2025-01' ELSE concat('2025-', lpad(cast(id % 12 + 1 AS string), 2, '0')) "
        "END AS txn_month",
        "2025 AS txn_year", "concat('c', cast(id % 1000 AS string)) AS customer_ref",
        "concat('k', cast(id % 7 AS string)) AS category", "'completed' AS status",
        "cast((id % 500 + 1) / 100 AS decimal(15,2)) AS amount",
        "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 1000) AS _loaded_at")
    gone = spark.createDataFrame([("hot",), ("5",)], "id string")
    kept = TN.purge_orgs(tx, gone)
    assert kept.count() == tx.where("org_id NOT IN ('hot', '5')").count()
    since = "2025-01-01 00:08:00"
    old = M.fct_monthly_revenue(tx.where(F.col("_loaded_at") <= F.lit(since).cast("timestamp_ntz")))
    inc = sorted(map(tuple, M.refresh_months(tx, old, since).collect()), key=str)
    full = sorted(map(tuple, M.fct_monthly_revenue(tx).collect()), key=str)
    assert inc == full
