"""Declarative data-quality tests (QLT-1..7).

Test semantics follow the usual column-test conventions:

* ``not_null`` — failures are the null rows;
* ``unique`` — failures are the non-null values seen more than once;
* ``accepted_values`` — failures are the distinct non-null values outside
  the list (null passes);
* ``relationships`` — failures are the rows whose non-null value is no key of the
  parent model;
* rules — a row count equal to an expectation, a revenue above a floor.

``run_tests`` fuses all ``not_null`` and ``accepted_values`` tests of a table,
and any aggregate rules on it (:class:`AggRule`), into one aggregation pass;
each ``unique`` test is one grouped count (a map-side-combined shuffle on the
tested column), and all ``relationships`` tests of a table are one pass over it and
one grouped count.  The report is a DataFrame; :func:`enforce` is the action that
raises when an error-severity test fails.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import VALID_STATUSES

REPORT_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("test", T.StringType(), False),
    T.StructField("failures", T.LongType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("passed", T.BooleanType(), False),
])


@dataclass(frozen=True)
class ColumnTest:
    model: str
    column: str
    test: str                      # not_null | unique | accepted_values | relationships
    values: tuple = field(default=())
    severity: str = "error"
    to: str | None = None          # relationships: the parent model and its key
    to_column: str = "id"


# The column tests declared for the marts and the source table.
MART_TESTS = [
    ColumnTest("fct_revenue_by_category", "category", "unique"),
    ColumnTest("fct_revenue_by_category", "category", "not_null"),
    ColumnTest("fct_revenue_by_category", "total_revenue", "not_null"),
    ColumnTest("fct_revenue_by_province", "province", "unique"),
    ColumnTest("fct_revenue_by_province", "province", "not_null"),
    ColumnTest("fct_monthly_revenue", "txn_month", "unique"),
    ColumnTest("fct_monthly_revenue", "txn_month", "not_null"),
    ColumnTest("fct_status_summary", "status", "unique"),
    ColumnTest("fct_status_summary", "status", "not_null"),
    ColumnTest("fct_status_summary", "status", "accepted_values", tuple(VALID_STATUSES)),
]
SOURCE_TESTS = [
    ColumnTest("transactions", "id", "unique"),
    ColumnTest("transactions", "id", "not_null"),
    ColumnTest("transactions", "transaction_id", "not_null"),
    ColumnTest("transactions", "customer_ref", "not_null"),
    ColumnTest("transactions", "amount", "not_null"),
    ColumnTest("transactions", "status", "accepted_values", tuple(VALID_STATUSES)),
]
ALL_COLUMN_TESTS = MART_TESTS + SOURCE_TESTS


@dataclass(frozen=True)
class AggRule:
    """A table-level rule stated as one aggregate over a model.

    ``failures`` is SQL aggregate text that yields 0 when the rule holds.  It
    is evaluated inside the model's fused test pass, so a rule costs no scan of
    its own.  ``label`` is the model name shown in the report (defaults to
    ``model``), for rules computed from a model derived from the labelled one."""
    model: str
    name: str
    failures: str
    severity: str = "warn"
    label: str | None = None


def row_count_check(model: str, expected: int, severity: str = "warn") -> AggRule:
    """QLT-5 as a fusable rule: the row count must equal ``expected``."""
    return AggRule(model, "row_count", f"CASE WHEN count(1) = {int(expected)} THEN 0 ELSE 1 END", severity)


def revenue_floor_check(model: str, floor: int | Decimal, where: str = "status = 'completed'",
                        severity: str = "warn", label: str | None = None) -> AggRule:
    """QLT-6 as a fusable rule: ``sum(amount)`` over the rows of ``model`` that
    satisfy ``where`` must exceed ``floor``.  With ``where`` set to the staging
    predicate and the completed status, the rule checks the completed staging
    revenue inside a pass over the source table."""
    lit = f"CAST('{Decimal(str(floor))}' AS DECIMAL(38,2))"
    total = f"coalesce(sum(CASE WHEN {where} THEN amount END), 0)"
    return AggRule(model, "revenue_floor", f"CASE WHEN {total} > {lit} THEN 0 ELSE 1 END", severity, label)


def not_null(df: DataFrame, col: str) -> DataFrame:
    """QLT-1: the failing rows."""
    return df.where(F.col(col).isNull())


def not_null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """QLT-1 fused: null count of several columns in one pass, one row each."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "failures")


def unique(df: DataFrame, col: str) -> DataFrame:
    """QLT-2: non-null values seen more than once, with their counts."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_occurrences"))
            .where(F.col("n_occurrences") > 1))


def accepted_values(df: DataFrame, col: str, values) -> DataFrame:
    """QLT-3: distinct non-null values outside ``values``, with their counts."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).isin(*values)).groupBy(col)
            .agg(F.count(F.lit(1)).alias("n_occurrences")))


def row_count_rule(df: DataFrame, expected: int, severity: str = "warn") -> DataFrame:
    """QLT-5: the row count must equal ``expected``."""
    return (df.agg(F.count(F.lit(1)).alias("actual_rows"))
            .select("actual_rows", F.lit(expected).cast("bigint").alias("expected_rows"),
                    (F.col("actual_rows") == F.lit(expected)).alias("passed"),
                    F.lit(severity).alias("severity")))


def revenue_floor_rule(df: DataFrame, floor: int | Decimal, severity: str = "warn") -> DataFrame:
    """QLT-6: completed revenue must exceed ``floor``."""
    floor_lit = F.lit(Decimal(str(floor))).cast("decimal(38,2)")
    revenue = F.expr("cast(coalesce(sum(CASE WHEN status = 'completed' THEN amount END), 0) "
                     "as decimal(38,2))")
    return (df.agg(revenue.alias("completed_revenue"))
            .select("completed_revenue", floor_lit.alias("revenue_floor"),
                    (F.col("completed_revenue") > floor_lit).alias("passed"),
                    F.lit(severity).alias("severity")))


def _fused_counts(model: str, df: DataFrame, tests: list[ColumnTest],
                  rules: list[AggRule] = ()) -> DataFrame | None:
    """not_null and accepted_values tests and aggregate rules of one model,
    in one aggregation (one scan of the model)."""
    exprs, labels = [], []
    for i, t in enumerate(tests):
        if t.test == "not_null":
            exprs.append(F.count_if(F.col(t.column).isNull()).alias(f"t{i}"))
        elif t.test == "accepted_values":
            bad = F.when(~F.col(t.column).isin(*t.values), F.col(t.column))
            exprs.append(F.count_distinct(bad).alias(f"t{i}"))
        else:
            continue
        labels.append((f"t{i}", model, F.lit(t.column), t.test, t.severity))
    for j, r in enumerate(rules):
        exprs.append(F.expr(r.failures).alias(f"r{j}"))
        labels.append((f"r{j}", r.label or r.model, F.lit(None).cast("string"), r.name, r.severity))
    if not exprs:
        return None
    wide = df.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(label).alias("model"), column.alias("column_name"),
                              F.lit(test).alias("test"), F.col(name).cast("bigint").alias("failures"),
                              F.lit(severity).alias("severity"))
                     for name, label, column, test, severity in labels])
    return wide.select(F.inline(rows)).select("model", "column_name", "test", "failures", "severity")


def relationship_counts(model: str, df: DataFrame, tests: list[ColumnTest], models: dict[str, DataFrame]) -> DataFrame:
    """QLT-4: the ``relationships`` tests of one model as report rows.

    One scan of the child gives a (test, value) cell for every key, one scan of
    each parent the values that exist; one grouped count brings both together.
    Cells are counted before the shuffle, so a key that a third of all rows hold
    is one row a task, and only distinct values travel.  Values compare as text."""
    cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col(t.column).cast("string").alias("value")) for i, t in enumerate(tests)])
    rows = (df.select(F.inline(cells)).where("value IS NOT NULL")
            .select("t", "value", F.lit(1).cast("bigint").alias("n"), F.lit(0).alias("there")))
    for to, column in sorted({(t.to, t.to_column) for t in tests}):
        own = F.array(*[F.lit(i) for i, t in enumerate(tests) if (t.to, t.to_column) == (to, column)])
        rows = rows.unionAll(models[to].where(F.col(column).isNotNull())
                             .select(F.explode(own).alias("t"), F.col(column).cast("string").alias("value"),
                                     F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("there")))
    values = rows.groupBy("t", "value").agg(F.sum("n").alias("n"), F.max("there").alias("there"))
    wide = values.agg(*[F.coalesce(F.sum(F.when((F.col("t") == i) & (F.col("there") == 0), F.col("n"))), F.lit(0)).alias(f"t{i}")
                        for i in range(len(tests))])
    report = F.array(*[F.struct(F.lit(model).alias("model"), F.lit(t.column).alias("column_name"), F.lit("relationships").alias("test"),
                                F.col(f"t{i}").cast("bigint").alias("failures"), F.lit(t.severity).alias("severity"))
                       for i, t in enumerate(tests)])
    return wide.select(F.inline(report))


def run_tests(models: dict[str, DataFrame], tests: list[ColumnTest],
              rules: list[DataFrame | AggRule] | None = None) -> DataFrame:
    """QLT-7: one report row per (model, column, test) with failures,
    severity and pass flag.  ``rules`` are :class:`AggRule` objects, fused into
    their model's test pass, or extra one-row rule results shaped like the
    report (see :func:`rule_rows`)."""
    agg_rules = [r for r in rules or [] if isinstance(r, AggRule)]
    unknown = {r.model for r in agg_rules} - set(models)
    if unknown:
        raise ValueError(f"rules name models that are not given: {sorted(unknown)}")
    parts = []
    for model, df in models.items():
        mine = [t for t in tests if t.model == model]
        fused = _fused_counts(model, df, mine, [r for r in agg_rules if r.model == model])
        if fused is not None:
            parts.append(fused)
        refers = [t for t in mine if t.test == "relationships"]
        if refers:
            missing = {t.to for t in refers} - set(models)
            if missing:
                raise ValueError(f"relationships name models that are not given: {sorted(map(str, missing))}")
            parts.append(relationship_counts(model, df, refers, models))
        for t in mine:
            if t.test == "unique":
                failing = unique(df, t.column).agg(F.count(F.lit(1)).alias("failures"))
                parts.append(failing.select(F.lit(model).alias("model"), F.lit(t.column).alias("column_name"),
                                            F.lit("unique").alias("test"), "failures",
                                            F.lit(t.severity).alias("severity")))
    parts.extend(r for r in rules or [] if not isinstance(r, AggRule))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report.withColumn("passed", F.col("failures") == 0)


def run_tests_stacked(stacked: DataFrame, tests: list[ColumnTest], model_col: str = "model") -> DataFrame:
    """QLT-7 for several SMALL models held in one frame (a ``model`` column
    tags each row; columns a model lacks are null), e.g. the marts of one
    grouping-sets pass.

    Every tested cell becomes a (model, column, value) row, and one grouped
    count per distinct value feeds a single aggregation that yields all test
    results.  The stacked frame is read by one branch of the plan, so the
    pass that produced it runs once.  Values compare by their text form (one
    type per column, so equal text means equal values)."""
    if not tests:
        return empty_report(stacked.sparkSession)
    # The expressions are SQL text: one parse each instead of one driver call
    # per column object.
    pairs = sorted({(t.model, t.column) for t in tests})
    cells = ", ".join(
        f"CASE WHEN {_ident(model_col)} = {_str(m)} THEN named_struct('model', {_str(m)}, "
        f"'column_name', {_str(c)}, 'value', cast({_ident(c)} AS string)) END" for m, c in pairs)
    counts = (stacked.select(F.expr(f"explode(array({cells}))").alias("cell")).where("cell IS NOT NULL")
              .select("cell.*").groupBy("model", "column_name", "value")
              .agg(F.count(F.lit(1)).alias("n")))
    exprs = []
    for i, t in enumerate(tests):
        mine = f"model = {_str(t.model)} AND column_name = {_str(t.column)}"
        if t.test == "not_null":
            failures = f"sum(CASE WHEN {mine} AND value IS NULL THEN n END)"
        elif t.test == "unique":
            failures = f"count_if({mine} AND value IS NOT NULL AND n > 1)"
        elif t.test == "accepted_values":
            accepted = ", ".join(_str(str(v)) for v in t.values)
            failures = f"count_if({mine} AND value IS NOT NULL AND NOT value IN ({accepted}))"
        else:
            raise ValueError(f"unknown test {t.test!r}")
        exprs.append(F.expr(f"cast(coalesce({failures}, 0) AS bigint)").alias(f"t{i}"))
    rows = ", ".join(
        f"named_struct('model', {_str(t.model)}, 'column_name', {_str(t.column)}, 'test', {_str(t.test)}, "
        f"'failures', t{i}, 'severity', {_str(t.severity)})" for i, t in enumerate(tests))
    return (counts.agg(*exprs).select(F.expr(f"inline(array({rows}))"))
            .withColumn("passed", F.col("failures") == 0))


def _str(value: str) -> str:
    """SQL string literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ident(name: str) -> str:
    """SQL column reference."""
    return "`" + name.replace("`", "``") + "`"


def rule_rows(model: str, name: str, rule: DataFrame) -> DataFrame:
    """Shape a one-row rule result (with ``passed`` and ``severity``) as report rows."""
    return rule.select(F.lit(model).alias("model"), F.lit(None).cast("string").alias("column_name"),
                       F.lit(name).alias("test"),
                       F.when(F.col("passed"), 0).otherwise(1).cast("bigint").alias("failures"),
                       "severity")


class QualityError(RuntimeError):
    """An error-severity data test failed."""


def enforce(report: DataFrame, blocking: tuple[str, ...] = ("error",)) -> DataFrame:
    """Raise :class:`QualityError` when a blocking test failed; returns the
    report otherwise.  This is an action (it reads the failing rows only)."""
    failed = report.where(~F.col("passed") & F.col("severity").isin(*blocking))
    bad = failed.select("model", "column_name", "test", "failures").collect()
    if bad:
        raise QualityError("; ".join(f"{r.model}.{r.column_name} {r.test}: {r.failures}" for r in bad))
    return report


def empty_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REPORT_SCHEMA)
