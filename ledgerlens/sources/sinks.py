"""Sources and sinks with side effects (SRC-1, SRC-3..6, SRC-10, SRC-12).

Loads are atomic at the level of a table set: the new data is written to version
folders of its own and committed as one log entry after the write jobs succeeded
(:mod:`ledgerlens.sources.commits`), so a failing load leaves the previous tables
in place, loads that run at the same time do not harm each other, and readers
always find one complete version.  The row count comes from an ``Observation`` on
the write itself — no second pass over the data.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CSV_COLUMNS, INSERT_BATCH_ROWS, PIPELINE_RUNS, RAW_LENGTHS, RAW_TRANSACTIONS, TENANT_RUN_STATES, TRANSACTIONS
from ..session import checkpoint_dir
from . import commits
from .csv_splits import read_split_csv

# The text tokens that the source reader treats as missing
# (in addition to an empty field).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# ---------------------------------------------------------------------------
# CSV (SRC-1, SRC-5)
# ---------------------------------------------------------------------------

#: The file dialect, reading and writing: quotes inside a quoted field are
#: doubled and a quoted field may hold line breaks.  Rows with too many or too few fields and headers
#: that differ from the expected one fail the read.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST",
               "enforceSchema": False, "columnPruning": False,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_transactions_csv(spark: SparkSession, path: str, position_col: str = "seq", split: bool = True) -> DataFrame:
    """SRC-1: the 13-column transactions file(s), every column as text.

    Columns are matched by header name: the first file's header gives the
    order, every file must have the same one, and all 13 must be there.
    Missing-value tokens become null.  ``position_col`` is the file position
    (file path, 0, number of the record in its file): it orders rows exactly as
    they appear in the files and is what "keep the first copy" dedupes by.

    A file is read in many byte ranges although quoted fields may hold line
    breaks (:mod:`ledgerlens.sources.csv_splits`); one more pass over the lines
    finds the ranges' states.  ``split=False`` reads each file in one task; the
    number in the position then only orders the rows."""
    header = spark.read.options(**CSV_OPTIONS).csv(path).columns
    missing = [c for c in CSV_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    if split:
        raw = read_split_csv(spark, path, header, CSV_OPTIONS)
        file, row = F.col("file"), F.col("row")
    else:
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in header)).options(**CSV_OPTIONS).csv(path)
        file, row = F.col("_metadata.file_path"), F.monotonically_increasing_id()
    position = F.struct(file.alias("file"), F.lit(0).cast("long").alias("block"), row.alias("row"))
    cols = [F.when(F.col(c).isin(*NULL_TOKENS), F.lit(None)).otherwise(F.col(c)).alias(c)
            for c in CSV_COLUMNS]
    return raw.select(position.alias(position_col), *cols)


def extract_summary(df: DataFrame) -> dict:
    """Row count and column names of an extracted frame (one count job)."""
    return {"rows": df.count(), "columns": [c for c in df.columns if c in CSV_COLUMNS]}


def write_transactions_csv(df: DataFrame, path: str) -> None:
    """SRC-5: header plus the 13 columns in their fixed order; values are
    written verbatim (the CSV writer would otherwise trim surrounding blanks)."""
    (df.select(*[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS])
     .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# ---------------------------------------------------------------------------
# The tenant transactions table: partitioned by month
# ---------------------------------------------------------------------------

def append_transactions(rows: DataFrame, path: str) -> None:
    """Append tenant transactions, one folder per month (a null month has its own).
    The rebalance gathers a month's rows, so a month gets few files, and splits
    a month that holds a large share of the rows."""
    rows.hint("rebalance", "txn_month").write.mode("append").partitionBy("txn_month").parquet(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The tenant transactions table with its declared types and column order."""
    return spark.read.schema(TRANSACTIONS).parquet(path).select(*[f.name for f in TRANSACTIONS.fields])


# ---------------------------------------------------------------------------
# Versioned tables (see ledgerlens.sources.commits)
# ---------------------------------------------------------------------------

path_exists = commits.exists


def _located(spark: SparkSession, path: str) -> tuple[str, str]:
    """The table set and the table that ``path`` names: a set of one table, or a
    table below the folder of a set."""
    path = path.rstrip("/")
    top, _, name = path.rpartition("/")
    if top and not path_exists(spark, f"{path}/{commits.COMMITS}") and path_exists(spark, f"{top}/{commits.COMMITS}"):
        return top, name
    return path, ""


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a versioned table's current data; None before its first load."""
    top, table = _located(spark, path)
    folders = commits.snapshot(spark, top).tables.get(table)
    return f"{top}/{folders[-1]}" if folders else None


def read_versioned(spark: SparkSession, path: str, fmt: str = "parquet", number: int | None = None) -> DataFrame:
    """The current version of a table that :func:`load_raw` or :func:`build_all`
    loads, or the one as of commit ``number``."""
    top, table = _located(spark, path)
    return commits.read_snapshot(spark, top, commits.snapshot(spark, top, number), table, fmt)


def read_set(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """All tables of a set, as one load left them."""
    at = commits.snapshot(spark, path, number)
    return {table: commits.read_snapshot(spark, path, at, table) for table in at.tables}


# ---------------------------------------------------------------------------
# Loads (SRC-3, SRC-4, SRC-6)
# ---------------------------------------------------------------------------

def with_load_columns(df: DataFrame, loaded_at, order_col: str = "seq", dense: bool = True) -> DataFrame:
    """SRC-6: ``id`` restarting at 1 in file order, and the load stamp.

    Dense ids without a single-partition window: the rows are range-partitioned
    and sorted by ``order_col`` and checkpointed (so partitions and in-partition
    positions are fixed even if executors are lost), each partition is counted
    (one row per partition), and a row's id is the count of all earlier
    partitions plus its position in its own partition.  ``dense=False`` gives
    unique, increasing but gapped ids with no extra pass."""
    stamped = df.withColumn("ingested_at", F.lit(loaded_at).cast("timestamp_ntz"))
    if not dense:
        return stamped.withColumn("id", F.monotonically_increasing_id() + 1)
    checkpoint_dir(df.sparkSession)
    ordered = (stamped.repartitionByRange(order_col).sortWithinPartitions(order_col)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mono", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    sizes = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per partition: a proven bound, so the broadcast is safe.
    ids = ordered.join(F.broadcast(offsets), "_pid")
    first_in_part = F.col("_pid").cast("long") * F.lit(1 << 33)
    return (ids.withColumn("id", F.col("_offset") + (F.col("_mono") - first_in_part) + 1)
            .drop("_pid", "_mono", "_offset"))


def load_raw(df: DataFrame, path: str, fmt: str = "parquet", batch_rows: int = INSERT_BATCH_ROWS,
             jdbc_options: dict | None = None, conflict: str = "retry",
             grace_seconds: float = commits.GRACE_SECONDS) -> int:
    """SRC-3/4: truncate-and-load; returns the number of rows loaded.

    Files: the rows are written to a version folder of their own and committed
    (:mod:`ledgerlens.sources.commits`), so N runs leave the same table as one
    run, a failed run leaves the old table, and readers (:func:`read_versioned`)
    always find one complete version.  Loads that run at the same time take
    effect one after the other, in the order of their commits, or with
    ``conflict="fail"`` the later one raises.  Versions superseded longer than
    ``grace_seconds`` ago are removed.  JDBC: ``truncate`` + ``batchsize`` (pages
    of ``batch_rows``)."""
    spark = df.sparkSession
    obs = Observation(f"load_{uuid.uuid4().hex}")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if fmt == "jdbc":
        (observed.write.format("jdbc").options(**(jdbc_options or {}))
         .option("truncate", "true").option("batchsize", batch_rows).mode("overwrite").save())
    else:
        load = commits.Load(spark, path, {"": "replace"}, conflict)
        try:
            observed.write.format(fmt).save(load.folder())
        except BaseException:
            load.abandon()
            raise
        load.commit()
        commits.vacuum(spark, path, grace_seconds)
    return int(obs.get.get("rows", 0))


def enforce_contract(df: DataFrame, schema: T.StructType, lengths: dict[str, int]) -> DataFrame:
    """``df`` shaped as ``schema``; the job fails on a null in a NOT NULL column
    and on a text longer than its column."""
    def checked(f: T.StructField) -> Column:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"null value in column {f.name} violates not-null constraint"))
                       .cast(f.dataType)).otherwise(c)
        if f.name in lengths:
            c = F.when(F.char_length(f.name) > lengths[f.name], F.raise_error(
                F.lit(f"value too long for column {f.name} ({lengths[f.name]})"))).otherwise(c)
        return c.alias(f.name)

    return df.select(*[checked(f) for f in schema.fields])


def raw_table_rows(cleaned: DataFrame, loaded_at, order_col: str = "seq") -> DataFrame:
    """Cleaned rows shaped as the raw table (id, 13 columns, ingested_at), its
    constraints enforced (``transaction_id`` is unique after the dedupe)."""
    return enforce_contract(with_load_columns(cleaned, loaded_at, order_col), RAW_TRANSACTIONS, RAW_LENGTHS)


# ---------------------------------------------------------------------------
# Run log (SRC-10)
# ---------------------------------------------------------------------------

def log_run(spark: SparkSession, path: str, rows_loaded: int, status: str, notes: str = "",
            run_at: dt.datetime | None = None) -> None:
    """SRC-10: append one run record (``success`` or ``failed``; a failed run
    carries 0 rows and the error text)."""
    run_at = run_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = [(uuid.uuid4().hex, run_at, int(rows_loaded), status, notes or None)]
    spark.createDataFrame(row, PIPELINE_RUNS).write.mode("append").parquet(path)


def log_tenant_run(spark: SparkSession, path: str, org_id: str, status: str, run_id: str | None = None,
                   rows_loaded: int | None = None, rows_failed: int = 0, error: str | None = None,
                   at: dt.datetime | None = None) -> str:
    """SRC-10 for a tenant: append a state of a run (``running`` at its start,
    ``success`` or ``failed`` at its end) and return the run's id."""
    run_id, at = run_id or uuid.uuid4().hex, at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = [(run_id, str(org_id), status, rows_loaded, int(rows_failed), error, at)]
    spark.createDataFrame(row, TENANT_RUN_STATES).write.mode("append").parquet(path)
    return run_id


def tenant_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: its last state, its start and (once it ended) its finish."""
    states = spark.read.schema(TENANT_RUN_STATES).parquet(path)
    last = F.max_by(F.struct("status", "rows_loaded", "rows_failed", "error"), "at")
    return (states.groupBy("id", "org_id").agg(last.alias("s"), F.min("at").alias("started_at"),
                                              F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"))
            .select("id", "org_id", "s.*", "started_at", "finished_at"))


def ingest(spark: SparkSession, csv_path: str, raw_path: str, runs_path: str, loaded_at=None,
           report: Callable[[str, object], None] | None = None, contracts: Sequence = (),
           parents: dict[str, DataFrame] | None = None) -> int:
    """The ingest job: read → audit → clean → stamp ids → constraints → atomic
    load → run log.

    ``report(name, value)`` receives what the run has to say: the extract
    summary, the null audit, the cleaning report and the completed revenue of
    the loaded rows.  ``contracts`` are column tests on the model ``raw`` that
    the rows must pass before they are loaded (one more pass over them);
    ``parents`` are the models that ``relationships`` contracts refer to.  Any
    failure (a strict date or year cast, a constraint, a contract) leaves the previous raw table
    untouched and is still logged, with its whole text, as a failed run."""
    from ..operators.clean import clean_transactions, cleaning_report, null_audit
    from ..operators.marts import completed_revenue
    from ..operators.quality import enforce, run_tests

    loaded_at = loaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    say = report or (lambda name, value: None)
    try:
        extracted = read_transactions_csv(spark, csv_path)
        if report is not None:
            say("extract", extract_summary(extracted))
            say("nulls", {r.column_name: r.null_count for r in null_audit(extracted, CSV_COLUMNS).collect()})
            say("cleaning", cleaning_report(extracted).first().asDict())
        cleaned = clean_transactions(extracted)
        table = raw_table_rows(cleaned, loaded_at)
        if contracts:
            enforce(run_tests({**(parents or {}), "raw": table}, list(contracts)))
        rows = load_raw(table, raw_path)
        if report is not None:
            say("completed_revenue", completed_revenue(read_versioned(spark, raw_path)).first()[0])
    except Exception as e:
        log_run(spark, runs_path, 0, "failed", f"{type(e).__name__}: {e}")
        raise
    log_run(spark, runs_path, rows, "success")
    return rows


# ---------------------------------------------------------------------------
# Mart materialisation (SRC-12)
# ---------------------------------------------------------------------------

def build_all(spark: SparkSession, tx: DataFrame, target_dir: str, org_id: str | None = None,
              blocking: tuple[str, ...] = ("error",)) -> dict:
    """SRC-12: staging stays lazy; the four marts are computed in one scan
    (grouping sets), the small combined result is checkpointed to the shared
    checkpoint folder, the marts' column tests run on it (a failed test of
    a ``blocking`` severity stops the load), and one commit switches all four
    marts, so a reader finds four marts of one build.  Returns the row count of
    each mart."""
    from ..operators.marts import MART_SETS, marts_one_pass, split_marts, stack_marts
    from ..operators.quality import ALL_COLUMN_TESTS, enforce, run_tests_stacked
    from ..operators.staging import for_tenant, stg_transactions

    stg = stg_transactions(tx if org_id is None else for_tenant(tx, org_id))
    checkpoint_dir(spark)
    combined = marts_one_pass(stg).checkpoint(eager=True)
    enforce(run_tests_stacked(stack_marts(combined), [t for t in ALL_COLUMN_TESTS if t.model in MART_SETS]), blocking)
    marts, counts = split_marts(combined), {}
    load = commits.Load(spark, target_dir, {name: "replace" for name in marts})
    try:
        for name, mart in marts.items():
            obs = Observation(f"mart_{uuid.uuid4().hex}")
            mart.observe(obs, F.count(F.lit(1)).alias("rows")).write.parquet(load.folder(name))
            counts[name] = int(obs.get.get("rows", 0))
    except BaseException:
        load.abandon()
        raise
    load.commit()
    commits.vacuum(spark, target_dir)
    return counts
