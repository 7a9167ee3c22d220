"""Tenant-scoped summaries, defaults, promotion and referential operators
(AGG-5, AGG-6, AGG-16, SRC-7..9, JON-3, JON-4).

Per-org queries come in two forms: for one org (a filter on ``org_id``, which
a table partitioned or sorted by org prunes to that org's files) and for all
orgs at once (the batched form used by the insight job).  The batched top-k
ranks the already aggregated (org, month) rows, so a tenant holding a third
of all transactions still contributes only one row per month to the window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import full_avg, money_sum
from ..schemas import CONTEXT_MONTHS, TRANSACTIONS
from ..session import checkpoint_dir
from .clean import dedupe_first
from .joins import subset_side
from .staging import active, for_tenant


def _completed(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("status") == "completed")


def org_monthly_all(tx: DataFrame, months: int = CONTEXT_MONTHS) -> DataFrame:
    """AGG-5 batched: the newest ``months`` completed months of every org.

    Months sort newest first with a null month first (the source database's
    DESC order), so a null month uses one of the slots and is then dropped,
    because such a row cannot be read back as text (G3).  No ``amount > 0``
    filter: the service reads the transactions table directly."""
    grouped = (_completed(tx).groupBy("org_id", F.col("txn_month").alias("month"))
               .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume")))
    w = Window.partitionBy("org_id").orderBy(F.col("month").desc_nulls_first())
    return (grouped.withColumn("month_rank", F.row_number().over(w))
            .where((F.col("month_rank") <= months) & F.col("month").isNotNull()))


def org_monthly(tx: DataFrame, org_id: str, months: int = CONTEXT_MONTHS) -> DataFrame:
    """AGG-5 for one org: ``month, revenue, volume``, newest first."""
    grouped = (_completed(for_tenant(tx, org_id)).groupBy(F.col("txn_month").alias("month"))
               .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume")))
    return (grouped.orderBy(F.col("month").desc_nulls_first()).limit(months)
            .where(F.col("month").isNotNull()))


def org_categories_all(tx: DataFrame) -> DataFrame:
    """AGG-6 batched: completed revenue, volume and average per (org, category).

    The average is the full quotient, not rounded.  Null categories are
    dropped (unreadable as text), and ``category_rank`` orders categories by
    revenue, highest first, within each org."""
    grouped = (_completed(tx).where(F.col("category").isNotNull())
               .groupBy("org_id", "category")
               .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume"),
                    full_avg().alias("avg_amount")))
    w = Window.partitionBy("org_id").orderBy(F.col("revenue").desc_nulls_first(), F.col("category"))
    return grouped.withColumn("category_rank", F.row_number().over(w))


def org_summaries_all(tx: DataFrame, months: int = CONTEXT_MONTHS) -> DataFrame:
    """AGG-5 and AGG-6 batched in ONE aggregation over the transactions.

    Grouping sets ``(org, month)`` and ``(org, category)`` over the completed
    rows; ``is_month`` tells the two kinds of row apart.  Month rows keep the
    newest ``months`` per org (a null month uses a slot and is then dropped,
    as in :func:`org_monthly_all`), category rows drop a null category and
    carry ``category_rank`` (revenue descending, then name).  Both rankings
    run over aggregated rows partitioned by (org, kind), so a hot org adds one
    row per month or category, never its transactions."""
    grouped = (_completed(tx)
               .groupingSets([["org_id", "txn_month"], ["org_id", "category"]], "org_id", "txn_month", "category")
               .agg(F.grouping("category").alias("_kind"),
                    money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume")))
    is_month = F.col("_kind") == 1          # category rolled up: an (org, month) row
    by_kind = Window.partitionBy("org_id", "_kind")
    ranked = (grouped
              .withColumn("month_rank", F.row_number().over(by_kind.orderBy(F.col("txn_month").desc_nulls_first())))
              .withColumn("category_rank", F.row_number().over(
                  by_kind.orderBy(F.col("revenue").desc_nulls_first(), F.col("category")))))
    keep = ((is_month & (F.col("month_rank") <= months) & F.col("txn_month").isNotNull())
            | (~is_month & F.col("category").isNotNull()))
    return (ranked.where(keep)
            .select("org_id", is_month.alias("is_month"), F.col("txn_month").alias("month"), "category",
                    "revenue", "volume", "month_rank", "category_rank"))


def org_categories(tx: DataFrame, org_id: str) -> DataFrame:
    """AGG-6 for one org: ``category, revenue, volume, avg_amount``, revenue descending."""
    return (_completed(for_tenant(tx, org_id)).where(F.col("category").isNotNull())
            .groupBy("category")
            .agg(money_sum().alias("revenue"), F.count(F.lit(1)).alias("volume"),
                 full_avg().alias("avg_amount"))
            .orderBy(F.col("revenue").desc_nulls_first(), F.col("category")))


def apply_defaults(df: DataFrame, defaults: dict, required: list[str] | None = None,
                   types: dict[str, str] | None = None) -> DataFrame:
    """SRC-7: a default fills a column only when the column is omitted.

    A column that is present keeps its values; for the ``required`` columns an
    explicit NULL fails the job (the target column is NOT NULL).  ``types``
    gives the stored type of a defaulted column (e.g. ``bigint``)."""
    out = df
    types = types or {}
    for col, value in defaults.items():
        if col not in out.columns:
            lit = F.lit(value)
            out = out.withColumn(col, lit.cast(types[col]) if col in types else lit)
    for col in required or []:
        out = out.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(
            F.lit(f"null value in column {col} violates not-null constraint"))).otherwise(F.col(col)))
    return out


def promote(raw: DataFrame, org_id: str, existing: DataFrame, loaded_at_col: str = "ingested_at",
            order_col: str = "seq", batch_is_small: bool = False) -> DataFrame:
    """SRC-8: raw rows → tenant rows for ``org_id``, skipping keys the tenant
    table already holds (one row per ``(org_id, transaction_id)``).

    A key that repeats inside the batch keeps its first row in the order of
    ``order_col``; a null key fails the job (the column is NOT NULL).  The id
    is a name-based hash of the key, so re-promoting the same batch yields the
    same ids.  Both sides hold the one org, so the key is ``transaction_id``:
    the dedupe and the anti join share one shuffle of the batch.

    ``batch_is_small`` is the caller's word that the batch is far smaller than
    the stored table (a stream micro-batch): the stored keys are first narrowed
    to those of the batch, which the planner does in place (broadcast) when the
    batch's size allows."""
    tenant = (dedupe_first(raw, ["transaction_id"], [order_col])
              .withColumnRenamed("customer_id", "customer_ref")
              .withColumn("transaction_id", F.when(F.col("transaction_id").isNull(), F.raise_error(
                  F.lit("null value in column transaction_id violates not-null constraint"))).otherwise(F.col("transaction_id")))
              .withColumn("org_id", F.lit(str(org_id)))
              .withColumn("id", F.md5(F.concat_ws(":", F.col("org_id"), F.col("transaction_id"))))
              .withColumn("source_id", F.lit(None).cast("string"))
              .withColumn("metadata", F.lit(None).cast("string"))
              .withColumn("amount", F.col("amount").cast("decimal(15,2)"))
              .withColumn("loaded_at", F.col(loaded_at_col).cast("timestamp_ntz")))
    cols = [f.name for f in TRANSACTIONS.fields]
    stored = existing.where(F.col("org_id") == F.lit(str(org_id))).select("transaction_id")
    if batch_is_small:
        stored = stored.join(raw.select("transaction_id"), "transaction_id", "left_semi")
    return tenant.select(*cols).join(stored, "transaction_id", "left_anti").select(*cols)


def insert_if_absent(target: DataFrame, new: DataFrame, key_sets: list[list[str]],
                     order: list[str] | None = None, last_rows: int = 100_000) -> DataFrame:
    """SRC-9: ``INSERT ... ON CONFLICT DO NOTHING`` of the rows of ``new``, one after
    the other in ``order`` (columns of ``new``; default: the key columns; ties by
    the other columns): a row is skipped if the target, or a row inserted before
    it, has its values in any of the ``key_sets``.  A null in a key never
    collides.  The result is the target plus the inserted rows.

    A skipped row stands in nobody's way, so the inserted rows are the first
    maximal set without conflict over the graph of rows and key values.  It is
    found in rounds: a row that is first at all its keys goes in, the rows that
    share a key with it go out.  A key's first row is a combined minimum, joined
    back by the key, so a key that a third of all rows share makes no hot task.
    Each round is checkpointed (``spark.checkpoint.dir``).  Once ``last_rows`` or
    fewer rows are undecided (long chains of conflicts, one link a round) one task
    decides the rest in order, with the same result."""
    columns = target.columns
    first = order or list(dict.fromkeys(c for keys in key_sets for c in keys))
    checkpoint_dir(new.sparkSession)
    for keys in key_sets:
        new = new.join(target.select(*keys), keys, "left_anti")
    rest = [c for c in new.columns if c not in first]
    place = [F.col(c).asc_nulls_first() for c in first + rest]
    key_names = [f"_key{i}" for i in range(len(key_sets))]
    keyed = [F.when(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.struct(*keys)).alias(name)
             for name, keys in zip(key_names, key_sets)]
    offered = (new.select(*columns, *[c for c in new.columns if c not in columns]).repartitionByRange(*place)
               .sortWithinPartitions(*place).select(*columns, *keyed, F.monotonically_increasing_id().alias("_place")).checkpoint())
    undecided, chosen = offered.select("_place", *key_names), []
    while (left := undecided.count()) > last_rows:
        marked = undecided
        for name in key_names:
            least = undecided.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("_place").alias(f"{name}_least"))
            marked = marked.join(least, name, "left")
        is_first = reduce(Column.__and__, [F.coalesce(F.col(f"{n}_least"), F.col("_place")) == F.col("_place") for n in key_names])
        marked = marked.select("_place", *key_names, is_first.alias("_first")).checkpoint()
        into = marked.where("_first")
        chosen.append(into.select("_place"))
        undecided = marked.where("NOT _first").drop("_first")
        for name in key_names:
            undecided = undecided.join(into.select(name), name, "left_anti")
        undecided = undecided.checkpoint()
    if left:
        def decide(batches):
            taken = [set() for _ in key_names]
            for batch in batches:
                keys = [batch[name] for name in key_names]
                into = []
                for i, place in enumerate(batch["_place"]):
                    own = [(held, k[i]) for held, k in zip(taken, keys) if k[i] is not None]
                    if not any(k in held for held, k in own):
                        into.append(place)
                        for held, k in own:
                            held.add(k)
                yield batch.loc[batch["_place"].isin(into), ["_place"]]

        texts = [F.to_json(name, {"ignoreNullFields": "false"}).alias(name) for name in key_names]
        chosen.append(undecided.select("_place", *texts).repartition(1).sortWithinPartitions("_place").mapInPandas(decide, "_place long"))
    if not chosen:
        return target.unionByName(offered.select(*columns))
    inserted = offered.join(reduce(DataFrame.unionAll, chosen), "_place", "left_semi")
    return target.unionByName(inserted.select(*columns))


def quota_rows(orgs: DataFrame, tx: DataFrame) -> DataFrame:
    """AGG-16: transactions stored per org against ``max_rows``.

    The count is a map-side-combined aggregate; the join to the organizations
    dimension is on its key, so every org appears (0 rows when it has none)."""
    used = tx.groupBy("org_id").agg(F.count(F.lit(1)).alias("rows_used"))
    return (orgs.select(F.col("id").alias("org_id"), "max_rows")
            .join(used, "org_id", "left")
            .select("org_id", F.coalesce("rows_used", F.lit(0)).alias("rows_used"), "max_rows",
                    (F.coalesce("rows_used", F.lit(0)) > F.col("max_rows")).alias("over_quota")))


def quota_users(orgs: DataFrame, memberships: DataFrame) -> DataFrame:
    """AGG-16: active members per org against ``max_users``."""
    used = active(memberships).groupBy("org_id").agg(F.count(F.lit(1)).alias("users_used"))
    return (orgs.select(F.col("id").alias("org_id"), "max_users")
            .join(used, "org_id", "left")
            .select("org_id", F.coalesce("users_used", F.lit(0)).alias("users_used"), "max_users",
                    (F.coalesce("users_used", F.lit(0)) > F.col("max_users")).alias("over_quota")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """JON-3: child rows whose non-null key has no parent row.

    The planner broadcasts a parent table that its file statistics show to be
    small, so the child is not shuffled; a larger one is a shuffle join, where
    AQE splits a child key that holds a third of all rows."""
    parent_key = parent_key or child_key
    parents = parent.select(F.col(parent_key).alias("_parent_key")).where(F.col("_parent_key").isNotNull())
    return child.where(F.col(child_key).isNotNull()).join(parents, F.col(child_key) == F.col("_parent_key"), "left_anti")


def purge_orgs(child: DataFrame, deleted_orgs: DataFrame, org_col: str = "org_id",
               deleted_key: str = "id", organizations: DataFrame | None = None) -> DataFrame:
    """JON-4: drop the child rows of deleted orgs (``ON DELETE CASCADE``).

    The deleted orgs are often computed (e.g. from a quota aggregate over the
    child table), so the planner cannot size them.  Given the stored
    ``organizations`` table they are a subset of, its file statistics bound
    them (:func:`ledgerlens.operators.joins.subset_side`): the child table, in
    which one org may own a third of all rows, is then filtered in place."""
    gone = deleted_orgs.select(F.col(deleted_key).alias("_gone"))
    if organizations is not None:
        gone = subset_side(gone, organizations)
    return child.join(gone, F.col(org_col) == F.col("_gone"), "left_anti")
