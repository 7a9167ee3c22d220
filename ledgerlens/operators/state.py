"""The four marts as maintained state (AGG-17): a batch costs its own rows.

Sums, counts, minima and maxima of a mart's groups merge.  Distinct counts do
not, so the distinct (group, value) pairs are kept as keys; a batch adds one to
its group for every pair that is not stored yet.  ``groups`` has one row per
group of every mart, in the form of :func:`ledgerlens.operators.marts.marts_one_pass`;
``pairs`` is partitioned so that a batch reads only the partitions it touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .marts import DISTINCT_SETS, MART_KEYS, MART_SETS, _gid, marts_one_pass, split_marts
from .staging import fct_revenue

PAIRS = "key string, kind int, part string"
PAIR_BUCKETS = 64
MEASURES = {"n_all": "bigint", "amt_all": "decimal(38,2)", "n_c": "bigint", "amt_c": "decimal(38,2)", "min_c": "decimal(38,2)",
            "max_c": "decimal(38,2)", "cust_c": "bigint", "cat_c": "bigint"}
GROUPS = ("category string, province string, txn_month string, txn_year int, status string, _gid bigint, "
          + ", ".join(f"{name} {kind}" for name, kind in MEASURES.items()))


def distinct_pairs(stg: DataFrame) -> DataFrame:
    """The distinct (group, counted value) pairs of the completed rows: ``kind`` (the
    place in ``DISTINCT_SETS``), the group's keys, ``key`` (the whole pair as text)
    and ``part``, the partition that it is stored in: its month, or a bucket of its
    hash where the group has none."""
    kinds = []
    for kind, (_, mart, counted) in enumerate(DISTINCT_SETS):
        own = MART_SETS[mart] + [counted]
        key = F.to_json(F.struct(*own), {"ignoreNullFields": "false"})
        month = F.coalesce("txn_month", F.lit("none")) if "txn_month" in own else F.lit(None).cast("string")
        kinds.append(F.when(F.col(counted).isNotNull(), F.struct(
            F.lit(kind).alias("kind"), key.alias("key"), month.alias("month"),
            *[(F.col(c) if c in MART_SETS[mart] else F.lit(None).cast(stg.schema[c].dataType)).alias(c) for c in MART_KEYS])))
    bucket = F.lpad(F.pmod(F.xxhash64("key"), F.lit(PAIR_BUCKETS)).cast("string"), 3, "0")
    pairs = (fct_revenue(stg).select(F.explode(F.array_compact(F.array(*kinds))).alias("p")).select("p.*")
             .groupBy("kind", "key", "month", *MART_KEYS).agg(F.lit(1).alias("_one")).drop("_one"))
    return pairs.withColumn("part", F.coalesce("month", bucket)).drop("month")


def new_pairs(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Pairs of the batch that are not stored.  ``batch`` is a written frame; its
    partitions (at most months and buckets, a few hundred) prune the stored scan."""
    if stored is None:
        return batch
    parts = {(r["kind"], r["part"]) for r in batch.select("kind", "part").distinct().collect()}
    if not parts:
        return batch
    there = reduce(Column.__or__, [(F.col("kind") == kind) & F.col("part").isin(sorted(p for k, p in parts if k == kind))
                                   for kind in sorted({k for k, _ in parts})])
    return batch.join(stored.where(there).select("kind", "part", "key"), ["kind", "part", "key"], "left_anti")


def merge_groups(groups: DataFrame | None, stg: DataFrame, fresh_pairs: DataFrame) -> DataFrame:
    """``groups`` with a batch of staged rows and its new pairs added."""
    delta = marts_one_pass(stg, distinct_counts=False)
    outs = {kind: (out, _gid(MART_SETS[mart])) for kind, (out, mart, _) in enumerate(DISTINCT_SETS)}
    gid = reduce(lambda w, k: w.when(F.col("kind") == k, outs[k][1]), outs, F.when(F.lit(False), 0))
    counts = {out: F.when(F.col("kind").isin([k for k, (o, _) in outs.items() if o == out]), 1).otherwise(0).cast("bigint")
              for out in ("cust_c", "cat_c")}
    added = fresh_pairs.select(*MART_KEYS, gid.cast("bigint").alias("_gid"),
                               *[counts.get(m, F.lit(None if m[:3] in ("min", "max") else 0)).cast(kind).alias(m) for m, kind in MEASURES.items()])
    parts = [delta.select(*MART_KEYS, F.col("_gid").cast("bigint").alias("_gid"),
                          *[F.col(m).cast(kind).alias(m) for m, kind in MEASURES.items()]), added]
    if groups is not None:
        parts.append(groups.select(*added.columns))
    how = {"min_c": F.min, "max_c": F.max}
    return (reduce(DataFrame.unionAll, parts).groupBy("_gid", *MART_KEYS)
            .agg(*[how.get(m, F.sum)(m).cast(kind).alias(m) for m, kind in MEASURES.items()])
            .select(*added.columns))


def maintained_marts(groups: DataFrame) -> dict[str, DataFrame]:
    """The four marts, equal to those built from all transactions."""
    return split_marts(groups)
