"""Transactions, their key index and the marts' state as one table set (SRC-8, AGG-17).

A batch appends its new rows, their keys and their new pairs, and replaces the
marts' groups, in one commit (:mod:`ledgerlens.sources.commits`).  A replayed
batch is known by its number and does nothing; a batch that died before its
commit left nothing.  No step reads a stored transaction:

* stored keys are partitioned by a hash of the key.  The batch's keys are sent
  to the stored ones, bucket by bucket in slices of bounded size, so stored keys
  are never exchanged and buckets that the batch has no key in are not opened;
* the marts come from the merged state (:mod:`ledgerlens.operators.state`).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_transactions
from ..operators.staging import stg_transactions
from ..operators.state import GROUPS, PAIRS, distinct_pairs, maintained_marts, merge_groups, new_pairs
from ..operators.tenancy import promote
from ..schemas import TRANSACTIONS
from ..session import checkpoint_dir
from ..sources import commits

KEYS = "org_id string, transaction_id string, bucket int"
#: Buckets of the key index; fixed for a table set.
KEY_BUCKETS = 256
#: Keys of a batch that are sent to the stored keys at once, and how many such
#: slices a batch may have before the planner's shuffle join is the better way.
SLICE_KEYS, MAX_SLICES = 1_000_000, 16


def key_bucket():
    return F.pmod(F.xxhash64("org_id", "transaction_id"), F.lit(KEY_BUCKETS)).cast("int")


def table(spark: SparkSession, path: str, at: commits.Snapshot, name: str) -> DataFrame | None:
    schema = {"transactions": TRANSACTIONS, "keys": KEYS, "pairs": PAIRS, "groups": GROUPS}[name]
    if name not in at.tables:
        return None
    out = commits.read_snapshot(spark, path, at, name, schema=schema)
    return out.select(*[f.name for f in TRANSACTIONS.fields]) if name == "transactions" else out


def known_keys(stored: DataFrame, offered: DataFrame, slice_keys: int = SLICE_KEYS, max_slices: int = MAX_SLICES) -> DataFrame:
    """The ``offered`` keys (``org_id, transaction_id``; a written frame) that the
    index holds.  Each slice of buckets joins the offered keys that fall into it,
    broadcast (their number is counted), to the stored keys in place."""
    keyed = offered.withColumn("bucket", key_bucket())
    sizes = {r["bucket"]: r["count"] for r in keyed.groupBy("bucket").count().collect()}
    slices, room = [[]], slice_keys
    for bucket in sorted(sizes):
        if slices[-1] and sizes[bucket] > room:
            slices.append([])
            room = slice_keys
        slices[-1].append(bucket)
        room -= sizes[bucket]
    on = ["bucket", "org_id", "transaction_id"]
    if len(slices) > max_slices or max(sizes.values(), default=0) > slice_keys:
        return stored.join(keyed, on, "left_semi")
    return reduce(DataFrame.unionAll, [
        stored.where(F.col("bucket").isin(own)).join(F.broadcast(keyed.where(F.col("bucket").isin(own))), on, "left_semi")
        for own in slices])


def append_batch(spark: SparkSession, path: str, raw: DataFrame, org_id: str, stream: str, batch: int,
                 loaded_at: dt.datetime | None = None, tries: int = 5, compact_after: int = 16) -> bool:
    """Clean a batch of raw rows (with file position ``seq``) and add its new ones to
    the table set at ``path``; False if the batch is already there.  If another
    load was committed meanwhile, the batch is worked out again on top of it."""
    checkpoint_dir(spark)
    stamp = loaded_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    cleaned = clean_transactions(raw).withColumn("ingested_at", F.lit(stamp).cast("timestamp_ntz")).checkpoint()
    offered = cleaned.select(F.lit(str(org_id)).alias("org_id"), "transaction_id").distinct()
    for attempt in range(tries):
        at = commits.snapshot(spark, path)
        if at.streams.get(stream, -1) >= batch:
            return False
        load = commits.Load(spark, path, {"transactions": "append", "keys": "append", "pairs": "append", "groups": "replace"},
                            conflict="fail", base=at, stream=stream, batch=batch)
        try:
            _write_batch(spark, path, at, load, cleaned, offered, org_id)
        except BaseException:
            load.abandon()
            raise
        try:
            load.commit()
            break
        except commits.ConcurrentLoad:
            if attempt + 1 == tries:
                raise
    compact_set(spark, path, compact_after)
    return True


def _write_batch(spark, path, at, load, cleaned, offered, org_id) -> None:
    stored = table(spark, path, at, "keys")
    known = offered.limit(0) if stored is None else known_keys(stored, offered).select("org_id", "transaction_id")
    (promote(cleaned, org_id, known).hint("rebalance", "txn_month").write.partitionBy("txn_month").parquet(load.folder("transactions")))
    rows = spark.read.schema(TRANSACTIONS).parquet(load.folder("transactions"))
    write_keys(rows.select("org_id", "transaction_id").withColumn("bucket", key_bucket()), load.folder("keys"))
    stg = stg_transactions(rows)
    pairs = distinct_pairs(stg).checkpoint()
    fresh = new_pairs(pairs, table(spark, path, at, "pairs")).checkpoint()
    write_pairs(fresh, load.folder("pairs"))
    merge_groups(table(spark, path, at, "groups"), stg, fresh).coalesce(1).write.parquet(load.folder("groups"))


def write_keys(keys: DataFrame, folder: str) -> None:
    keys.hint("rebalance", "bucket").sortWithinPartitions("bucket", "org_id", "transaction_id").write.partitionBy("bucket").parquet(folder)


def write_pairs(pairs: DataFrame, folder: str) -> None:
    (pairs.select("key", "kind", "part").hint("rebalance", "kind", "part").sortWithinPartitions("kind", "part", "key")
     .write.partitionBy("kind", "part").parquet(folder))


def compact_set(spark: SparkSession, path: str, least: int = 16) -> None:
    """Merge the small folders that batches leave in the index, the pairs and the
    transactions."""
    def rewrite(name, write):
        commits.compact(spark, path, name, lambda at, folder: write(table(spark, path, at, name), folder), least)

    rewrite("keys", write_keys)
    rewrite("pairs", write_pairs)
    rewrite("transactions", lambda rows, folder: rows.hint("rebalance", "txn_month").write.partitionBy("txn_month").parquet(folder))


def marts(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The four marts as of the last commit (or commit ``number``)."""
    at = commits.snapshot(spark, path, number)
    if "groups" not in at.tables:
        raise FileNotFoundError(f"{path} has no batch yet")
    return maintained_marts(table(spark, path, at, "groups"))


def transactions(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The tenant transactions as of the last commit (or commit ``number``)."""
    return table(spark, path, commits.snapshot(spark, path, number), "transactions")
