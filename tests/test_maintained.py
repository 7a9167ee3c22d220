"""Transactions, key index and marts' state as one table set."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import marts as M
from ledgerlens.operators import staging as S
from ledgerlens.operators import state as ST
from ledgerlens.operators.clean import clean_transactions
from ledgerlens.operators.tenancy import promote
from ledgerlens.schemas import TRANSACTIONS
from ledgerlens.sources import commits as C
from ledgerlens.sources import fixtures as FX
from ledgerlens.streaming import maintained as MT

AT = dt.datetime(2025, 6, 1)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return FX.raw_dirty(spark, sf_dir).where("txn_date < '1995-06-01' OR txn_month IS NULL").coalesce(2).checkpoint()


@pytest.fixture(autouse=True)
def few_partitions(monkeypatch):
    monkeypatch.setattr(MT, "KEY_BUCKETS", 16)
    monkeypatch.setattr(ST, "PAIR_BUCKETS", 4)


def _part(raw, i, n):
    return raw.where(F.pmod(F.xxhash64("transaction_id"), F.lit(n)) == i)


def _rows(df):
    return sorted(map(str, df.collect()))


def _check(spark, path):
    """The maintained marts equal the rebuild from the stored rows, and no key is stored twice."""
    rows = MT.transactions(spark, path).checkpoint()
    assert rows.count() == rows.select("org_id", "transaction_id").distinct().count()
    at = C.snapshot(spark, path)
    keys = MT.table(spark, path, at, "keys")
    assert _rows(keys.select("org_id", "transaction_id")) == _rows(rows.select("org_id", "transaction_id"))
    stg = S.stg_transactions(rows)
    for name, mart in MT.marts(spark, path).items():
        assert _rows(mart) == _rows(getattr(M, name)(stg)), name
    return rows


def test_batches_replays_and_overlaps_equal_a_rebuild(spark, raw, scratch):
    path = os.path.join(scratch, "set")
    assert MT.append_batch(spark, path, _part(raw, 0, 3), "7", "in", 0, AT)
    assert MT.append_batch(spark, path, _part(raw, 1, 3), "8", "in", 1, AT)
    before = C.head(spark, path)
    assert not MT.append_batch(spark, path, _part(raw, 1, 3), "8", "in", 1, AT)          # replayed
    assert C.head(spark, path) == before
    assert MT.append_batch(spark, path, raw.where(F.col("seq") % 3 > 0), "7", "in", 2, AT)   # overlaps the first
    assert MT.append_batch(spark, path, raw.limit(0), "7", "in", 3, AT)                  # empty
    rows = _check(spark, path)
    none = spark.createDataFrame([], TRANSACTIONS)
    both = _part(raw, 0, 3).unionByName(raw.where(F.col("seq") % 3 > 0)).dropDuplicates()
    want = promote(clean_transactions(both).withColumn("ingested_at", F.lit(AT).cast("timestamp_ntz")), "7", none)
    assert _rows(rows.where("org_id = '7'").select("transaction_id")) == _rows(want.select("transaction_id"))


def test_a_batch_that_dies_leaves_nothing(spark, raw, scratch, monkeypatch):
    path = os.path.join(scratch, "set")
    MT.append_batch(spark, path, _part(raw, 0, 4), "7", "in", 0, AT)
    before = {name: _rows(m) for name, m in MT.marts(spark, path).items()}
    real = MT.merge_groups
    monkeypatch.setattr(MT, "merge_groups", lambda *a: (_ for _ in ()).throw(RuntimeError("driver gone")))
    with pytest.raises(RuntimeError):
        MT.append_batch(spark, path, _part(raw, 1, 4), "7", "in", 1, AT)
    monkeypatch.setattr(MT, "merge_groups", real)
    assert {name: _rows(m) for name, m in MT.marts(spark, path).items()} == before
    assert MT.append_batch(spark, path, _part(raw, 1, 4), "7", "in", 1, AT)
    _check(spark, path)


def test_two_streams_at_once(spark, raw, scratch):
    """Both offer the same keys to one org; each key is stored once."""
    path = os.path.join(scratch, "set")
    errors = []

    def run(stream):
        try:
            MT.append_batch(spark, path, _part(raw, 0, 4), "7", stream, 0, AT)
        except Exception as e:                              # pragma: no cover - reported below
            errors.append(e)

    threads = [threading.Thread(target=run, args=(s,)) for s in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert C.snapshot(spark, path).streams == {"one": 0, "two": 0}
    _check(spark, path)


def test_compaction_changes_no_row(spark, raw, scratch):
    path = os.path.join(scratch, "set")
    for i in range(4):
        MT.append_batch(spark, path, _part(raw, i, 4), "7", "in", i, AT)
    folders = {k: len(v) for k, v in C.snapshot(spark, path).tables.items()}
    MT.compact_set(spark, path, least=2)
    after = {k: len(v) for k, v in C.snapshot(spark, path).tables.items()}
    assert folders == {"transactions": 4, "keys": 4, "pairs": 4, "groups": 1}
    assert all(after[k] < folders[k] for k in ("transactions", "keys", "pairs"))
    C.vacuum(spark, path, grace_seconds=-1)
    _check(spark, path)
    assert MT.append_batch(spark, path, raw, "7", "in", 9, AT)
    _check(spark, path)


def test_stored_keys_stay_in_place_and_other_buckets_closed(spark, raw, scratch):
    """No exchange above the stored keys; a small batch opens its own buckets only."""
    path = os.path.join(scratch, "set")
    MT.append_batch(spark, path, raw, "7", "in", 0, AT)
    keys = MT.table(spark, path, C.snapshot(spark, path), "keys")
    ids = [r.transaction_id for r in keys.orderBy("transaction_id").limit(2).collect()]
    offered = spark.createDataFrame([("7", i) for i in [*ids, "no such key"]], "org_id string, transaction_id string").checkpoint()
    found = MT.known_keys(keys, offered).select(*keys.columns)
    assert _rows(found) == _rows(keys.where(F.col("transaction_id").isin(ids)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    opened = found.select(F.input_file_name().alias("f")).distinct().count()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("bucket" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans), plan
    assert opened <= 2
    # Several slices, and a batch beyond them, give the same keys.
    many = raw.select(F.lit("7").alias("org_id"), "transaction_id").distinct().checkpoint()
    whole = _rows(keys)
    for slice_keys in (1_000_000, many.count() // 5, 1):
        assert _rows(MT.known_keys(keys, many, slice_keys=slice_keys).select(*keys.columns)) == whole


def test_a_batch_reads_no_stored_transaction(spark, raw, scratch, monkeypatch):
    path = os.path.join(scratch, "set")
    MT.append_batch(spark, path, _part(raw, 0, 2), "7", "in", 0, AT)
    old = C.snapshot(spark, path).tables["transactions"][0]
    for month in os.listdir(os.path.join(path, old)):      # stored transactions cannot be read any more
        folder = os.path.join(path, old, month)
        if os.path.isdir(folder):
            for name in os.listdir(folder):
                if name.endswith(".parquet"):
                    with open(os.path.join(folder, name), "r+b") as f:
                        f.write(b"unreadable")
    assert MT.append_batch(spark, path, raw, "7", "in", 1, AT)
    none = spark.createDataFrame([], TRANSACTIONS)
    whole = promote(clean_transactions(raw).withColumn("ingested_at", F.lit(AT).cast("timestamp_ntz")), "7", none)
    for name, mart in MT.marts(spark, path).items():
        assert _rows(mart) == _rows(getattr(M, name)(S.stg_transactions(whole))), name
