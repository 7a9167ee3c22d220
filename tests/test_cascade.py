"""Deletes over the key graph of a stored table set."""

import os

import pytest

from ledgerlens.operators import cascade as CA
from ledgerlens.sources import commits as C

ROWS = {
    "organizations": ("id string", [("o1",), ("o2",)]),
    "users": ("id string", [("u1",), ("u2",), ("u3",)]),
    "memberships": ("org_id string, user_id string, invited_by string", [("o1", "u1", None), ("o2", "u2", "u3"), ("o2", "u1", None)]),
    "refresh_tokens": ("user_id string, org_id string", [("u1", "o1"), ("u2", "o2")]),
    "data_sources": ("id string, org_id string, created_by string", [("d1", "o1", "u1"), ("d2", "o2", "u2")]),
    "transactions": ("id string, org_id string, source_id string", [("t1", "o1", "d1"), ("t2", "o1", None), ("t3", "o2", "d2"), ("t4", "o2", None)]),
    "pipeline_runs": ("id string, org_id string, source_id string, triggered_by string", [("r1", "o1", "d1", "u1"), ("r2", "o2", "d2", None)]),
    "ai_insights": ("id string, org_id string, run_id string", [("i1", "o1", "r1"), ("i2", "o2", "r2"), ("i3", "o2", None)]),
}


@pytest.fixture()
def stored(spark, scratch):
    """Two loads: every table's first row, then the others."""
    path = os.path.join(scratch, "set")
    for part in (slice(0, 1), slice(1, None)):
        load = C.Load(spark, path, {name: "append" for name in ROWS})
        for name, (schema, rows) in ROWS.items():
            spark.createDataFrame(rows[part], schema).coalesce(1).write.parquet(load.folder(name))
        load.commit()
    return path


def _all(spark, path):
    at = C.snapshot(spark, path)
    return {name: sorted(map(str, map(tuple, C.read_snapshot(spark, path, at, name).collect()))) for name in at.tables}


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_an_org_goes_from_every_table(spark, stored):
    before = C.snapshot(spark, stored)
    removed = CA.purge_set(spark, stored, {"organizations": _ids(spark, "o1")})
    assert removed == {"organizations": 1, "users": 0, "memberships": 1, "refresh_tokens": 1, "data_sources": 1, "transactions": 2,
                       "pipeline_runs": 1, "ai_insights": 1}
    after = _all(spark, stored)
    assert all("o1" not in row for rows in after.values() for row in rows)
    assert {name: len(rows) for name, rows in after.items()} == {name: len(ROWS[name][1]) - removed[name] for name in ROWS}
    now = C.snapshot(spark, stored)
    assert now.number == before.number + 1
    assert now.tables["users"] == before.tables["users"]                      # untouched tables and folders stay
    assert before.tables["ai_insights"][1] in now.tables["ai_insights"]


def test_a_refused_delete_changes_nothing(spark, stored):
    before = _all(spark, stored)
    with pytest.raises(CA.RefusedDelete, match="memberships.invited_by"):
        CA.purge_set(spark, stored, {"users": _ids(spark, "u3")})
    with pytest.raises(CA.RefusedDelete, match="data_sources.created_by.*users|pipeline_runs"):
        CA.purge_set(spark, stored, {"users": _ids(spark, "u1")})
    with pytest.raises(CA.RefusedDelete, match="1 rows of transactions.source_id"):
        CA.purge_set(spark, stored, {"data_sources": _ids(spark, "d2")})
    assert _all(spark, stored) == before and C.head(spark, stored) == 2
    # The org's rows go with it, so its user's keys refuse nothing any more.
    assert CA.purge_set(spark, stored, {"organizations": _ids(spark, "o1"), "users": _ids(spark, "u1")})["memberships"] == 2
    assert CA.purge_set(spark, stored, {"organizations": _ids(spark, "nobody")}) == dict.fromkeys(ROWS, 0)
    assert C.head(spark, stored) == 3


def test_cycles_and_chains(spark):
    chain = [CA.ForeignKey(f"t{i + 1}", "up", f"t{i}") for i in range(4)]
    tables = {f"t{i}": spark.createDataFrame([(f"{i}a", f"{i - 1}a"), (f"{i}b", f"{i - 1}b"), (f"{i}c", None)], "id string, up string")
              for i in range(5)}
    flagged, refusals = CA.close_delete(tables, {"t1": _ids(spark, "1a")}, chain)
    gone = {name: [r.id for r in df.where("_gone").collect()] for name, df in flagged.items()}
    assert gone == {"t0": [], "t1": ["1a"], "t2": ["2a"], "t3": ["3a"], "t4": ["4a"]} and refusals.count() == 0
    with pytest.raises(ValueError, match="cycle"):
        CA.table_order(["a", "b"], [CA.ForeignKey("a", "x", "b"), CA.ForeignKey("b", "y", "a")])
