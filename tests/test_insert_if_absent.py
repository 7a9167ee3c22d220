"""SRC-9 against a sequential loop."""

import random

import pytest

from ledgerlens.operators import tenancy as TN

SCHEMA = "place long, id string, slug string, code string, name string"
KEYS = [["id"], ["slug"], ["code", "name"]]


def sequential(target, offers, keys=KEYS, columns=("place", "id", "slug", "code", "name")):
    at = {c: i for i, c in enumerate(columns)}
    out = list(target)
    taken = [{tuple(r[at[c]] for c in k) for r in target} for k in keys]
    for row in offers:
        own = [tuple(row[at[c]] for c in k) for k in keys]
        if any(v in held for v, held in zip(own, taken) if None not in v):
            continue
        out.append(row)
        for v, held in zip(own, taken):
            held.add(v)
    return out


def check(spark, target, offers, last_rows):
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (target, offers)]
    got = TN.insert_if_absent(frames[0], frames[1].repartition(3), KEYS, order=["place"], last_rows=last_rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(sequential(target, offers), key=key)


@pytest.mark.parametrize("seed, last_rows", [(1, 0), (2, 0), (3, 100_000)])
def test_random_batches(spark, seed, last_rows):
    rnd = random.Random(seed)

    def value(n):
        return None if rnd.random() < 0.15 else f"x{rnd.randrange(n)}"

    offers = [(i, value(40), value(60), value(5), value(9)) for i in range(150)]
    target = [(-i - 1, value(40), value(60), None, None) for i in range(8)]
    check(spark, target, offers, last_rows)


@pytest.mark.parametrize("last_rows, length", [(0, 14), (100_000, 400)])
def test_chains(spark, last_rows, length):
    """(1,a) (2,a) (2,b) (3,b) ...: each row stands in the way of the next only if it went in."""
    offers = [(i, f"k{(i + 1) // 2}", f"s{i // 2}", None, None) for i in range(length)]
    check(spark, [], offers, last_rows)


def test_a_refused_row_stands_in_nobodys_way(spark):
    target = spark.createDataFrame([("9", "z")], "id string, slug string")
    new = spark.createDataFrame([("1", "a", 1), ("2", "a", 2), ("2", "b", 3)], "id string, slug string, place int")
    got = TN.insert_if_absent(target, new, [["id"], ["slug"]], order=["place"])
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b"), ("9", "z")]


def test_one_key_in_a_third_of_all_rows_and_repeated_rows(spark):
    offers = [(i, "hot" if i % 3 == 0 else f"i{i}", f"s{i % 7}", None, None) for i in range(60)]
    check(spark, [], offers, 0)
    rows = spark.createDataFrame([("1", "a")] * 3 + [(None, None)] * 2, "id string, slug string")
    out = TN.insert_if_absent(rows.limit(0), rows, [["id"], ["slug"]])
    assert sorted(map(str, out.collect())) == sorted(map(str, [rows.first(), *rows.where("id IS NULL").collect()]))
    assert TN.insert_if_absent(rows, rows.limit(0), [["id"], ["slug"]]).count() == 5
