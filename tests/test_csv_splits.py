"""Quoted CSV in byte ranges against the one-task reader."""

import os
import random

import pytest

from ledgerlens.schemas import CSV_COLUMNS
from ledgerlens.sources import csv_splits as X
from ledgerlens.sources import sinks as K

REST = ["c", "ON", "18-25", "savings"]
END = ["x", "1.00", "CAD", "completed", "2025-01-01", "2025-01", "2025"]


@pytest.fixture()
def tiny_splits(spark):
    """Byte ranges of a few bytes: a border in nearly every record and field."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]

    def use(size):
        for n, v in zip(names, (str(size), "0", "1")):
            spark.conf.set(n, v)
    yield use
    for n, v in zip(names, before):
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in '",\n\r') else value


def _write(path, merchants, end="\n", header=CSV_COLUMNS, raw=None):
    lines = [",".join(header)] + [",".join([f"T{i}", *REST, raw[i] if raw else _quoted(m), *END]) for i, m in enumerate(merchants)]
    with open(path, "w", newline="") as f:
        f.write(end.join(lines) + end)
    return path


def _both(spark, path):
    """Rows in the order of their positions, by both readers."""
    out = []
    for split in (False, True):
        df = K.read_transactions_csv(spark, path, split=split)
        out.append([tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: tuple(r.seq))])
    return out


@pytest.mark.parametrize("size, end", [(7, "\n"), (64, "\n"), (50, "\r\n"), (1 << 20, "\n")])
def test_every_border_gives_the_same_rows(spark, scratch, tiny_splits, size, end):
    rnd = random.Random(size)
    bits = ["a", "b c", ",", '"', '""', "\n", f"{end}", "é漢", ' "', '",', "\n\n", ""]
    merchants = ["m" + "".join(rnd.choice(bits) for _ in range(rnd.randrange(8))) for _ in range(8 if size == 7 else 40)]
    merchants += ["long\n" * (6 if size == 7 else 60), "end"]
    path = _write(os.path.join(scratch, "in.csv"), merchants, end)
    tiny_splits(size)
    whole, split = _both(spark, path)
    assert [r[0] for r in split] == [f"T{i}" for i in range(len(merchants))]
    assert split == whole
    rows = K.read_transactions_csv(spark, path)
    assert sorted(r.seq.row for r in rows.collect()) == list(range(1, len(merchants) + 1))
    if size == 64:
        assert X.text_lines(spark, path).rdd.getNumPartitions() > 40


def test_quotes_that_open_nothing(spark, scratch, tiny_splits):
    """Quotes inside unquoted fields, text behind a closing quote, empty lines."""
    raw = ['5" pipe', '"a"b', '"a" ', ' "a', '"a""', '""', '"""x"""', 'say "hi" there', '"x\n"y', "plain"]
    path = _write(os.path.join(scratch, "in.csv"), raw, raw=raw, end="\n")
    with open(path, "a") as f:
        f.write("\n\n" + ",".join(["T99", *REST, "last", *END]))
    raw.pop(4)                                             # '"a""' stays open and swallows what follows; see below
    good = _write(os.path.join(scratch, "good.csv"), raw, raw=raw)
    with open(good, "a") as f:
        f.write("\n\n" + ",".join(["T99", *REST, "last", *END]))
    for size in (9, 1 << 20):
        tiny_splits(size)
        whole, split = _both(spark, good)
        assert split == whole and len(split) == len(raw) + 1
        whole, split = _both(spark, path)                   # the open field ends at the next row's quote
        assert split == whole and len(split) < len(raw) + 2


def test_several_files_keep_their_own_positions(spark, scratch, tiny_splits):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    for name, start in (("a.csv", 0), ("b.csv", 50)):
        _write(os.path.join(folder, name), [f"m{start + i}\n\"x\"" for i in range(20)])
    open(os.path.join(folder, "c.csv"), "w").write(",".join(CSV_COLUMNS) + "\n")
    tiny_splits(100)
    whole, split = _both(spark, folder)
    assert split == whole and len(split) == 40


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_wrong_headers_and_field_counts_fail(spark, scratch, tiny_splits, size):
    tiny_splits(size)
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    _write(os.path.join(folder, "a.csv"), ["m"] * 5)
    _write(os.path.join(folder, "b.csv"), ["m"] * 5, header=[CSV_COLUMNS[1], CSV_COLUMNS[0], *CSV_COLUMNS[2:]])
    with pytest.raises(Exception, match="[Hh]eader"):
        K.read_transactions_csv(spark, folder).collect()
    for bad in ("m,more", None):
        path = _write(os.path.join(scratch, f"bad{bad}{size}.csv"), ["m", "m"])
        text = open(path).read()
        text = text.replace("T1,c,", "T1," if bad is None else "T1,c,more,")
        open(path, "w").write(text)
        with pytest.raises(Exception):
            K.read_transactions_csv(spark, path).select("merchant").collect()


def brute_open(text):
    """Whether a text that starts at a record's start ends inside a quoted field, char by char."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "closed" if c == '"' else "quoted"
        elif state == "closed" and c == '"':
            state = "quoted"
        elif c == "," or c == "\n":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "text"
    return state == "quoted"


def test_line_effects_against_brute_force():
    rnd = random.Random(5)
    for _ in range(20_000):
        line = "".join(rnd.choice('",,a"') for _ in range(rnd.randrange(12)))
        assert X.ends_open(line, False) == brute_open(line)
        assert X.ends_open(line, True) == brute_open('"' + line), line
