"""Quoted CSV files read in many byte ranges (SRC-1).

A quoted field may hold line breaks, so whether a line starts a record depends on
all that stands before it.  A line's effect is small, though: it begins at a
record's start or inside a quoted field, and ends at either.  So

1. every byte range reports, for both cases, in which state it ends and how many
   records start in it (one row per range);
2. the ranges of a file are combined in order, which settles each range's state
   and the number of its first record;
3. every range is parsed from its first true record start; the record it leaves
   open takes its rest from the ranges behind it.

The ranges are the text reader's own splits.  The fields are parsed by Spark's
CSV parser, record by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["file", "block", "line"]
BLOCKS = "file string, block long, open_after_start boolean, open_after_open boolean, starts long, starts_if_open long, crlf boolean"


def closing_quote(line: str, at: int) -> int:
    """The place behind the quote that closes a quoted field; -1 if the line does not."""
    while (quote := line.find('"', at)) >= 0:
        if line[quote + 1:quote + 2] != '"':
            return quote + 1
        at = quote + 2
    return -1


def ends_open(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field (or at a record's start) ends
    inside one.  A quote opens a field only at the field's start; behind a closing
    quote all is text up to the next comma, as the CSV parser has it."""
    at = 0
    if inside:
        at = closing_quote(line, 0)
        if at < 0:
            return True
        at = line.find(",", at) + 1
        if at == 0:
            return False
    while True:
        if line[at:at + 1] == '"':
            at = closing_quote(line, at + 1)
            if at < 0:
                return True
            at = line.find(",", at) + 1
            if at == 0:
                return False
        else:
            at = line.find(',"', at) + 1
            if at == 0:
                return False


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The files' lines in order within each byte range: ``file, block, line``."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.col("value").alias("line"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """The batches cut where the byte range changes."""
    for batch in batches:
        new = (batch["block"] != batch["block"].shift()) | (batch["file"] != batch["file"].shift())
        for _, rows in batch.groupby(new.cumsum(), sort=False):
            yield (rows["file"].iloc[0], int(rows["block"].iloc[0])), rows


def _range_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 1.  ``line`` is null where it has no quote, ``filled`` false where it is
    empty; a file whose first line ends in a carriage return has such line ends."""
    def row(key, state, starts, crlf):
        return pd.DataFrame([(*key, *state, *starts, crlf)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    current, state, starts, crlf = None, [False, True], [0, 0], False
    for key, rows in _runs(batches):
        if key != current:
            if current is not None:
                yield row(current, state, starts, crlf)
            current, state, starts, crlf = key, [False, True], [0, 0], bool(rows["cr"].iloc[0])
        filled, since = rows["filled"].to_numpy().cumsum(), 0
        for i in rows["line"].notna().to_numpy().nonzero()[0]:
            for case in (0, 1):
                if not state[case]:
                    starts[case] += int(filled[i]) - since            # each filled line before, and this one
            since = int(filled[i])
            line = rows["line"].iat[i]
            state = [ends_open(line, s) for s in state] if state[0] != state[1] else [ends_open(line, state[0])] * 2
        for case in (0, 1):
            if not state[case]:
                starts[case] += int(filled[-1]) - since
    if current is not None:
        yield row(current, state, starts, crlf)


def _settle(ranges: pd.DataFrame) -> pd.DataFrame:
    """Step 2 for one file: each range's true state at its begin and its end, and the
    number of records that start before it."""
    ranges = ranges.sort_values("block")
    opened, before, out = False, 0, []
    for r in ranges.itertuples():
        after = r.open_after_open if opened else r.open_after_start
        out.append((r.file, r.block, opened, bool(after), before, bool(ranges["crlf"].iloc[0])))
        before += r.starts_if_open if opened else r.starts
        opened = bool(after)
    return pd.DataFrame(out, columns=["file", "block", "opened", "open_end", "before", "crlf"])


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines up to the end of the field that a range begins in, as one text."""
    def row(key, lines, closed):
        return pd.DataFrame([(*key, "\n".join(lines), closed)], columns=["file", "block", "head", "closed"])

    current, lines, closed = None, [], False
    for key, rows in _runs(batches):
        if key != current:
            if current is not None:
                yield row(current, lines, closed)
            current, lines, closed = key, [], False
        for line in rows["line"] if not closed else ():
            lines.append(line)
            if '"' in line and not ends_open(line, True):
                closed = True
                break
    if current is not None:
        yield row(current, lines, closed)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, record``: every record of the files (its text, without the line
    end) and its number in its file; 0 is the header.  Empty lines are no records.
    In a file whose header ends in CR LF, these are line breaks in fields too.

    Steps 1 and 2 run at once; what they leave on the driver is one small row per
    byte range, and the rests of records that cross a range's end."""
    lines = text_lines(spark, path)
    marked = lines.select("file", "block", F.when(F.col("line").contains('"'), F.col("line")).alias("line"),
                          (~F.col("line").isin("", "\r")).alias("filled"), F.col("line").endswith("\r").alias("cr"))
    states = marked.mapInPandas(_range_states, BLOCKS).groupBy("file").applyInPandas(
        _settle, "file string, block long, opened boolean, open_end boolean, before long, crlf boolean")
    ranges = {(r.file, r.block): r for r in states.collect()}
    opened = sorted(key for key, r in ranges.items() if r.opened)
    heads = {}
    if opened:
        keys = F.broadcast(spark.createDataFrame(opened, "file string, block long"))
        for r in lines.join(keys, ["file", "block"]).select(*LINE).mapInPandas(
                _heads, "file string, block long, head string, closed boolean").collect():
            heads[r.file, r.block] = (r.head, r.closed)
    rests, rest = {}, []
    for file, block in sorted(ranges, reverse=True):                   # from the last range to the first
        if ranges[file, block].open_end:
            rests[file, block] = "\n".join(["", *reversed(rest)]) if rest else ""
        if ranges[file, block].opened:
            head, closed = heads[file, block]
            rest = [head] if closed else [*rest, head]
        else:
            rest = []
    known = spark.sparkContext.broadcast({k: (r.opened, r.before, r.crlf, rests.get(k)) for k, r in ranges.items()})

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, inside, held, number, crlf, rest, out = None, False, None, 0, False, None, []

        def done(text):
            nonlocal number
            if crlf:
                text = text.removesuffix("\r").replace("\r\n", "\n")
            if text:
                out.append((current[0], number, text))
                number += 1

        def flush():
            if out:
                yield pd.DataFrame(out, columns=["file", "row", "record"])
                out.clear()

        for key, rows in _runs(batches):
            if key != current:
                if held is not None:                                   # the range before left a record open
                    done("\n".join(held) + (rest or ""))
                current, held = key, None
                inside, number, crlf, rest = known.value[key]
            for line in rows["line"]:
                after = ends_open(line, inside) if '"' in line else inside
                if held is not None:
                    held.append(line)
                    if not after:
                        done("\n".join(held))
                        held = None
                elif not inside:
                    if after:
                        held = [line]
                    else:
                        done(line)
                inside = after
            yield from flush()
        if held is not None:
            done("\n".join(held) + (rest or ""))
        yield from flush()

    return lines.mapInPandas(records, "file string, row long, record string")


def read_split_csv(spark: SparkSession, path: str, header: list[str], options: dict) -> DataFrame:
    """``file, row`` and the columns of ``header`` as text, parsed by the CSV parser
    under ``options``.  A file whose header differs from ``header``, and a record
    with too many or too few fields, fail the job."""
    schema = ", ".join(f"`{c}` string" for c in header)
    fields = F.from_csv("record", schema, {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema")})
    parsed = csv_records(spark, path).select("file", "row", fields.alias("fields"))
    same = F.lower(F.concat_ws("\x00", *[F.coalesce(F.col(f"fields.`{c}`"), F.lit("")) for c in header])) == "\x00".join(header).lower()
    wrong = F.raise_error(F.concat(F.lit("CSV header does not conform to the schema in "), F.col("file"))).cast("boolean")
    kept = F.when(F.col("row") > 0, True).when(same, False).otherwise(wrong)
    return parsed.where(kept).select("file", "row", "fields.*")
