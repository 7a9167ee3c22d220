"""Document fingerprints from closed syncmers.

A k-mer of consecutive tokens is an anchor (a closed syncmer) when the smallest
of its inner s-mers, by hash, lies at its first or last place.  Whether a k-mer
is chosen depends on its own tokens alone, so an edit moves no anchor outside
its reach.  Tokens of the lower-cased text are words between white space; a run
of more than ``MAX_WORD`` characters, or with a letter of a script that writes
no spaces, is read character by character (``SPACELESS``).

A fingerprint holds all anchors in text order, and two fingerprints are compared
by anchors and their places (:func:`likeness`).

DataFrame functions only.  Nested ``transform`` calls bind intermediate arrays
once; inlined, Spark would rebuild them for every element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MB, bind, small_side, stored, text_or_empty

MAX_WORD = 32           # longer runs without white space are read character by character
SPACE = r"\x20\x09-\x0D"
SPACELESS = "".join(rf"\p{{Is{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
#: A whole run that is a word, else one character.
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}{SPACELESS}]{{1,{MAX_WORD}}}+(?![^{SPACE}])|[^{SPACE}]"
PLACE = (1 << 31) - 1   # places in a list of anchors are below this
MAX_RANGES = 1 << 14    # ranges of the id order; beyond 128 GB of text the ranges grow instead


def pairwise(values: Column, step: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of every element and the one ``step`` places after it; the last ``step`` elements pair with null."""
    return F.zip_with(values, F.slice(values, step + 1, F.greatest(F.size(values) - step, F.lit(0))), f)


def anchors(text: Column, k: int, s: int) -> Column:
    """The closed syncmers of ``text`` in order, as 32-bit hashes.  Fewer than
    ``k`` tokens form a single anchor; no token, none."""
    w = k - s + 1
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))

    def digest(c: Column) -> Column:
        return F.shiftright(F.xxhash64(c), 32).cast("int")

    def least_of_runs(inner: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of the least value of each run of ``w`` elements: runs double, the last two overlap."""
        def grow(least: Column, width: int) -> Column:
            if width == w:
                return body(least)
            step = min(width, w - width)
            return bind(pairwise(least, step, lambda x, y: F.least(x, y)), lambda wider: grow(wider, width + step))

        return grow(inner, 1)

    def chosen(hashes: Column, inner: Column, least: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(1), F.size(inner) - (w - 1)), lambda i: F.when(
            (F.get(inner, i - 1) == F.get(least, i - 1)) | (F.get(inner, i + (w - 2)) == F.get(least, i - 1)),
            digest(F.slice(hashes, i, k))))
        return F.filter(picked, lambda x: x.isNotNull())

    def inner_hashes(hashes: Column) -> Column:
        if s == 1:
            return F.transform(hashes, lambda h: F.xxhash64(h))
        if s == 2:
            pairs = pairwise(hashes, 1, lambda x, y: F.xxhash64(x, y))
        else:
            pairs = F.transform(F.sequence(F.lit(1), F.size(hashes)), lambda i: F.xxhash64(F.slice(hashes, i, s)))
        return F.slice(pairs, 1, F.size(hashes) - (s - 1))

    def of_hashes(hashes: Column) -> Column:
        anchored = bind(inner_hashes(hashes), lambda x: least_of_runs(x, lambda m: chosen(hashes, x, m)))
        return (F.when(F.size(hashes) >= k, anchored)
                .when(F.size(hashes) > 0, F.array(digest(hashes)))
                .otherwise(F.array().cast("array<int>")))

    return bind(F.transform(tokens, lambda t: F.xxhash64(t)), of_hashes)


def fingerprint(marks: Column) -> Column:
    """Text form of all anchors in order, 8 hex digits each; no anchor, the empty string."""
    return F.lower(F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def shifts(a: Column, b: Column, last: bool) -> Column:
    """For every anchor in both lists its place in ``b`` less its place in ``a``;
    of a repeated anchor the first place in each list or, if ``last``, the last.

    Both lists are sorted as one by (anchor, list, place), ``a`` before ``b``; with
    places descending on one side the two that meet are the first or the last."""
    def packed(marks: Column, side: int, falling: bool) -> Column:
        return F.transform(marks, lambda x, i: F.shiftleft(F.coalesce(x, F.lit(0)).cast("long"), 32) + F.lit(side << 31).cast("long")
                           + (F.lit(PLACE) - i if falling else i))

    def meeting(x: Column, y: Column) -> Column:
        side = F.lit(1 << 31)
        places = x.bitwiseAND(F.lit(PLACE)) + y.bitwiseAND(F.lit(PLACE)) - PLACE
        return F.when((F.shiftright(x, 32) == F.shiftright(y, 32)) & (x.bitwiseAND(side) == 0) & (y.bitwiseAND(side) != 0), -places if last else places)

    both = F.sort_array(F.concat(packed(a, 0, not last), packed(b, 1, last)))
    return bind(both, lambda values: F.filter(pairwise(values, 1, meeting), lambda d: d.isNotNull()))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of the anchors of two lists that match by place; two empty lists are alike.

    Half of each anchor in both lists is matched if its first places agree, half
    if its last ones do: their shift differs from the middle shift by no more
    than a quarter of the longer list.  A text with its halves exchanged, or
    twice in a row, thus matches itself in part only."""
    def of_shifts(moved: Column) -> Column:
        middle = F.get(moved, F.floor(F.size(moved) / 2).cast("int"))
        slack = F.greatest(F.size(a), F.size(b)) / 4
        matched = bind(middle, lambda m: F.size(F.filter(moved, lambda d: F.abs(d - m) <= slack)))
        return bind(F.coalesce(matched, F.lit(0)) / 2, lambda n: n / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n))

    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .otherwise(bind(F.sort_array(F.concat(shifts(a, b, False), shifts(a, b, True))), of_shifts)))


def document_fingerprints(docs: DataFrame, k: int = 5, s: int = 2) -> DataFrame:
    """``doc_id, n_chars, anchors, fingerprint`` per row; null text counts as
    empty; equal texts have equal fingerprints; no rows give none."""
    rows = docs.select("doc_id", F.char_length(text_or_empty()).cast("long").alias("n_chars"),
                       anchors(text_or_empty(), k, s).alias("anchors"))
    return rows.withColumn("fingerprint", fingerprint(F.col("anchors")))


def range_of(ident: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (ascending) at or below ``ident``, found in two steps of
    about the square root of their number."""
    step = math.isqrt(len(cuts)) + 1
    every = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1::step]]).cast("array<bigint>")
    return bind(F.size(F.filter(coarse, lambda c: c <= ident)) * step, lambda passed: passed + F.size(
        F.filter(F.slice(every, passed + 1, step), lambda c: c <= ident)))


def with_next(docs: DataFrame, k: int, s: int, bucket_bytes: int = 8 * MB) -> DataFrame:
    """``docs(doc_id, text)`` with ``anchors``, and ``next_text, next_anchors`` of the
    row that follows in the order of (doc_id, text); after the last row, the first.

    Rows are dealt into ranges of the id, so the order needs no single task;
    each range's first row is handed to the range before it."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // bucket_bytes)))
    cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    ident = F.coalesce("doc_id", F.lit(-(1 << 63)))
    dealt = docs.withColumn("bucket", range_of(ident, sorted(set(cuts or []))))
    led = dealt.withColumn("anchors", anchors(F.col("text"), k, s)).withColumn("after", F.lead(F.struct("text", "anchors")).over(
        Window.partitionBy("bucket").orderBy(ident, "text")))
    least = stored(dealt.groupBy(F.col("bucket").alias("at")).agg(F.min(ident).alias("least")), "syncmer-ranges")
    # One row per range: its successor is the next range that has rows, the last one's the first.
    ring = Window.orderBy("at")
    then = stored(least.withColumn("then", F.lead("at").over(ring)).select(
        "at", F.coalesce("then", F.min("at").over(ring)).alias("then")), "syncmer-ring")
    heads = (dealt.join(small_side(least), (F.col("bucket") == F.col("at")) & (ident == F.col("least")))
             .groupBy(F.col("bucket").alias("then")).agg(F.min("text").alias("text"))
             .withColumn("anchors", anchors(F.col("text"), k, s)))
    heads = stored(then.join(heads, "then").select("at", F.struct("text", "anchors").alias("head")), "syncmer-heads")
    return (led.join(small_side(heads, 256 * MB), led["bucket"] == heads["at"])
            .withColumn("after", F.coalesce("after", "head"))
            .select("doc_id", "text", "anchors", F.col("after.text").alias("next_text"), F.col("after.anchors").alias("next_anchors")))


def edited_fingerprints(docs: DataFrame, k: int = 5, s: int = 2) -> DataFrame:
    """Per row: the fingerprints of the text and of its edited form (its last
    quarter replaced by the start of the next document), and their likeness.

    Rows that repeat an id are ordered by their text; with one row the next
    document is the row itself.  Null text counts as empty; ids may be null
    (they come first); no rows give none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = with_next(rows, k, s)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "anchors",
                       anchors(F.col("edited"), k, s).alias("edited_anchors"), "next_anchors")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("anchors")).alias("fingerprint"),
                       fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
                       likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
                       likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
