"""Mixing sources to target weights: temperature mixing.

A source with token share p gets weight p^a / sum(p^a).  The exponent a is
bisected in [0, 1]: the mix is as even as the target entropy asks, unless that
would repeat a source beyond the limit.  The weights are then realised within
the token budget as block permutations: a source's documents are dealt into
blocks by a hash; every whole epoch holds all its blocks in an order drawn for
that epoch, the last, partial epoch a prefix of its order (and of the documents
inside the block where the quota ends).

All steps are DataFrame functions; the driver sees a few numbers per bisection
round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_side, stored, text_or_empty

STEPS = 20       # the exponent is a multiple of 2**-20
FAN = 4          # bisection levels evaluated in one pass
MAX_BLOCKS = 1 << 16


def hash60(*parts: Column) -> Column:
    """60 bits of MD5 as a long; MD5 so that any SQL engine can restate it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, deal`` per row; null text has no tokens, a null
    source is a source of its own."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("n_tokens"),
                       hash60(F.lit("doc"), ident).alias("deal"))


def solve_exponent(sources: DataFrame, target_entropy: float, max_repeats: float, budget_share: float) -> float:
    """Largest exponent whose mix reaches ``target_entropy`` (a share of the
    entropy of an even mix), raised where some source would be repeated more
    than ``max_repeats`` times.  ``sources`` has ``tokens`` per source, all > 0."""
    n, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    if n < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def search(passes) -> int:
        """Smallest multiple k of 2**-STEPS in [0, 2**STEPS] with ``not passes(k)`` minus one, by FAN levels a round."""
        lo, hi = 0, 1 << STEPS                       # passes(lo) is taken for true, passes(hi) for false
        while hi - lo > 1:
            step = max(1, (hi - lo) >> FAN)
            tries = sources.select("tokens", F.explode(F.sequence(F.lit(lo + step), F.lit(hi - 1), F.lit(step))).alias("k"))
            tries = tries.withColumn("q", F.pow(p, F.col("k") / float(1 << STEPS)))
            sums = tries.groupBy("k").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.ln("q")).alias("ql"),
                                          F.max(F.col("q") / F.col("tokens")).alias("top"))
            good = {r["k"] for r in sums.where(passes).select("k").collect()}
            below = lo
            for k in range(lo + step, hi, step):
                if k not in good:
                    hi = k
                    break
                below = k
            lo = below
        return lo

    entropy = F.ln("z") - F.col("ql") / F.col("z")
    even = float(n)
    by_entropy = search(entropy >= target_entropy * F.ln(F.lit(even)) - 1e-9)
    budget = budget_share * float(total)
    repeats = F.lit(budget) * F.col("top") / F.col("z")
    over = search(repeats > max_repeats + 1e-9)
    tops = sources.agg(F.max(F.lit(budget / n) / F.col("tokens"))).first()[0]
    by_repeats = over + 1 if tops > max_repeats + 1e-9 else 0
    return max(by_entropy, by_repeats) / float(1 << STEPS)


def plan_sources(counts: DataFrame, target_entropy: float, max_repeats: float, budget_share: float,
                 block_tokens: int) -> DataFrame:
    """Per source: tokens, weight, quota, whole epochs, tokens left for the
    partial epoch, and number of blocks."""
    tokens = stored(counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    exponent = solve_exponent(tokens, target_entropy, max_repeats, budget_share)
    total = float(tokens.agg(F.sum("tokens")).first()[0] or 0)
    powers = tokens.withColumn("q", F.pow(F.col("tokens") / F.lit(total), F.lit(exponent)))
    z = powers.agg(F.sum("q")).first()[0] or 1.0
    return (powers.withColumn("weight", F.col("q") / F.lit(z))
            .withColumn("quota", F.floor(F.lit(budget_share) * F.lit(total) * F.col("weight") + F.lit(1e-6)).cast("long"))
            .select("source", "tokens", "weight", "quota", F.expr("quota div tokens").alias("epochs"),
                    F.expr("quota % tokens").alias("rest"),
                    F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / F.lit(float(block_tokens)))).cast("long").alias("blocks")))


def mix(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0,
        block_tokens: int = 20_000) -> DataFrame:
    """``doc_id, source, n_tokens, weight, epoch, block, place``: one row for each
    time a document is drawn; ordering by (epoch, place, doc_id) gives the mix.

    Sources without tokens are not drawn.  The budget is ``budget_share`` of all
    tokens; a source's draws in its partial epoch stop before the document that
    would pass its quota.  Documents without text are drawn with their block.
    Rows that repeat an id are counted and drawn one by one.  No rows give none."""
    counts = stored(token_counts(docs), "mix-counts")
    sources = stored(plan_sources(counts, target_entropy, max_repeats, budget_share, block_tokens), "mix-plan")
    same = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    left = counts.withColumn("k1", same[0]).withColumn("k2", same[1])
    right = sources.withColumn("k1", same[0]).withColumn("k2", same[1]).drop("source")
    dealt = left.join(small_side_of(right, sources), ["k1", "k2"]).withColumn("block", F.expr("pmod(deal, blocks)"))

    def place(epoch: Column) -> Column:
        return hash60(F.lit("block"), F.col("k1"), F.col("k2").cast("string"), epoch.cast("string"), F.col("block").cast("string"))

    # The partial epoch: blocks in its order until the quota is used up.  At most MAX_BLOCKS rows a source.
    blocks = (dealt.groupBy("k1", "k2", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("size"))
              .withColumn("place", place(F.col("epochs"))))
    run = Window.partitionBy("k1", "k2").orderBy("place", "block")
    blocks = blocks.withColumn("end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    cut = (blocks.withColumn("room", F.col("rest") - (F.col("end") - F.col("size")))
           .where("room > 0").select("k1", "k2", "block", "room", (F.col("end") <= F.col("rest")).alias("whole")))
    cut = stored(cut, "mix-blocks")
    drawn = dealt.join(small_side(cut), ["k1", "k2", "block"], "left")
    # Inside the one block of a source where the quota ends.
    inside = Window.partitionBy("k1", "k2", "block").orderBy("deal", "doc_id", "n_tokens")
    edge = (drawn.where("whole = false")
            .withColumn("used", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("extra", (F.col("used") <= F.col("room")).cast("long")).drop("used"))
    rest = drawn.where("whole IS NULL OR whole").withColumn("extra", F.coalesce(F.col("whole"), F.lit(False)).cast("long"))
    copies = rest.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra")).where("copies > 0")
    return (copies.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .select("doc_id", "source", "n_tokens", "weight", "epoch", "block", place(F.col("epoch")).alias("place")))


def small_side_of(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a projection of the stored ``table``, hinted by the table's size."""
    df.stored_path = table.stored_path
    return small_side(df)


def mix_oracle(target_entropy: float = 0.97, max_repeats: float = 4.0, budget_share: float = 1.0,
               block_tokens: int = 20_000) -> str:
    """The same mix in DuckDB SQL."""
    steps = float(1 << STEPS)
    entropy = ("ln(list_sum([pow(x / total, {k} / %r) for x in ts])) - list_sum([pow(x / total, {k} / %r) * ln(pow(x / total, {k} / %r)) for x in ts])"
               " / list_sum([pow(x / total, {k} / %r) for x in ts])" % (steps, steps, steps, steps))
    repeats = (f"{budget_share!r} * total * list_max([pow(x / total, {{k}} / {steps!r}) / x for x in ts])"
               f" / list_sum([pow(x / total, {{k}} / {steps!r}) for x in ts])")
    mid = "((lo + hi) // 2)"
    return f"""
WITH RECURSIVE counts AS (
  SELECT doc_id, source, coalesce(source, '') AS k1, source IS NULL AS k2,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || substr(md5('doc|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS deal
  FROM documents),
tokens AS (SELECT k1, k2, sum(n_tokens)::BIGINT AS tokens FROM counts GROUP BY 1, 2 HAVING sum(n_tokens) > 0),
one AS (SELECT list(tokens::DOUBLE ORDER BY k1, k2) AS ts, sum(tokens)::DOUBLE AS total, count(*) AS n FROM tokens),
h AS (SELECT 0 AS i, 0::BIGINT AS lo, {1 << STEPS}::BIGINT AS hi, ts, total, n FROM one UNION ALL
  SELECT i + 1, CASE WHEN ok THEN {mid} ELSE lo END, CASE WHEN ok THEN hi ELSE {mid} END, ts, total, n
  FROM (SELECT *, {entropy.format(k=mid)} >= {target_entropy!r} * ln(n::DOUBLE) - 1e-9 AS ok FROM h WHERE hi - lo > 1)),
r AS (SELECT 0 AS i, 0::BIGINT AS lo, {1 << STEPS}::BIGINT AS hi, ts, total, n FROM one UNION ALL
  SELECT i + 1, CASE WHEN ok THEN {mid} ELSE lo END, CASE WHEN ok THEN hi ELSE {mid} END, ts, total, n
  FROM (SELECT *, {repeats.format(k=mid)} > {max_repeats!r} + 1e-9 AS ok FROM r WHERE hi - lo > 1)),
e AS (SELECT CASE WHEN any_value(n) < 2 THEN 1.0 ELSE greatest((SELECT max(lo) FROM h),
        CASE WHEN list_max([{budget_share!r} * any_value(total) / any_value(n) / x for x in any_value(ts)]) > {max_repeats!r} + 1e-9
             THEN (SELECT max(lo) FROM r) + 1 ELSE 0 END) / {steps!r} END AS a FROM one),
powers AS (SELECT k1, k2, tokens, total, pow(tokens / total, a) AS q FROM tokens, one, e),
plan AS (SELECT *, quota // tokens AS epochs, quota % tokens AS rest,
    least({MAX_BLOCKS}, ceil(tokens / {float(block_tokens)!r}))::BIGINT AS blocks FROM (
  SELECT k1, k2, tokens, q / z AS weight, floor({budget_share!r} * total * (q / z) + 1e-6)::BIGINT AS quota
  FROM powers, (SELECT sum(q) AS z FROM powers))),
dealt AS (SELECT c.*, p.weight, p.epochs, p.rest, deal % blocks AS block FROM counts c JOIN plan p USING (k1, k2)),
bl AS (SELECT *, sum(size) OVER (PARTITION BY k1, k2 ORDER BY place, block ROWS UNBOUNDED PRECEDING) AS fin FROM (
  SELECT k1, k2, block, epochs, rest, sum(n_tokens) AS size,
    ('0x' || substr(md5('block|' || k1 || '|' || k2::VARCHAR || '|' || epochs::VARCHAR || '|' || block::VARCHAR), 1, 15))::BIGINT AS place
  FROM dealt GROUP BY ALL)),
drawn AS (SELECT d.*, b.size IS NOT NULL AS hit, b.fin <= b.rest AS whole, b.rest - (b.fin - b.size) AS room,
    sum(n_tokens) OVER (PARTITION BY k1, k2, d.block ORDER BY deal, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS used
  FROM dealt d LEFT JOIN (SELECT * FROM bl WHERE rest - (fin - size) > 0) b USING (k1, k2, block)),
copies AS (SELECT *, epochs + CASE WHEN hit AND (whole OR used <= room) THEN 1 ELSE 0 END AS copies FROM drawn)
SELECT doc_id, source, n_tokens, weight, epoch, block,
  ('0x' || substr(md5('block|' || k1 || '|' || k2::VARCHAR || '|' || epoch::VARCHAR || '|' || block::VARCHAR), 1, 15))::BIGINT AS place
FROM (SELECT *, unnest(range(0, copies)) AS epoch FROM copies)
"""
