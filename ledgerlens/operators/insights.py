"""Insight batch (FN-9..12, INS-1..5, TOP-2, SRC-11).

The service builds one org's context per request; here every org's context
is built in one job from the batched summaries: per org, at most 12 month
lines and one line per category, assembled with ``array_sort`` over the
org's already aggregated rows (never over its transactions).  Requests are
(org, type) rows produced with ``explode`` (no join), and the text generator
is a pluggable ``mapInPandas`` function that sees Arrow batches of requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import scaled_quotient_sql
from ..sources.sinks import enforce_contract
from ..schemas import (AI_INSIGHTS, CONTEXT_CATEGORY_HEADER, CONTEXT_MONTH_HEADER, DEFAULT_INSIGHT_TYPE,
                       INSIGHT_PROMPTS, INSIGHT_TYPES, LATEST_INSIGHTS, PLACEHOLDER_CONTENT,
                       PLACEHOLDER_TITLE, TITLE_LENGTH)
from .staging import for_tenant
from .tenancy import org_summaries_all

Generator = Callable[[pd.DataFrame], pd.DataFrame]


def money_text(col: str) -> Column:
    """``%.2f`` of a 2-place money value (decimal text, no float rounding)."""
    return F.expr(f"cast(cast({col} as decimal(38,2)) as string)")


# The layouts of the context's month and category lines.
def month_line(month: str = "month", revenue: str = "revenue", volume: str = "volume") -> Column:
    """FN-9: ``"  <month>: CAD $<revenue> (<n> transactions)\\n"``."""
    return F.concat(F.lit("  "), F.col(month), F.lit(": CAD $"), money_text(revenue),
                    F.lit(" ("), F.col(volume).cast("string"), F.lit(" transactions)\n"))


def category_line(category: str = "category", revenue: str = "revenue", volume: str = "volume") -> Column:
    """FN-9: ``"  <category>: CAD $<revenue> (<n> txns, avg $<avg>)\\n"``; the
    average is revenue / volume rounded once to cents."""
    avg2 = F.expr(f"cast({scaled_quotient_sql(revenue, volume, 2)} as string)")
    return F.concat(F.lit("  "), F.col(category), F.lit(": CAD $"), money_text(revenue),
                    F.lit(" ("), F.col(volume).cast("string"), F.lit(" txns, avg $"), avg2, F.lit(")\n"))


def _ordered_text(rank_col: str, line: Column, when: Column | None = None) -> Column:
    """Concatenate an org's lines in rank order (only the rows where ``when`` holds).

    An org has at most ``CONTEXT_MONTHS`` month lines and one line per distinct
    category of its own."""
    item = F.struct(F.col(rank_col).alias("r"), line.alias("t"))
    lines = F.array_sort(F.collect_list(item if when is None else F.when(when, item)))
    return F.array_join(F.transform(lines, lambda x: x["t"]), "")


def insight_context(tx: DataFrame) -> DataFrame:
    """INS-1: one ``(org_id, n_months, context)`` row per org that has completed months.

    Month and category figures come from one grouping-sets pass over the
    transactions (:func:`org_summaries_all`), and each org's text is put
    together by one grouped ``collect_list`` over at most 12 month rows and
    one row per category.  Orgs without a readable completed month get no
    row (INS-2), exactly as the service answers 404 for them."""
    rows = org_summaries_all(tx)
    is_month = F.col("is_month")
    per_org = (rows.groupBy("org_id")
               .agg(_ordered_text("month_rank", month_line(), is_month).alias("month_text"),
                    _ordered_text("category_rank", category_line(), ~is_month).alias("category_text"),
                    F.count_if(is_month).alias("n_months"))
               .where(F.col("n_months") > 0))
    return per_org.select(
        "org_id", "n_months",
        F.concat(F.lit(CONTEXT_MONTH_HEADER), F.col("month_text"), F.lit(CONTEXT_CATEGORY_HEADER),
                 F.col("category_text")).alias("context"))


def eligible_orgs(orgs: DataFrame, context: DataFrame, org_key: str = "id") -> DataFrame:
    """INS-2: every org with a flag telling whether it gets insights."""
    have = context.select("org_id", "n_months")
    return (orgs.select(F.col(org_key).alias("org_id")).join(have, "org_id", "left")
            .select("org_id", F.coalesce("n_months", F.lit(0)).alias("n_months"),
                    F.col("n_months").isNotNull().alias("eligible")))


def prompt_for(type_col: Column) -> Column:
    """FN-10: prompt text by insight type; unknown types use the summary prompt."""
    prompts = F.create_map(*[x for k, v in INSIGHT_PROMPTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(prompts, type_col), F.lit(INSIGHT_PROMPTS[DEFAULT_INSIGHT_TYPE]))


def insight_requests(context: DataFrame, types: list[str] | None = None) -> DataFrame:
    """INS-3: one request per (org, type).  An empty type becomes the default
    type; an unknown type keeps its label but gets the summary prompt."""
    types = list(INSIGHT_TYPES if types is None else types)
    typed = context.withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))
    typed = typed.withColumn("type", F.when((F.col("type").isNull()) | (F.col("type") == ""),
                                            F.lit(DEFAULT_INSIGHT_TYPE)).otherwise(F.col("type")))
    return typed.select(
        "org_id", "type", prompt_for(F.col("type")).alias("prompt"), F.col("context").alias("data"),
        F.concat(prompt_for(F.col("type")), F.lit("\n\nData:\n"), F.col("context")).alias("user_message"))


def placeholder_insights(requests: DataFrame) -> DataFrame:
    """INS-4 without a generator: the fixed 'unavailable' insight, confidence 0
    (it is stored like any other insight)."""
    return requests.select(
        "org_id", "type", F.lit(PLACEHOLDER_TITLE).alias("title"), F.lit(PLACEHOLDER_CONTENT).alias("content"),
        F.lit(0).cast("decimal(5,4)").alias("confidence"))


def generate_insights(requests: DataFrame, generator: Generator | None = None) -> DataFrame:
    """INS-4: run ``generator`` over batches of requests.

    ``generator(batch) -> DataFrame`` receives a pandas frame with
    ``org_id, type, prompt, data, user_message`` and returns one ``response``
    text (the model's JSON) per input row, in order.  Without a generator the
    placeholder insight is returned.  The result of a generator run is the raw
    ``(org_id, type, response)``; pass it to :func:`split_insights`."""
    if generator is None:
        return placeholder_insights(requests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = generator(batch)
            responses = out["response"] if isinstance(out, pd.DataFrame) else pd.Series(out)
            yield pd.DataFrame({"org_id": batch["org_id"].values, "type": batch["type"].values,
                                "response": responses.astype(object).values})

    return requests.mapInPandas(run, "org_id string, type string, response string")


_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_insight_json(text_col: Column) -> Column:
    """FN-11: parse ``{"title", "content", "confidence"}``.

    Returns a struct ``(valid, title, content, confidence)``.  The whole text
    must be one JSON object (or ``null``, which has no fields); a field of the
    wrong type makes it invalid.  Field names match ignoring case, the last of
    several matches counts, missing and null fields become ''/0 and other
    fields are ignored; ``confidence`` is ``decimal(5,4)`` and null when the
    number does not fit (such an insight is not stored)."""
    # Between brackets the text must be exactly one element, and as a field's value it must end the object.
    elements = F.from_json(F.concat(F.lit("["), text_col, F.lit("]")), "array<map<string,variant>>", _STRICT_JSON)
    alone = F.from_json(F.concat(F.lit('{"x":'), text_col, F.lit("}")), "map<string,string>", _STRICT_JSON)
    whole = alone.isNotNull() & (F.size(F.map_keys(alone)) == 1) & (F.size(elements) == 1)
    entries = F.coalesce(F.map_entries(F.get(elements, F.lit(0))), F.array())

    def given(name: str) -> Column:
        return F.filter(entries, lambda e: F.lower(e["key"]) == name)

    def kind(e: Column) -> Column:
        return F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))

    def typed(name: str, pattern: str) -> Column:
        return F.forall(given(name), lambda e: kind(e).rlike(f"^(VOID|{pattern})"))

    def last(name: str, target: str) -> Column:
        values = F.transform(F.filter(given(name), lambda e: kind(e) != "VOID"), lambda e: F.try_variant_get(e["value"], "$", target))
        return F.try_element_at(values, F.lit(-1))

    numbers = "BIGINT|DECIMAL|DOUBLE|FLOAT"
    valid = F.coalesce(whole & typed("title", "STRING") & typed("content", "STRING") & typed("confidence", numbers), F.lit(False))
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.coalesce(last("title", "string"), F.lit(""))).alias("title"),
        F.when(valid, F.coalesce(last("content", "string"), F.lit(""))).alias("content"),
        F.when(valid, F.coalesce(last("confidence", "double"), F.lit(0.0)).try_cast("decimal(5,4)")).alias("confidence"))


def split_insights(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """INS-5: parsed insights with ``stored``: valid JSON whose confidence
    fits ``NUMERIC(5,4)`` and whose title fits its column.  Filter on
    ``stored`` for the good rows and on ``~stored`` for the failures."""
    parsed = responses.withColumn("_p", parse_insight_json(F.col(text_col)))
    return (parsed.select(*[c for c in responses.columns if c != text_col],
                          F.col("_p.valid").alias("valid_json"), F.col("_p.title").alias("title"),
                          F.col("_p.content").alias("content"), F.col("_p.confidence").alias("confidence"))
            .withColumn("stored", F.col("valid_json") & F.col("confidence").isNotNull() & (F.char_length("title") <= TITLE_LENGTH)))


def latest_insights(insights: DataFrame, org_id: str, n: int = LATEST_INSIGHTS) -> DataFrame:
    """TOP-2: an org's newest ``n`` insights; null confidence reads as 0 and
    ``total`` is the number of rows returned."""
    top = (for_tenant(insights, org_id).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n))
    return (top.select("id", "org_id", "type", "title", "content",
                       F.coalesce("confidence", F.lit(0)).cast("decimal(5,4)").alias("confidence"),
                       "created_at")
            .withColumn("total", F.count(F.lit(1)).over(Window.partitionBy())))


def latest_insights_all(insights: DataFrame, n: int = LATEST_INSIGHTS) -> DataFrame:
    """TOP-2 for every org: ``row_number`` per org ≤ n, which Spark plans as a
    partial per-partition limit before the shuffle (so a busy org ships at
    most ``n`` rows per input partition)."""
    w = Window.partitionBy("org_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = insights.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return (top.select("id", "org_id", "type", "title", "content",
                       F.coalesce("confidence", F.lit(0)).cast("decimal(5,4)").alias("confidence"),
                       "created_at", F.col("_rn").alias("position"))
            .withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("org_id"))))


def store_columns(insights: DataFrame, created_at=None) -> DataFrame:
    """SRC-11: insights with the stored columns only; ``run_id`` and ``metadata``
    stay null and confidence is ``decimal(5,4)``.  Rows that :func:`split_insights`
    marked as not stored are left out; a null in a NOT NULL column fails the job."""
    ts = F.current_timestamp().cast("timestamp_ntz") if created_at is None \
        else F.lit(created_at).cast("timestamp_ntz")
    good = insights.where("stored") if "stored" in insights.columns else insights
    out = good.select(
        F.expr("uuid()").alias("id"), "org_id", F.lit(None).cast("string").alias("run_id"), "type", "title",
        "content", F.col("confidence").try_cast("decimal(5,4)").alias("confidence"),
        F.lit(None).cast("string").alias("metadata"), ts.alias("created_at"))
    return enforce_contract(out, AI_INSIGHTS, {"type": 100, "title": TITLE_LENGTH})


def store_insights(insights: DataFrame, path: str, created_at=None) -> None:
    """SRC-11: append insights to the stored ones (:func:`store_columns`)."""
    store_columns(insights, created_at).write.mode("append").parquet(path)
