"""Insight batch queries (FN-9..12, INS-1..5, TOP-2)."""

from __future__ import annotations

from ..operators import insights as IN
from ..schemas import (CONTEXT_MONTHS, DEFAULT_INSIGHT_TYPE, INSIGHT_PROMPTS, INSIGHT_TYPES,
                       LATEST_INSIGHTS, PLACEHOLDER_CONTENT, PLACEHOLDER_TITLE)
from ..sources import fixtures as FX
from .marts import TENANT
from .oracle import CTE_INSIGHTS, CTE_ORGS, CTE_TX, d_quotient, with_ctes
from .registry import register
from .tenancy import CATEGORIES_ALL_SQL, CTE_ALL_ORGS, MONTHLY_ALL_SQL, q_insert_if_absent

# Request types of the prompt query: the three known types, an unknown one
# and an empty one (which becomes the default type).
REQUEST_TYPES = ["summary", "anomaly", "recommendation", "forecast", ""]


def _sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _nl(s: str) -> str:
    """DuckDB text with real newlines."""
    return " || chr(10) || ".join(_sq(p) for p in s.split("\n"))


CTE_CONTEXT = f"""months AS ({MONTHLY_ALL_SQL.replace(f'<= 12', f'<= {CONTEXT_MONTHS}')}),
cats AS ({CATEGORIES_ALL_SQL}),
mtext AS (
  SELECT org_id, count(*) AS n_months,
         string_agg('  ' || month || ': CAD $' || cast(revenue AS VARCHAR) || ' ('
                    || cast(volume AS VARCHAR) || ' transactions)' || chr(10), '' ORDER BY month_rank)
           AS month_text
  FROM months GROUP BY org_id),
ctext AS (
  SELECT org_id,
         string_agg('  ' || category || ': CAD $' || cast(revenue AS VARCHAR) || ' ('
                    || cast(volume AS VARCHAR) || ' txns, avg $'
                    || cast({d_quotient('revenue', 'volume', 2)} AS VARCHAR) || ')' || chr(10), ''
                    ORDER BY category_rank) AS category_text
  FROM cats GROUP BY org_id),
context AS (
  SELECT m.org_id, m.n_months,
         {_nl('Monthly revenue data:' + chr(10))} || m.month_text
           || {_nl(chr(10) + 'Category breakdown:' + chr(10))} || coalesce(c.category_text, '') AS context
  FROM mtext m LEFT JOIN ctext c ON m.org_id = c.org_id)"""

PROMPT_CASE = ("CASE type " + " ".join(f"WHEN {_sq(k)} THEN {_sq(v)}" for k, v in INSIGHT_PROMPTS.items()) +
               f" ELSE {_sq(INSIGHT_PROMPTS[DEFAULT_INSIGHT_TYPE])} END")


def _requests_sql(types: list[str]) -> str:
    arr = "[" + ", ".join(_sq(t) for t in types) + "]"
    return f"""requests AS (
  SELECT org_id, CASE WHEN t = '' OR t IS NULL THEN {_sq(DEFAULT_INSIGHT_TYPE)} ELSE t END AS type, context
  FROM context, unnest({arr}) AS u(t))"""


def _context(spark, sf_dir):
    return IN.insight_context(FX.tx(spark, sf_dir))


@register("insight_context", with_ctes(CTE_TX, CTE_CONTEXT) + "SELECT org_id, n_months, context FROM context")
def q_insight_context(spark, sf_dir):
    """INS-1 / FN-9: the data context text of every eligible org."""
    return _context(spark, sf_dir)


@register("insight_eligible_orgs", with_ctes(CTE_TX, CTE_CONTEXT, CTE_ORGS, CTE_ALL_ORGS) + """
SELECT a.id AS org_id, coalesce(c.n_months, 0) AS n_months, c.n_months IS NOT NULL AS eligible
FROM all_orgs a LEFT JOIN context c ON a.id = c.org_id""")
def q_insight_eligible_orgs(spark, sf_dir):
    """INS-2: which orgs (stored and newly inserted) get insights."""
    return IN.eligible_orgs(q_insert_if_absent(spark, sf_dir), _context(spark, sf_dir))


@register("insight_prompts", with_ctes(CTE_TX, CTE_CONTEXT, _requests_sql(REQUEST_TYPES)) + f"""
SELECT org_id, type, {PROMPT_CASE} AS prompt, context AS data,
       {PROMPT_CASE} || chr(10) || chr(10) || 'Data:' || chr(10) || context AS user_message
FROM requests""")
def q_insight_prompts(spark, sf_dir):
    """INS-3 / FN-10: (org, type) requests with their prompts."""
    return IN.insight_requests(_context(spark, sf_dir), REQUEST_TYPES)


@register("insights_placeholder", with_ctes(CTE_TX, CTE_CONTEXT, _requests_sql(INSIGHT_TYPES)) + f"""
SELECT org_id, type, {_sq(PLACEHOLDER_TITLE)} AS title, {_sq(PLACEHOLDER_CONTENT)} AS content,
       cast(0 AS DECIMAL(5,4)) AS confidence
FROM requests""")
def q_insights_placeholder(spark, sf_dir):
    """INS-4 without a generator: the stored 'unavailable' insight per request."""
    return IN.generate_insights(IN.insight_requests(_context(spark, sf_dir)))


# Model-style answers by event: wrong types, trailing words, other-case keys,
# null, an array, raw props (fields missing, extra fields), text that is no
# JSON, a confidence out of range, and well-formed answers.
RESPONSES_SQL = """responses AS (
  SELECT event_id, cast(event_id AS VARCHAR) AS id, cast(user_id AS VARCHAR) AS org_id, event_type AS type, user_id, props,
         event_id % 17 AS k17, event_id % 5 AS k5, event_id % 13 = 0 AS far
  FROM events)"""


def _responses(spark, sf_dir):
    ev = FX.read_parquet_table(spark, sf_dir, "events")
    return ev.selectExpr(
        "cast(event_id as string) AS id", "cast(user_id as string) AS org_id", "event_type AS type",
        """CASE WHEN event_id % 17 = 0 THEN '{"title": "t", "content": "c", "confidence": "high"}'
             WHEN event_id % 17 = 1 THEN '{"title": 5, "content": "c"}'
             WHEN event_id % 17 = 2 THEN '{"title": "t", "content": "c"} and more'
             WHEN event_id % 17 = 3 THEN concat('{"Title": "', event_type, '", "CONTENT": "c", "Confidence": 0.5}')
             WHEN event_id % 17 = 4 THEN ' null '
             WHEN event_id % 17 = 5 THEN '[{"title": "t"}]'
             WHEN event_id % 17 = 6 THEN '{"title": null, "content": "only content", "title": "last"}'
             WHEN event_id % 5 = 0 THEN props
             WHEN event_id % 5 = 1 THEN concat('not json ', event_type)
             WHEN event_id % 13 = 0 THEN to_json(named_struct('title', event_type,
               'content', concat('user ', cast(user_id as string)), 'confidence', 12))
             ELSE to_json(named_struct('title', event_type, 'content', concat('user ', cast(user_id as string)),
               'confidence', cast(event_id % 10000 as double) / 10000.0D, 'extra', value)) END AS response""")


# The expected outcome of each kind of answer, stated outright (props is an
# object without the three fields).
@register("parse_insight_json", with_ctes(RESPONSES_SQL) + """
SELECT id, org_id, type, valid_json, title, content, confidence, valid_json AND confidence IS NOT NULL AS stored
FROM (SELECT id, org_id, type,
        k17 IN (3, 4, 6) OR (k17 > 6 AND k5 <> 1) AS valid_json,
        CASE WHEN k17 IN (0, 1, 2, 5) THEN NULL WHEN k17 = 3 THEN type WHEN k17 = 4 THEN '' WHEN k17 = 6 THEN 'last'
             WHEN k5 = 0 THEN '' WHEN k5 = 1 THEN NULL ELSE type END AS title,
        CASE WHEN k17 IN (0, 1, 2, 5) THEN NULL WHEN k17 = 3 THEN 'c' WHEN k17 = 4 THEN '' WHEN k17 = 6 THEN 'only content'
             WHEN k5 = 0 THEN '' WHEN k5 = 1 THEN NULL ELSE 'user ' || cast(user_id AS VARCHAR) END AS content,
        cast(CASE WHEN k17 IN (0, 1, 2, 5) THEN NULL WHEN k17 = 3 THEN 0.5 WHEN k17 IN (4, 6) THEN 0
             WHEN k5 = 0 THEN 0 WHEN k5 = 1 OR far THEN NULL ELSE cast(event_id % 10000 AS DOUBLE) / 10000.0 END AS DECIMAL(5,4)) AS confidence
      FROM responses)""")
def q_parse_insight_json(spark, sf_dir):
    """FN-11 / INS-5: parse generator answers and flag which are stored."""
    return IN.split_insights(_responses(spark, sf_dir))


@register("latest_insights", with_ctes(CTE_INSIGHTS) + f"""
SELECT id, org_id, type, title, content, cast(coalesce(confidence, 0) AS DECIMAL(5,4)) AS confidence,
       created_at, count(*) OVER () AS total
FROM (SELECT * FROM insights WHERE org_id = '{TENANT}' ORDER BY created_at DESC, id DESC
      LIMIT {LATEST_INSIGHTS})""")
def q_latest_insights(spark, sf_dir):
    """TOP-2 / FN-12: one org's newest insights."""
    return IN.latest_insights(FX.insights(spark, sf_dir), TENANT)


@register("latest_insights_all", with_ctes(CTE_INSIGHTS) + f"""
SELECT id, org_id, type, title, content, cast(coalesce(confidence, 0) AS DECIMAL(5,4)) AS confidence,
       created_at, position, count(*) OVER (PARTITION BY org_id) AS total
FROM (SELECT *, cast(row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, id DESC) AS INTEGER)
             AS position FROM insights)
WHERE position <= {LATEST_INSIGHTS}""")
def q_latest_insights_all(spark, sf_dir):
    """TOP-2 for every org."""
    return IN.latest_insights_all(FX.insights(spark, sf_dir))
