"""The driver's tables as messages, tags, sessions, price lists and bills.

The statements run unchanged on Spark and DuckDB, so a query and its SQL twin start from the same
rows. Relations are named in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES = """
SELECT 'm' || CAST(event_id AS STRING) AS id,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE 's' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) END AS session_id,
       CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS role,
       ts AS timestamp,
       CASE WHEN event_type = 'view' THEN NULL
            WHEN event_id % 9 = 0 THEN 'claude-opus-4-6' WHEN event_id % 9 = 1 THEN 'claude-sonnet-4-5' WHEN event_id % 9 = 2 THEN 'gpt-5.3-codex'
            WHEN event_id % 9 = 3 THEN 'claude-haiku-4.5' WHEN event_id % 9 = 4 THEN 'mystery-model' WHEN event_id % 9 = 5 THEN ''
            WHEN event_id % 9 = 6 THEN '<synthetic>' WHEN event_id % 9 = 7 THEN NULL ELSE 'claude-sonnet-4-5' END AS model,
       CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
       CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 3) AS BIGINT) END AS output_tokens,
       CASE WHEN event_type = 'view' THEN 0 ELSE (event_id % 5) * 100 END AS cache_creation_tokens,
       CASE WHEN event_type = 'view' THEN 0 ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 50 END AS cache_read_tokens,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE '/w/u' || CAST(user_id % 7 AS STRING) || '/p' || CAST(event_id % 3 AS STRING) END AS cwd,
       CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 6 = 1 THEN '' WHEN user_id % 6 = 2 THEN 'unknown'
            ELSE 'github.com/acme/r' || CAST(user_id % 6 AS STRING) END AS repo_id,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'claude_code' WHEN user_id % 4 = 1 THEN 'codex'
            WHEN user_id % 4 = 2 THEN 'cursor' ELSE 'copilot_chat' END AS provider,
       CASE WHEN event_id % 10 = 0 AND event_id > 0 THEN 'm' || CAST(event_id - 1 AS STRING) END AS parent_uuid,
       CASE WHEN event_id % 8 = 0 THEN 'main' WHEN event_id % 8 = 1 THEN 'refs/heads/PAVA-12-login' WHEN event_id % 8 = 2 THEN 'fix/1234-typo'
            WHEN event_id % 8 = 3 THEN 'chore/sweep-2' WHEN event_id % 8 = 4 THEN '03-20-pava-2120_desc' WHEN event_id % 8 = 5 THEN ''
            WHEN event_id % 8 = 6 THEN NULL ELSE 'eng-7/chore/sweep-9' END AS git_branch,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'exact' WHEN event_id % 4 = 1 THEN 'estimated'
            WHEN event_id % 4 = 2 THEN 'otel_exact' ELSE 'estimated_unknown_model' END AS cost_confidence,
       CASE WHEN event_type = 'view' THEN NULL ELSE 'r' || CAST(event_id - event_id % 3 AS STRING) END AS request_id,
       CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN '' WHEN event_id % 6 = 2 THEN 'VSCode'
            WHEN event_id % 6 = 3 THEN 'cursor' WHEN event_id % 6 = 4 THEN 'jetbrains' ELSE 'terminal' END AS surface,
       CASE WHEN event_id % 19 = 0 THEN 'fast' WHEN event_id % 19 < 9 THEN 'standard' END AS speed,
       CASE WHEN event_type = 'view' THEN 0 WHEN event_id % 21 = 0 THEN 600 ELSE (event_id % 5) * (event_id % 3) * 50 END AS cache_creation_1h_tokens,
       CASE WHEN event_type <> 'view' AND event_id % 14 = 0 THEN event_id % 4 ELSE 0 END AS web_search_requests,
       CASE WHEN event_type <> 'view' AND event_id % 4 IN (0, 2) AND event_id % 17 <> 0 AND event_id % 3 <> 1 THEN CAST(event_id % 1000 AS DOUBLE) / 8e0 END AS cost_cents_ingested
FROM {events}
"""

#: USD per token. Our own test data.
PRICES = """
SELECT 'claude-opus-4-6' AS model, 0.000005e0 AS input_cost_per_token, 0.000025e0 AS output_cost_per_token, 0.00000625e0 AS cache_creation_input_token_cost, 0.0000005e0 AS cache_read_input_token_cost
UNION ALL SELECT 'claude-sonnet-4-5', 0.000003e0, 0.000015e0, 0.00000375e0, 0.0000003e0
UNION ALL SELECT 'gpt-5.3-codex', 0.00000175e0, 0.000014e0, CAST(NULL AS DOUBLE), 0.000000175e0
UNION ALL SELECT 'claude-haiku-4-5', 0.000001e0, 0.000005e0, 0.00000125e0, 0.0000001e0
"""

ALIASES = "SELECT 'claude-haiku-4.5' AS alias, 'claude-haiku-4-5' AS canonical"

TAGS = """
SELECT id AS message_id, k AS key, v AS value FROM (
  SELECT id, 'ticket_id' AS k, CASE WHEN e % 8 = 1 THEN 'PAVA-12' WHEN e % 8 = 2 THEN '1234' WHEN e % 8 = 4 THEN 'PAVA-2120' WHEN e % 8 = 7 THEN 'ENG-7' END AS v FROM {numbered}
  UNION ALL SELECT id, 'ticket_id', CASE WHEN e % 5 = 0 THEN 'OPS-' || CAST(e % 3 AS STRING) END FROM {numbered}
  UNION ALL SELECT id, 'ticket_source', CASE WHEN e % 8 IN (1, 4, 7) THEN 'branch' WHEN e % 8 = 2 THEN 'branch_numeric' END FROM {numbered}
  UNION ALL SELECT id, 'activity', CASE WHEN e % 6 = 0 THEN 'bugfix' WHEN e % 6 = 1 THEN 'feature' WHEN e % 6 = 2 THEN 'review' WHEN e % 6 = 3 THEN 'ops' END FROM {numbered}
  UNION ALL SELECT id, 'activity', CASE WHEN e % 12 = 0 THEN 'testing' END FROM {numbered}
  UNION ALL SELECT id, 'activity_source', CASE WHEN e % 6 < 4 THEN 'rule' END FROM {numbered}
  UNION ALL SELECT id, 'activity_confidence', CASE WHEN e % 6 < 2 THEN 'high' WHEN e % 6 < 4 THEN 'medium' END FROM {numbered}
  UNION ALL SELECT id, 'file_path', CASE WHEN e % 3 <> 0 THEN 'src/f' || CAST(e % 11 AS STRING) || '.py' END FROM {numbered}
  UNION ALL SELECT id, 'file_path', CASE WHEN e % 4 = 0 THEN 'lib/g' || CAST(e % 5 AS STRING) || '.rs' END FROM {numbered}
  UNION ALL SELECT id, 'file_path_source', CASE WHEN e % 3 <> 0 THEN 'tool_arg' WHEN e % 4 = 0 THEN 'cwd_relative' END FROM {numbered}
  UNION ALL SELECT id, 'file_path_confidence', CASE WHEN e % 3 <> 0 THEN 'high' WHEN e % 4 = 0 THEN 'medium' END FROM {numbered}
  UNION ALL SELECT id, 'tool', CASE WHEN e % 2 = 0 THEN 'Edit' ELSE 'Bash' END FROM {numbered}
  UNION ALL SELECT id, 'session_title', CASE WHEN e % 7 < 3 THEN 'Title ' || CAST(e % 7 AS STRING) END FROM {numbered}
) x WHERE v IS NOT NULL
"""

NUMBERED = "SELECT 'm' || CAST(event_id AS STRING) AS id, event_id AS e FROM {events} WHERE event_type <> 'view'"

TOOL_EVENTS = """
SELECT 's' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, event_id AS seq, ts,
       CASE WHEN event_type = 'click' THEN 'post_tool_use' WHEN event_type = 'error' THEN 'post_tool_use_failure'
            WHEN event_type = 'view' THEN 'user_prompt_submit' ELSE 'pre_compact' END AS event,
       'tool' || CAST(user_id % 3 AS STRING) AS tool_name
FROM {events}
"""

BILL = """
SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS model, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DOUBLE) AS amount_in_cents
FROM {orders} GROUP BY CAST(o_orderdate AS DATE), o_orderpriority
"""


def _run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    return spark.sql(sql, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced messages: the adapter's rows with cost_cents_ingested, cost_cents_effective and pricing_source."""
    from ..operators.pricing import priced

    return priced(raw_messages(spark, sf_dir), prices(spark), aliases(spark))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, MESSAGES, events=table(spark, sf_dir, "events"))


def prices(spark: SparkSession) -> DataFrame:
    return spark.sql(PRICES)


def aliases(spark: SparkSession) -> DataFrame:
    return spark.sql(ALIASES)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, TAGS, numbered=_run(spark, NUMBERED, events=table(spark, sf_dir, "events")))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, TOOL_EVENTS, events=table(spark, sf_dir, "events"))


def bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, BILL, orders=table(spark, sf_dir, "orders"))


#: Common table expressions of the SQL twins, in dependency order.
_LONG = "least(coalesce(b.cache_creation_1h_tokens, 0), cache_creation_tokens)"
_COST = f"""CASE WHEN b.cost_cents_ingested IS NOT NULL THEN b.cost_cents_ingested WHEN role <> 'assistant' THEN 0e0 WHEN p.model IS NULL THEN 0e0 ELSE
 ((input_tokens * (p.input_cost_per_token * 1e6) + output_tokens * (p.output_cost_per_token * 1e6) + (cache_creation_tokens - {_LONG}) * (coalesce(p.cache_creation_input_token_cost, 0e0) * 1e6)
 + cache_read_tokens * (coalesce(p.cache_read_input_token_cost, 0e0) * 1e6) + {_LONG} * (p.input_cost_per_token * 1e6) * 2) / 1e6 * CASE WHEN b.speed = 'fast' THEN 6 ELSE 1 END + b.web_search_requests * 0.01e0) * 100e0 END"""
_SOURCE = """CASE WHEN b.cost_cents_ingested IS NOT NULL THEN 'upstream:api' WHEN role = 'assistant' AND p.model IS NOT NULL THEN CASE WHEN a.alias IS NULL THEN 'manifest:v1' ELSE 'manifest:v1:alias' END WHEN role = 'assistant' THEN 'unknown'
 WHEN input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens = 0 THEN 'unpriced:no_tokens' END"""
_SURE = """CASE WHEN role <> 'assistant' THEN nullif(b.cost_confidence, '') WHEN b.cost_cents_ingested IS NOT NULL THEN coalesce(nullif(b.cost_confidence, ''), 'estimated') WHEN p.model IS NOT NULL THEN 'estimated' ELSE 'estimated_unknown_model' END"""
CTES = {
    "base": MESSAGES.format(events="events"),
    "price": PRICES,
    "alias": ALIASES,
    "msg": f"""
SELECT b.* EXCLUDE (cost_cents_ingested, cost_confidence), {_SOURCE} AS pricing_source, {_SURE} AS cost_confidence, round({_COST}, 8) AS cost_cents_ingested, round({_COST}, 8) AS cost_cents_effective, CAST(round({_COST}, 8) AS DECIMAL(20,8)) AS cents,
       coalesce(nullif(b.provider, ''), 'claude_code') AS d_provider,
       CASE WHEN b.model IS NULL OR b.model = '' OR starts_with(b.model, '<') THEN '(untagged)' ELSE b.model END AS d_model,
       CASE WHEN repo_id IS NULL OR repo_id IN ('', 'unknown') THEN '(untagged)' ELSE repo_id END AS d_project,
       CASE WHEN git_branch IS NULL OR regexp_replace(git_branch, '^refs/heads/', '') = '' THEN '(untagged)' ELSE regexp_replace(git_branch, '^refs/heads/', '') END AS d_branch,
       coalesce(nullif(lower(surface), ''), 'unknown') AS d_surface
FROM base b LEFT JOIN alias a ON b.model = a.alias LEFT JOIN price p ON p.model = coalesce(a.canonical, b.model)
""",
    "asst": "SELECT * FROM msg WHERE role = 'assistant'",
    "tags": TAGS.replace("{numbered}", "(" + NUMBERED.format(events="events") + ") n"),
}


def with_ctes(sql: str, *extra: tuple[str, str]) -> str:
    """``sql`` behind the common table expressions that it, or one it needs, names."""
    import re

    need, text = [], sql + " ".join(x for _, x in extra)
    for name in reversed(CTES):
        if re.search(rf"\b{name}\b", text):
            need.append(name)
            text += CTES[name]
    parts = [f"{n} AS ({CTES[n]})" for n in reversed(need)] + [f"{n} AS ({x})" for n, x in extra]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
