"""Registered queries of parsers, price lists, tags and repairs that the other modules leave out, with their SQL twins.

Records are made of the driver's tables on the fly, by expressions that run on both engines."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.dims import DimFilters, TimeWindow, since_of
from ..operators import breakdowns as b
from ..operators import enrich as e
from ..operators import exports as x
from ..operators import health as h
from ..operators import merge as m
from ..operators import pricing as p
from ..operators import rollups as r
from ..operators import sessions as l
from ..sources import transcripts as src
from . import adapters as a
from . import breakdowns, sessions, upkeep
from .adapters import with_ctes
from .breakdowns import COST, SUMS
from .feeds import _I, _TS, _lines

Q, SQL = {}, {}


def query(name, sql=None, *extra):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_ctes(sql, *extra)
        return f

    return add


def _made(s, d, sql: str, source: str = "events"):
    """A frame made of a table, named ``{e}`` in the statement."""
    return s.sql(sql, e=a.table(s, d, source))


# files and transcript records
_RAW = "SELECT 'f' || CAST(user_id AS STRING) AS file, CASE WHEN event_id % 10 = 0 THEN '  ' ELSE 'v' || CAST(event_id AS STRING) END AS value, event_id AS block, user_id % 2 AS odd FROM {e}"
query(
    "s01_numbered_lines",
    f"SELECT file, line_no, value FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY block) - 1 AS line_no, lead(block) OVER (PARTITION BY file ORDER BY block) IS NULL AND odd = 1 AS open FROM ({_RAW.format(e='events')})) WHERE NOT open AND trim(value) <> ''",
)(lambda s, d: src.numbered(s.sql("SELECT file, value, block, block AS at, sum(octet_length(value) + 1) OVER (PARTITION BY file) - odd AS size FROM {raw}", raw=_made(s, d, _RAW))))
_PAIR = lambda i, o: f"'\"{i}\":' || CAST(event_id % 50 AS STRING) || ',\"{o}\":' || CAST(event_id % 7 AS STRING)"
_SHAPES = f"""CASE event_id % 6 WHEN 0 THEN '{{"result":{{"metadata":{{' || {_PAIR('promptTokens', 'outputTokens')} || '}}}}}}' WHEN 1 THEN '{{"result":{{"usage":{{' || {_PAIR('promptTokens', 'completionTokens')} || '}}}}}}'
WHEN 2 THEN '{{"usage":{{' || {_PAIR('prompt_tokens', 'completion_tokens')} || '}}}}' WHEN 3 THEN '{{' || {_PAIR('promptTokens', 'completionTokens')} || '}}' WHEN 4 THEN '{{"completionTokens":' || CAST(event_id % 7 AS STRING) || '}}'
ELSE '{{"result":{{"metadata":{{"promptTokens":0,"outputTokens":0}}}},"usage":{{' || {_PAIR('prompt_tokens', 'completion_tokens')} || '}}}}' END"""
query(
    "s10_request_shapes",
    """SELECT event_id, CASE WHEN i > 0 AND n <> 4 THEN i ELSE 0 END AS input_tokens, o AS output_tokens FROM (SELECT event_id, event_id % 6 AS n, event_id % 50 AS i, event_id % 7 AS o FROM events) WHERE o > 0 AND (n IN (3, 4) OR i > 0)""",
)(lambda s, d: _lines(s, d, _SHAPES).withColumn("v", F.try_parse_json("value")).withColumn("k", src.request_tokens()).where("k IS NOT NULL").select(F.col("line_no").alias("event_id"), F.col("k.i").alias("input_tokens"), F.col("k.o").alias("output_tokens")))
_CHOICES = """'{"modelId":"' || CASE event_id % 4 WHEN 0 THEN 'copilot/m1' WHEN 1 THEN 'auto' WHEN 2 THEN '' ELSE 'github.copilot-chat/m2' END || '"' || CASE event_id % 3 WHEN 0 THEN ',"result":{"metadata":{"resolvedModel":"claude-opus-4-6"}}' WHEN 1 THEN ',"result":{"metadata":{"resolvedModel":"Mystery One"}}' ELSE '' END || ',"agent":{"id":"a' || CAST(event_id % 5 AS STRING) || '"}}'"""
query(
    "s11_request_models",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'claude-opus-4-6' WHEN event_id % 4 = 0 THEN 'm1' WHEN event_id % 4 = 3 THEN 'm2' WHEN event_id % 5 < 4 THEN 'g' || (event_id % 5) END AS model FROM events",
)(
    lambda s, d: src.request_model(a.prices(s), s.sql("SELECT 'a' || CAST(id AS STRING) AS agent_id, 'g' || CAST(id AS STRING) AS model FROM range(4)"), _lines(s, d, _CHOICES).withColumn("v", F.try_parse_json("value"))).select(
        F.col("line_no").alias("event_id"), "model"
    )
)
_ASK = lambda k: f"""'{{"requestId":"q' || CAST(event_id AS STRING) || '-{k}","timestamp":' || CAST(1704067200000 + event_id AS STRING) || ',"promptTokens":' || CAST(event_id % 9 AS STRING) || ',"completionTokens":' || CAST(event_id % 4 AS STRING) || ',"message":{{"text":"hi {k}"}}}}'"""
_DOCUMENT = f"""CASE WHEN event_id % 2 = 0 THEN '[' || {_ASK(0)} || ',' || {_ASK(1)} || ']' WHEN event_id % 31 = 0 THEN 'no json' ELSE '{{"sessionId":"s' || CAST(event_id AS STRING) || '","requests":[' || {_ASK(0)} || ']}}' END"""
_DOCS_SQL = "SELECT 'f' || event_id AS file, event_id, k AS idx, CASE WHEN event_id % 2 = 1 THEN 's' || event_id END AS session_id, 'q' || event_id || '-' || k AS request_id FROM events, (VALUES (0), (1)) v(k) WHERE (event_id % 2 = 0 OR k = 0) AND (event_id % 2 = 0 OR event_id % 31 <> 0)"
query("s12_chat_documents", f"SELECT file, idx, session_id, request_id FROM ({_DOCS_SQL})")(
    lambda s, d: src.chat_documents(_lines(s, d, _DOCUMENT, key="event_id", spread=True)).select("file", "idx", "session_id", src.get("$.requestId").alias("request_id"))
)
query(
    "s13_chat_rows",
    """SELECT request_id || CASE WHEN role = 'user' THEN '-user' ELSE '' END AS id, session_id, role, CASE WHEN role = 'assistant' AND event_id % 9 > 0 THEN event_id % 9 ELSE 0 END AS input_tokens, CASE WHEN role = 'assistant' THEN event_id % 4 ELSE 0 END AS output_tokens, CASE WHEN role = 'assistant' THEN request_id || '-user' END AS parent_uuid,
CASE WHEN role = 'user' THEN 'hi ' || idx END AS text, 1704067200000 + event_id AS at_ms FROM docs, (VALUES ('user'), ('assistant')) w(role) WHERE event_id % 4 > 0""",
    ("docs", _DOCS_SQL),
)(lambda s, d: src.chat_requests(src.chat_documents(_lines(s, d, _DOCUMENT, key="event_id", spread=True))).select("id", "session_id", "role", "input_tokens", "output_tokens", "parent_uuid", "text", F.unix_millis("timestamp").alias("at_ms")))
_STORE_KEY = "'bubbleId:' || lpad(CAST(user_id AS STRING), 36, '0') || CASE WHEN event_id % 40 = 7 THEN ':short' ELSE ':' || lpad(CAST(event_id AS STRING), 36, '0') END AS key"
_STORE = f"""'{{"tokenCount":{{"inputTokens":' || CAST({_I} AS STRING) || ',"outputTokens":' || CAST(event_id % 3 AS STRING) || '}},"modelInfo":{{"modelName":"' || CASE WHEN event_id % 3 = 0 THEN 'default' ELSE 'm' END || '"}},"type":' || CASE WHEN event_id % 4 = 0 THEN '1' ELSE '2' END
|| CASE WHEN event_id % 2 = 0 THEN ',"createdAt":"' || {_TS} || '"' ELSE '' END || '}}' AS value"""
_HEADS = "SELECT DISTINCT lpad(CAST(user_id AS STRING), 36, '0') AS conversation_id, 1704067200000 + user_id AS created_ms FROM {e} WHERE user_id % 3 > 0"
query(
    "s15_conversation_store",
    f"""SELECT lpad(event_id::VARCHAR, 36, '0') AS id, lpad(user_id::VARCHAR, 36, '0') AS session_id, CASE WHEN event_id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'auto' ELSE 'm' END AS model, {_I} AS input_tokens, at_ms
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN epoch_ms(date_trunc('second', ts)) WHEN user_id % 3 > 0 THEN 1704067200000 + user_id END AS at_ms FROM events) WHERE event_id % 40 <> 7 AND at_ms > 1704067200010 AND (event_id % 4 = 0 OR {_I} + event_id % 3 > 0)""",
)(
    lambda s, d: src.conversation_store(a.table(s, d, "events").selectExpr(_STORE_KEY, _STORE), _made(s, d, _HEADS), newest_ms=1704067200010).select("id", "session_id", "role", "model", "input_tokens", F.unix_millis("timestamp").alias("at_ms"))
)
_ROLES = f"""'{{"role":"' || CASE event_type WHEN 'view' THEN 'user' WHEN 'error' THEN 'system' ELSE 'assistant' END || '","uuid":"u' || CAST(event_id AS STRING) || '","sessionId":"s' || CAST(user_id AS STRING) || '","timestamp":"' || {_TS} || '","model":"m","usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"outputTokens":' || CAST(event_id % 3 AS STRING) || '}},"cwd":"/w","content":"hello"}}'"""
query(
    "s16_role_lines",
    f"SELECT 'u' || event_id AS id, 's' || user_id AS session_id, CASE event_type WHEN 'view' THEN 'user' ELSE 'assistant' END AS role, {_I} AS input_tokens, event_id % 3 AS output_tokens, '/w' AS cwd, CASE WHEN event_type = 'view' THEN 'hello' END AS text FROM events WHERE event_type <> 'error'",
)(lambda s, d: src.role_lines(_lines(s, d, _ROLES)).select("id", "session_id", "role", "input_tokens", "output_tokens", "cwd", "text"))
_RULE_DOCS = """'{"rules":[{"key":"k' || CAST(event_id % 5 AS STRING) || '","value":"v' || CAST(event_id AS STRING) || '","match_repo":"*/x"},{"key":"","value":"z"},{"key":"open","value":"w"}]}'"""
query("s18_tag_rules", "SELECT 'k' || (event_id % 5) AS key, 'v' || event_id AS value, '*/x' AS match_repo FROM events UNION ALL SELECT 'open', 'w', NULL FROM events")(
    lambda s, d: src.tag_rules(_lines(s, d, _RULE_DOCS))
)

_NESTED = f"""CASE event_id % 8 WHEN 0 THEN '{{"kind":2,"v":[{{"requestId":"q' || CAST(event_id AS STRING) || '","timestamp":"' || {_TS} || '"}}]}}' WHEN 1 THEN '{{"kind":1,"k":["requests",' || CAST((event_id % 400) // 8 AS STRING) || ',"result","metadata"],"v":{{"promptTokens":' || CAST(event_id % 50 + 1 AS STRING) || ',"outputTokens":' || CAST(event_id % 7 AS STRING) || '}}}}'
WHEN 2 THEN '{{"kind":1,"k":["requests",' || CAST((event_id % 400) // 8 AS STRING) || ',"result","metadata","outputTokens"],"v":' || CAST(event_id % 5 + 1 AS STRING) || '}}' WHEN 3 THEN '{{"kind":0,"v":{{"sessionId":"s' || CAST(event_id AS STRING) || '"}}}}'
ELSE '{{"kind":2,"k":["requests",' || CAST((event_id % 400) // 8 AS STRING) || ',"response"],"v":[{{"value":"x"}}]}}' END"""
query(
    "s09_nested_mutations",
    """SELECT 'f' || (event_id // 400) AS file, 'q' || event_id AS request_id, 's' || max(event_id + 3) OVER (PARTITION BY event_id // 400) AS session_id, (event_id + 1) % 50 + 1 AS input_tokens, (event_id + 2) % 5 + 1 AS output_tokens, 4 AS parts FROM events WHERE event_id % 8 = 0""",
)(
    lambda s, d: src.folded_requests(_lines(s, d, _NESTED.replace("//", "div"), key="event_id div 400")).withColumn("k", src.request_tokens()).select(
        "file", src.get("$.requestId").alias("request_id"), "session_id", F.col("k.i").alias("input_tokens"), F.col("k.o").alias("output_tokens"), F.size(F.from_json(F.to_json(src.get("$.response", "variant")), "array<string>")).alias("parts")
    )
)

# prices and bills
_LIST = "SELECT 'n' || CAST(event_id AS STRING) AS model, CASE event_id % 10 WHEN 0 THEN -0.000001e0 WHEN 1 THEN 0.002e0 WHEN 2 THEN CAST('NaN' AS DOUBLE) ELSE 0.000001e0 END AS input_cost_per_token, CASE WHEN event_id % 100 = 13 THEN 0.01e0 ELSE 0.000001e0 END AS output_cost_per_token, CAST(NULL AS DOUBLE) AS cache_creation_input_token_cost, CAST(NULL AS DOUBLE) AS cache_read_input_token_cost FROM {e}"
query(
    "p03_refused_prices",
    "SELECT 'n' || event_id AS model, CASE event_id % 10 WHEN 0 THEN 'input_cost_per_token is negative' WHEN 1 THEN 'input_cost_per_token is too high' WHEN 2 THEN 'input_cost_per_token is no number' ELSE 'output_cost_per_token is too high' END AS reason FROM events WHERE event_id % 10 IN (0, 1, 2) OR event_id % 100 = 13",
)(lambda s, d: p.checked_prices(_made(s, d, _LIST), a.prices(s))[1].select("model", "reason"))
# a model that the list lacked costs tokens alone when it gets its price: no fast mode, no searches, all cache writes short ones
query(
    "p04_backfilled",
    """SELECT m.id, CASE WHEN late THEN round(((input_tokens * (input_cost_per_token * 1e6) + output_tokens * (output_cost_per_token * 1e6) + cache_creation_tokens * (coalesce(cache_creation_input_token_cost, 0e0) * 1e6) + cache_read_tokens * (coalesce(cache_read_input_token_cost, 0e0) * 1e6)) / 1e6) * 100e0, 8) ELSE cost_cents_effective END AS cost_cents_effective,
 CASE WHEN late THEN 'backfilled:v3' ELSE pricing_source END AS pricing_source FROM (SELECT *, model = 'gpt-5.3-codex' AND pricing_source = 'manifest:v1' AS late FROM msg) m LEFT JOIN price p ON p.model = m.model""",
)(
    lambda s, d: p.backfilled(p.priced(a.raw_messages(s, d), a.prices(s).where("model <> 'gpt-5.3-codex'"), a.aliases(s)), a.prices(s), a.aliases(s), 3).select("id", "cost_cents_effective", "pricing_source")
)
query(
    "p06_savings",
    "SELECT CAST(coalesce(sum(cents - CAST(e AS DECIMAL(20,8))), 0) AS DOUBLE) AS savings_cents FROM re WHERE timestamp >= TIMESTAMP '2024-01-05 12:00:00'",
    *breakdowns._TEAM,
)(lambda s, d: p.savings(p.repriced(a.messages(s, d), s.sql(breakdowns._RATES)), datetime(2024, 2, 4, 12)))
_BILLS = """'{"usageItems":[{"date":"' || CAST(CAST(ts AS DATE) AS STRING) || '","model":"m","netAmount":' || CAST(event_id % 100 AS STRING) || '.25},{"date":"' || CAST(CAST(ts AS DATE) AS STRING) || 'T00:00:00Z","sku":"k","creditsUsed":' || CAST(event_id % 9 AS STRING) || ',"pricePerCredit":0.5},{"model":"x"}]}'"""
query(
    "p08_bills",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'm' AS model, (event_id % 100 + 0.25e0) * 100 AS amount_in_cents FROM events UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), 'k', (event_id % 9) * 0.5e0 * 100 FROM events",
)(lambda s, d: src.bills(_lines(s, d, _BILLS)).withColumn("date", F.col("date").cast("string")))
_BILL_RUNS = "SELECT CAST(ts AS DATE) AS cycle_end, event_id AS run_at, user_id % 3 AS n_rows FROM {e}"
query(
    "p09_org_managed",
    f"SELECT CAST(cycle_end AS VARCHAR) AS cycle_end, bool_or(two) AS org_managed FROM (SELECT cycle_end, n_rows = 0 AND coalesce(lag(n_rows) OVER (PARTITION BY cycle_end ORDER BY run_at) = 0, false) AS two FROM ({_BILL_RUNS.format(e='events')})) GROUP BY 1",
)(lambda s, d: p.org_managed(_made(s, d, _BILL_RUNS)).withColumn("cycle_end", F.col("cycle_end").cast("string")))
_LABELS = "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'manifest:v3' WHEN 1 THEN 'manifest:v' || CAST(event_id AS STRING) || ':alias' WHEN 2 THEN 'backfilled:v12' WHEN 3 THEN 'embedded:v2' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unpriced:no_tokens' ELSE 'legacy:pre-manifest' END AS c FROM {e}"
query(
    "p10_pricing_labels",
    "SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'manifest' WHEN 1 THEN 'manifest_alias' WHEN 2 THEN 'backfilled' WHEN 3 THEN 'embedded' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unpriced' ELSE 'legacy:pre-manifest' END AS kind, CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN event_id WHEN 2 THEN 12 WHEN 3 THEN 2 END AS version FROM events",
)(lambda s, d: _made(s, d, _LABELS).select("id", p.pricing_label(F.col("c")).alias("l")).select("id", "l.kind", "l.version"))
_UNKNOWN = "SELECT b.* FROM base b LEFT JOIN alias a ON a.alias = b.model LEFT JOIN price p ON p.model = coalesce(a.canonical, b.model) WHERE role = 'assistant' AND p.model IS NULL AND b.model IS NOT NULL AND b.cost_cents_ingested IS NULL"
query("p11_price_status", f"SELECT 7 AS version, 4 AS known_models, 1 AS aliases, 0 AS refused_rows, count(DISTINCT model) AS unknown_models, count(*) AS unknown_messages FROM ({_UNKNOWN})")(
    lambda s, d: p.price_status(a.messages(s, d), a.prices(s), a.aliases(s), a.prices(s), 7)
)
query("p11_unknown_by_provider", f"SELECT coalesce(nullif(provider, ''), 'claude_code') AS provider, model, min(timestamp) AS first_seen_at, count(*) AS messages FROM ({_UNKNOWN}) GROUP BY 1, 2")(
    lambda s, d: p.unknown_by_provider(a.messages(s, d))
)
query(
    "p12_labelled_models",
    f"""SELECT CASE d_model WHEN 'claude-opus-4-6' THEN 'Claude Opus 4.6' WHEN 'claude-sonnet-4-5' THEN 'Claude Sonnet 4.5' WHEN 'gpt-5.3-codex' THEN 'GPT-5.3 Codex' WHEN '(untagged)' THEN '(model not yet attributed)' ELSE d_model END AS model,
d_provider AS provider, count(*) AS message_count, {SUMS}, {COST}, d_model = '(untagged)' AND coalesce(sum(cents), 0) <= 0 AS suppressed FROM asst GROUP BY d_model, d_provider""",
)(lambda s, d: b.labelled_models(a.messages(s, d)))
_NAMES = "SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'claude-opus-4-7-thinking-high' WHEN 1 THEN 'claude-4.5-opus-high-thinking' WHEN 2 THEN 'claude-haiku-4-5-20251001' WHEN 3 THEN 'gpt-5.3-codex-xhigh' WHEN 4 THEN 'gpt-4.1-mini' WHEN 5 THEN 'default' WHEN 6 THEN '(untagged)' WHEN 7 THEN 'gemini-2.5-pro' WHEN 8 THEN 'claude-4.6-sonnet' WHEN 9 THEN 'gpt-' || CAST(event_id AS STRING) WHEN 10 THEN 'claude-sonnet-' || CAST(event_id AS STRING) ELSE 'gpt-5-codex-default' END AS m FROM {e}"
query(
    "p12_display_names",
    """SELECT event_id AS id, CASE event_id % 12 WHEN 0 THEN 'Claude Opus 4.7 · thinking-high' WHEN 1 THEN 'Claude Opus 4.5 · thinking-high' WHEN 2 THEN 'Claude Haiku 4.5' WHEN 3 THEN 'GPT-5.3 Codex · xhigh' WHEN 4 THEN 'GPT-4.1 · mini' WHEN 5 THEN 'Cursor Auto' WHEN 6 THEN '(model not yet attributed)' WHEN 7 THEN 'gemini-2.5-pro'
WHEN 8 THEN 'Claude Sonnet 4.6' WHEN 9 THEN 'GPT-' || event_id WHEN 10 THEN 'Claude Sonnet ' || event_id ELSE 'GPT-5 Codex' END AS label, event_id % 12 IN (5, 6) AS placeholder FROM events""",
)(lambda s, d: _made(s, d, _NAMES).select("id", t.model_label(F.col("m")).alias("label"), t.display_model(F.col("m"))["placeholder"].alias("placeholder")))

# enrichment
query(
    "e05_tool_tags",
    "SELECT 'm' || event_id AS message_id, 'tool' AS key, unnest(['Edit', 'T' || (event_id % 5)]) AS value FROM events UNION ALL SELECT 'm' || event_id, 'tool_use_id', 'u' || event_id FROM events",
)(
    lambda s, d: e.tool_tags(_made(s, d, "SELECT 'm' || CAST(event_id AS STRING) AS id, 'assistant' AS role, array(' Edit ', 'Edit', 'T' || CAST(event_id % 5 AS STRING), '') AS tool_names, array('u' || CAST(event_id AS STRING), 'u' || CAST(event_id AS STRING)) AS tool_use_ids FROM {e}"))
)
query(
    "e09_activity_tags",
    "SELECT 'c' || m.conv_id || '-' || m.turn AS message_id, k.key, CASE k.key WHEN 'activity' THEN category WHEN 'activity_source' THEN 'rule' ELSE confidence END AS value FROM conversations m ASOF JOIN pc ON m.conv_id = pc.conv_id AND m.turn > pc.turn, (VALUES ('activity'), ('activity_source'), ('activity_confidence')) k(key) WHERE role = 'assistant'",
    ("pc", upkeep.SQL["e10_prompt_classes"]),
)(
    lambda s, d: e.activity_tags(e.carried_context(e.classified(_made(s, d, "SELECT 'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, CAST(conv_id AS STRING) AS session_id, role, turn AS timestamp, text FROM {e}", "conversations"))))
)
_USES = """SELECT 'm' || CAST(event_id AS STRING) AS id, 's' || CAST(CAST(floor(event_id / 50) AS BIGINT) AS STRING) AS session_id, event_id AS timestamp, CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS role,
CASE WHEN event_type = 'view' THEN array() ELSE array('tool' || CAST(event_id % 3 AS STRING)) END AS tool_names, CASE WHEN event_type = 'view' THEN array() ELSE array('t' || CAST(event_id AS STRING)) END AS tool_use_ids,
CASE WHEN event_type = 'view' THEN array(named_struct('tool_use_id', 't' || CAST(event_id - 1 AS STRING), 'outcome', CASE WHEN user_id % 3 = 0 THEN 'success' WHEN user_id % 3 = 1 THEN 'denied' ELSE 'error' END)) END AS tool_outcomes FROM {e}"""
query(
    "e11_tool_outcomes",
    """SELECT 'm' || event_id AS message_id, 's' || s AS session_id, 'tool' || k AS tool, 't' || event_id AS use_id, CASE WHEN prior = 'error' THEN 'retry' ELSE raw END AS outcome, CASE WHEN prior = 'error' THEN 'heuristic' ELSE 'tool_result' END AS source, CASE WHEN prior = 'error' THEN 'medium' ELSE 'high' END AS confidence
FROM (SELECT *, lag(raw) OVER (PARTITION BY s, k ORDER BY event_id) AS prior FROM (SELECT u.event_id, u.event_id // 50 AS s, u.event_id % 3 AS k, CASE WHEN v.user_id % 3 = 0 THEN 'success' WHEN v.user_id % 3 = 1 THEN 'denied' WHEN v.user_id % 3 = 2 THEN 'error' END AS raw
FROM events u LEFT JOIN events v ON v.event_id = u.event_id + 1 AND v.event_type = 'view' AND v.event_id // 50 = u.event_id // 50 WHERE u.event_type <> 'view')) WHERE prior = 'error' OR raw IS NOT NULL""",
)(lambda s, d: e.tool_outcomes(_made(s, d, _USES)))
query("e12_cwd_source", "SELECT id AS message_id, 'cwd_source' AS key, CASE WHEN cwd IS NULL THEN 'fallback' ELSE 'transcript' END AS value FROM base WHERE role = 'assistant'")(
    lambda s, d: e.cwd_source_tags(a.raw_messages(s, d).withColumn("cwd_source", F.when(F.col("cwd").isNull(), "fallback").otherwise("transcript")))
)

# merges and repairs
_N = "CAST(substr(id, 2) AS BIGINT)"


def _known(s, d):
    rows = a.messages(s, d)
    return m.merged(rows.where(f"{_N} % 3 = 0"), rows.withColumns({"output_tokens": F.col("output_tokens") + 1000, "request_id": F.lit(None).cast("string")}))[0].select("id", "output_tokens")


query("d03_known_ids", f"SELECT id, CASE WHEN {_N} % 3 = 0 THEN output_tokens ELSE output_tokens + 1000 END AS output_tokens FROM base")(_known)
_CATEGORY = "CASE WHEN length({0}) % 2 = 0 THEN 'bugfix' ELSE '' END"
query(
    "d07_activity_backfill",
    f"SELECT id AS message_id, k.key, CASE k.key WHEN 'activity' THEN 'bugfix' WHEN 'activity_source' THEN 'session' ELSE 'low' END AS value FROM asst, (VALUES ('activity'), ('activity_source'), ('activity_confidence')) k(key) WHERE session_id IS NOT NULL AND {_CATEGORY.format('session_id')} <> '' AND timestamp >= TIMESTAMP '2024-01-10' AND NOT EXISTS (SELECT 1 FROM tags WHERE tags.message_id = asst.id AND tags.key = 'activity')",
)(lambda s, d: m.activity_backfill(a.messages(s, d), a.tags(s, d), r.sessions(a.messages(s, d)).withColumn("prompt_category", F.expr(_CATEGORY.format("id"))), datetime(2024, 4, 9)))
_OLD_TAGS = "SELECT 'm' || CAST(event_id AS STRING) AS message_id, CASE event_id % 6 WHEN 0 THEN 'branch' WHEN 1 THEN 'repo' WHEN 2 THEN 'cwd' WHEN 3 THEN 'dominant_tool' WHEN 4 THEN 'tool' ELSE 'ticket_id' END AS key, 'x' AS value FROM {e}"
query("d11_legacy_tags", "SELECT 'm' || event_id AS message_id, CASE event_id % 6 WHEN 4 THEN 'tool' ELSE 'ticket_id' END AS key, 'x' AS value FROM events WHERE event_id % 6 IN (4, 5)")(lambda s, d: m.without_legacy_tags(_made(s, d, _OLD_TAGS)))
_SURFACE = "coalesce(nullif(lower(surface), ''), CASE provider WHEN 'claude_code' THEN 'terminal' WHEN 'codex' THEN 'terminal' WHEN 'cursor' THEN 'cursor' WHEN 'copilot_chat' THEN 'vscode' ELSE 'unknown' END)"
query(
    "d13_session_surfaces",
    f"""SELECT s.id, coalesce(m.v, 'unknown') AS surface FROM (SELECT DISTINCT session_id AS id FROM base WHERE session_id IS NOT NULL) s LEFT JOIN (SELECT session_id, v FROM (SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, v) AS k
FROM (SELECT session_id, {_SURFACE} AS v FROM base) WHERE v <> 'unknown' GROUP BY 1, 2) WHERE k = 1) m ON m.session_id = s.id""",
)(lambda s, d: r.sessions(e.with_surface(a.raw_messages(s, d))).select("id", "surface"))
query(
    "d14_repaired_context",
    "SELECT b.id, coalesce(nullif(b.cwd, ''), '/w/' || s.id) AS cwd, coalesce(nullif(b.repo_id, ''), nullif(s.repo_id, '')) AS repo_id, coalesce(nullif(b.git_branch, ''), nullif(s.git_branch, '')) AS git_branch FROM base b LEFT JOIN sess s ON s.id = b.session_id",
    upkeep._SESS,
)(lambda s, d: m.repaired_context(a.raw_messages(s, d), r.sessions(a.messages(s, d)).withColumn("workspace_root", F.concat(F.lit("/w/"), "id"))).select("id", "cwd", "repo_id", "git_branch"))
query(
    "d15_assigned_sessions",
    "SELECT b.id, coalesce(b.session_id, f.session_id) AS session_id FROM base b LEFT JOIN found f ON f.id = b.id",
    upkeep._SESS, ("found", upkeep.BY_TIME),
)(lambda s, d: m.assigned_sessions(a.raw_messages(s, d), upkeep._all_windows(s, d)).select("id", "session_id"))
# windows of a year: orders by priority and year
_YEARS = "SELECT o_orderpriority || '-' || CAST(year(o_orderdate) AS STRING) AS session_id, {ms}(min(o_orderdate)) AS start_ms, {ms}(max(o_orderdate)) AS end_ms FROM {e} GROUP BY o_orderpriority || '-' || CAST(year(o_orderdate) AS STRING)"
query(
    "j03_long_windows",
    f"""SELECT 'o' || o_orderkey AS id, arg_min(w.session_id, {{'b': t - start_ms, 'd': w.session_id}}) AS session_id FROM (SELECT o_orderkey, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders) p JOIN ({_YEARS.replace('{ms}(min(o_orderdate))', 'epoch_ms(CAST(min(o_orderdate) AS TIMESTAMP))').replace('{ms}(max(o_orderdate))', 'epoch_ms(CAST(max(o_orderdate) AS TIMESTAMP))').replace('{e}', 'orders')}) w ON t BETWEEN start_ms AND end_ms GROUP BY 1""",
)(
    lambda s, d: m.in_interval(
        a.table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at_ms")),
        s.sql("SELECT o_orderpriority || '-' || CAST(year(o_orderdate) AS STRING) AS session_id, unix_millis(CAST(min(o_orderdate) AS TIMESTAMP)) AS start_ms, unix_millis(CAST(max(o_orderdate) AS TIMESTAMP)) AS end_ms FROM {e} GROUP BY 1", e=a.table(s, d, "orders")),
        skew_ms=0,
    )
)
query(
    "d17_retained",
    "SELECT id, CASE WHEN ended_at >= TIMESTAMP '2024-01-11' THEN 'raw ' || id END AS raw_json, CASE WHEN ended_at >= TIMESTAMP '2024-01-05' THEN 'e@x' END AS user_email, CASE WHEN ended_at >= TIMESTAMP '2024-01-05' THEN '/w' END AS workspace_root FROM sess",
    upkeep._SESS,
)(
    lambda s, d: m.retained(r.sessions(a.messages(s, d)).withColumns({"raw_json": F.concat(F.lit("raw "), "id"), "user_email": F.lit("e@x"), "workspace_root": F.lit("/w")}), datetime(2024, 2, 10), 30, 36).select("id", "raw_json", "user_email", "workspace_root")
)
_PAYLOAD = """CASE WHEN event_id % 20 = 0 THEN 'no json' ELSE '{"cwd":"/w/' || CAST(event_id % 7 AS STRING) || '","n":' || CAST(event_id AS STRING) || ',"in":{"cwd":"/secret/' || CAST(event_id % 3 AS STRING) || '","x":[1,true,{"project_dir":"/p"}]},"workspace_roots":["/a"," "],"t":"keep"}' END"""
_HASH = "'sha256:' || left(sha256({}), 24)".format
query(
    "d18_minimized_json",
    f"""SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN '{{"cwd":"' || {_HASH("'/w/' || (event_id % 7)")} || '","n":' || event_id || ',"in":{{"cwd":"' || {_HASH("'/secret/' || (event_id % 3)")} || '","x":[1,true,{{"project_dir":"' || {_HASH("'/p'")} || '"}}]}},"workspace_roots":["' || {_HASH("'/a'")} || '"," "],"t":"keep"}}' END AS payload FROM events""",
)(lambda s, d: _lines(s, d, _PAYLOAD).select(F.col("line_no").alias("event_id"), m.minimized_json(F.col("value"), "hash").alias("payload")))

# sessions and lists
_UUID = "lpad(CAST(event_id AS STRING), 8, '0') || '-ABCD-4abc-89ab-' || lpad(CAST(user_id AS STRING), 12, '0')"
query("a02_session_ids", f"SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'plain ' || event_id ELSE lower({_UUID}) END AS session_id FROM events")(
    lambda s, d: _made(s, d, f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'cursor-' || {_UUID} WHEN 1 THEN {_UUID} ELSE ' plain ' || CAST(event_id AS STRING) || ' ' END AS raw FROM {{e}}").select("event_id", t.session_id(F.col("raw")).alias("session_id"))
)


def _two_windows(s, d):
    first = upkeep._all_windows(s, d).withColumns({"workspace_root": F.lit(""), "repo_id": F.concat(F.lit("r/"), "session_id"), "git_branch": F.lit(None).cast("string")})
    second = first.withColumns({"start_ms": F.col("start_ms") - 1000, "end_ms": F.lit(None).cast("long"), "workspace_root": F.lit("/w"), "repo_id": F.lit(None).cast("string"), "git_branch": F.lit("b")})
    return r.session_windows(first, second, 1706184000000, 10 * 86_400_000)


query(
    "a03_session_windows",
    "SELECT session_id, a - 1000 AS start_ms, CASE WHEN b >= 1705320000000 THEN b END AS end_ms, '/w' AS workspace_root, CASE WHEN b >= 1705320000000 THEN 'r/' || session_id END AS repo_id, 'b' AS git_branch FROM (SELECT id AS session_id, epoch_us(started_at) // 1000 AS a, epoch_us(ended_at) // 1000 AS b FROM sess)",
    upkeep._SESS,
)(_two_windows)
_PREFIXES = "SELECT DISTINCT 's' || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN '-2024-01-0' ELSE '' END AS prefix FROM {e} UNION ALL SELECT 'nobody'"
query(
    "l03_resolved_prefixes",
    f"""SELECT prefix, CASE WHEN n = 0 THEN 'none' WHEN n = 1 OR own THEN 'unique' ELSE 'ambiguous' END AS outcome, CASE WHEN own THEN prefix WHEN n = 1 THEN one END AS id FROM (SELECT prefix, count(i.id) AS n, min(i.id) AS one, coalesce(bool_or(i.id = prefix), false) AS own
FROM ({_PREFIXES.format(e='events')}) x LEFT JOIN (SELECT DISTINCT session_id AS id FROM base WHERE session_id IS NOT NULL) i ON starts_with(i.id, prefix) GROUP BY 1)""",
)(lambda s, d: l.resolved_sessions(a.messages(s, d), r.sessions(a.messages(s, d)), _made(s, d, _PREFIXES)))
_L5 = sessions.SQL["l05_session_messages"]
query("l06_session_page", "SELECT id, assistant_sequence, tools, tags FROM (SELECT x.*, timestamp FROM l5 x JOIN base ON base.id = x.id WHERE x.session_id = 's7-2024-01-12' AND role = 'assistant') ORDER BY timestamp, id LIMIT 20 OFFSET 1", ("l5", _L5))(
    lambda s, d: l.session_page(a.messages(s, d), a.tags(s, d), "s7-2024-01-12", limit=20, offset=1).select("id", "assistant_sequence", F.array_join("tools", "|").alias("tools"), F.array_join("tags", "|").alias("tags"))
)
query("l09_message_detail", "SELECT id, session_id, tools, tags FROM l5 WHERE id = 'm101'", ("l5", _L5))(
    lambda s, d: l.message_detail(a.messages(s, d), a.tags(s, d), "m101").select("id", "session_id", F.array_join("tools", "|").alias("tools"), F.array_join("tags", "|").alias("tags"))
)
query(
    "x05_pending",
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS day, role, d_provider, d_model, d_project, d_branch, d_surface FROM msg WHERE CAST(timestamp AS DATE) > DATE '2024-01-20' OR CAST(timestamp AS DATE) = DATE '2024-01-03')) AS rollups, (SELECT count(*) FROM sess WHERE ended_at >= TIMESTAMP '2024-01-20') AS sessions",
    upkeep._SESS,
)(lambda s, d: x.pending(r.daily(r.hourly(a.messages(s, d))), a.messages(s, d), r.sessions(a.messages(s, d)), date(2024, 1, 20), date(2024, 1, 3), datetime(2024, 1, 20)))
_LATEST = "(SELECT session_id FROM asst WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY max(timestamp) DESC, min(timestamp) DESC, session_id DESC LIMIT 1)"
query("h10_latest_health", f"SELECT * FROM hh WHERE session_id = {_LATEST}", ("hh", upkeep.SQL["h10_session_health"]))(
    lambda s, d: h.latest_health(a.messages(s, d), r.sessions(a.messages(s, d)), a.tool_events(s, d))
)

# shared functions
_NOW = datetime(2024, 1, 25, 12)
_SINCE = {"today": "2024-01-25", "week": "2024-01-18", "month": "2023-12-26", "1m": "2023-12-25", "2w": "2024-01-11", "all": "0001-01-01"}


def _periods(s, d):
    rows, out = a.messages(s, d), None
    for name in _SINCE:
        one = b.usage_summary(rows, TimeWindow(since=since_of(name, _NOW))).select(F.lit(name).alias("period"), "total_messages", "cost_cents")
        out = one if out is None else out.unionByName(one)
    return out


query("f06_periods", " UNION ALL ".join(f"SELECT '{k}' AS period, count(*) AS total_messages, {COST} FROM msg WHERE timestamp >= TIMESTAMP '{v}'" for k, v in _SINCE.items()))(_periods)
query("f07_bounds", "SELECT count(*) AS total_messages FROM msg WHERE timestamp >= TIMESTAMP '2024-01-05 03:00:00' AND timestamp < TIMESTAMP '2024-01-20'")(
    lambda s, d: b.usage_summary(a.messages(s, d), TimeWindow.parse("2024-01-05T03:00:00Z", "2024-01-20")).select("total_messages")
)
query(
    "f09_timestamps",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1704067200000 + event_id WHEN 1 THEN epoch_ms(date_trunc('second', ts)) END AS at_ms FROM events",
)(
    lambda s, d: _made(s, d, f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(1704067200000 + event_id AS STRING) WHEN 1 THEN {_TS} WHEN 2 THEN 'bad' END AS raw FROM {{e}}").select("event_id", F.unix_millis(t.timestamp_of(F.col("raw"))).alias("at_ms"))
)
query("f10_paths_of_uris", "SELECT event_id, '/w x/a+b' || event_id || 'é' AS path FROM events")(
    lambda s, d: _made(s, d, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'file://localhost' ELSE 'file://' END || '/w%20x/a+b' || CAST(event_id AS STRING) || '%C3%A9' AS uri FROM {e}").select("event_id", t.path_of_uri(F.col("uri")).alias("path"))
)
query("f12_filter_lists", f"SELECT count(*) AS total_messages, {COST} FROM msg WHERE d_provider IN ('codex', 'cursor') AND d_surface IN ('vscode', 'terminal') AND d_branch IN ('PAVA-12-login', 'main')")(
    lambda s, d: b.usage_summary(a.messages(s, d), filters=DimFilters(providers=" codex, cursor ,codex,,", surfaces=("VSCode", "terminal "), branches=("refs/heads/PAVA-12-login", "main"))).select("total_messages", "cost_cents")
)
query("f13_short_ids", "SELECT DISTINCT session_id, left(session_id, 8) AS short FROM base WHERE session_id IS NOT NULL")(
    lambda s, d: a.raw_messages(s, d).where("session_id IS NOT NULL").select("session_id").distinct().select("session_id", l.short_id(F.col("session_id")).alias("short"))
)
