"""Registered source and export queries with their SQL twins. Transcript lines are made of the events table on the fly."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import enrich as e
from ..operators import exports as x

from ..operators import rollups as r
from ..sources import transcripts as t
from . import adapters as a
from .adapters import with_ctes
from .breakdowns import COST, SUMS

Q, SQL = {}, {}


def query(name, sql=None, *extra):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_ctes(sql, *extra)
        return f

    return add


def _lines(s, d, value: str, where: str = "true", key: str = "user_id", spread: bool = False):
    """Lines; ``spread``: over more tasks than the small table has splits, where a line costs far more than a row."""
    events = a.table(s, d, "events").where(where)
    return (events.repartition("event_id") if spread else events).selectExpr(f"'f' || CAST({key} AS STRING) AS file", "event_id AS line_no", f"{value} AS value")


_TS = "replace(CAST(date_trunc('second', ts) AS STRING), ' ', 'T') || 'Z'"
_TS_D = "date_trunc('second', ts)"
_I = "CAST(floor(value * 10) AS BIGINT)"
_ENVELOPE = f"""CASE WHEN event_id % 50 = 0 THEN 'not json' WHEN event_type = 'view' THEN '{{"type":"user","uuid":"u' || CAST(event_id AS STRING) || '","sessionId":"s' || CAST(user_id AS STRING) || '","timestamp":"' || {_TS} || '","gitBranch":"b","message":{{"content":[' || CASE WHEN event_id % 3 = 0 THEN '"and then", 7, null, ' ELSE '' END || '{{"type":"tool_result","tool_use_id":"t' || CAST(event_id AS STRING)
|| '","is_error":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"content":"' || CASE WHEN event_id % 6 = 0 THEN 'User rejected it' ELSE 'ok' END || '"}}]}}}}'
WHEN event_id % 7 = 0 THEN '{{"role":"assistant","uuid":"u' || CAST(event_id AS STRING) || '","id":"r' || CAST(event_id AS STRING) || '","sessionId":"s' || CAST(user_id AS STRING) || '","timestamp":"' || {_TS} || '","model":"flat","usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":3}}}}'
ELSE '{{"type":"assistant","uuid":"u' || CAST(event_id AS STRING) || '","sessionId":"s' || CAST(user_id AS STRING) || '","timestamp":"' || {_TS} || '","message":{{"id":"r' || CAST(event_id AS STRING) || '","model":"' || CASE WHEN event_id % 11 = 0 THEN '<synthetic>' ELSE 'm' END || '","content":[' || CASE WHEN event_id % 5 = 0 THEN '"hi", [1], {{"no":"type"}}, ' ELSE '' END || '{{"type":"tool_use","id":"t1","name":"Edit","input":{{"file_path":"src/a.py"}}}},{{"type":"tool_use","id":"t2","name":" Grep ","input":{{"path":"lib"}}}}],
"usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":5,"cache_creation_input_tokens":7,"cache_read_input_tokens":' || CAST(event_id % 9 AS STRING) || ',"cache_creation":{{"ephemeral_1h_input_tokens":2}}}}}}}}' END"""
query(
    "s02_envelope_lines",
    f"""SELECT 'u' || event_id AS id, 's' || user_id AS session_id, CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS role, strftime({_TS_D}, '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN event_type = 'view' THEN NULL WHEN event_id % 7 = 0 THEN 'flat' ELSE 'm' END AS model,
CASE WHEN event_type = 'view' THEN 0 ELSE {_I} END AS input_tokens, CASE WHEN event_type = 'view' THEN 0 WHEN event_id % 7 = 0 THEN 3 ELSE 5 END AS output_tokens, CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN 0 ELSE event_id % 9 END AS cache_read_tokens, CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN 0 ELSE 2 END AS cache_creation_1h_tokens,
CASE WHEN event_type <> 'view' THEN 'r' || event_id END AS request_id, CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN '' ELSE 'Edit|Grep' END AS tools, CASE WHEN event_type = 'view' OR event_id % 7 = 0 THEN '' ELSE 'src/a.py|lib' END AS files,
CASE WHEN event_type <> 'view' THEN '' WHEN event_id % 6 = 0 THEN 'denied' WHEN event_id % 2 = 0 THEN 'error' ELSE 'success' END AS outcomes FROM events WHERE event_id % 50 <> 0 AND NOT (event_type <> 'view' AND event_id % 7 <> 0 AND event_id % 11 = 0)""",
)(
    lambda s, d: t.envelope(_lines(s, d, _ENVELOPE, spread=True)).select(
        "id", "session_id", "role", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_1h_tokens", "request_id",
        F.coalesce(F.array_join("tool_names", "|"), F.lit("")).alias("tools"), F.coalesce(F.array_join("tool_files", "|"), F.lit("")).alias("files"), F.coalesce(F.array_join(F.transform("tool_outcomes", lambda o: o["outcome"]), "|"), F.lit("")).alias("outcomes"),
    )
)
_TOKENS = f"""CASE WHEN event_type = 'signup' THEN '{{"type":"session_meta","payload":{{"id":"x' || CAST(event_id AS STRING) || '","cwd":"/w","git":{{"branch":"b' || CAST(event_id % 3 AS STRING) || '"}}}}}}' WHEN event_type = 'view' THEN '{{"type":"turn_context","payload":{{"model":"m' || CAST(event_id % 4 AS STRING) || '"}}}}'
ELSE '{{"type":"event_msg","timestamp":"' || {_TS} || '","payload":{{"type":"token_count","info":{{"last_token_usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":' || CAST(event_id % 3 AS STRING) || ',"cached_input_tokens":' || CAST({_I} // 2 AS STRING) || '}}}}}}}}' END"""
_RUN = lambda c, w: f"last_value(CASE WHEN event_type = '{w}' THEN {c} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
query(
    "s06_token_counts",
    f"""SELECT line_no, session_id, model, git_branch, i - i // 2 AS input_tokens, event_id % 3 AS output_tokens, i // 2 AS cache_read_tokens FROM (SELECT event_id, event_id AS line_no, event_type, {_I} AS i, {_RUN("'x' || event_id", 'signup')} AS session_id, {_RUN("'m' || event_id % 4", 'view')} AS model, {_RUN("'b' || event_id % 3", 'signup')} AS git_branch FROM events) WHERE event_type NOT IN ('view', 'signup') AND i + event_id % 3 > 0""",
)(lambda s, d: t.token_counts(_lines(s, d, _TOKENS.replace("//", "div"))).select("line_no", "session_id", "model", "git_branch", "input_tokens", "output_tokens", "cache_read_tokens"))
_TURNS = f"""CASE WHEN event_type = 'view' THEN '{{"type":"assistant.turn_start","data":{{"model":"m' || CAST(event_id % 4 AS STRING) || '"}}}}' WHEN event_id % 2 = 0 THEN '{{"type":"assistant.usage","id":"i' || CAST(event_id AS STRING) || '","timestamp":"' || {_TS} || '","data":{{"sessionId":"z","input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":2}}}}'
ELSE '{{"type":"assistant.usage","id":"i' || CAST(event_id AS STRING) || '","timestamp":"' || {_TS} || '","data":{{"sessionId":"z","usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":4}}}}}}' END"""
query(
    "s07_turn_usage",
    f"SELECT 'i' || event_id AS id, model, i AS input_tokens, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 4 END AS output_tokens FROM (SELECT event_id, event_type, {_I} AS i, {_RUN("'m' || event_id % 4", 'view')} AS model FROM events) WHERE event_type <> 'view'",
)(lambda s, d: t.turn_usage(_lines(s, d, _TURNS)).select("id", "model", "input_tokens", "output_tokens"))
_STOPS = f"""CASE WHEN event_id % 2 = 0 THEN '{{"type":"message_start","id":"k' || CAST(event_id // 2 AS STRING) || '","model":"m' || CAST(event_id % 8 AS STRING) || '"}}' ELSE '{{"type":"message_stop","id":"k' || CAST(event_id // 2 AS STRING) || '","session_id":"z","timestamp":"' || {_TS} || '","usage":{{"input_tokens":' || CAST({_I} AS STRING) || ',"output_tokens":1}}}}' END"""
query("s08_start_stop", f"SELECT 'k' || (event_id // 2) AS id, 'm' || ((event_id - 1) % 8) AS model, {_I} AS input_tokens FROM events WHERE event_id % 2 = 1")(
    lambda s, d: t.start_stop(_lines(s, d, _STOPS.replace("//", "div"), key="0")).select("id", "model", "input_tokens")
)
_MUTATIONS = f"""CASE WHEN event_id % 4 = 0 THEN '{{"kind":2,"k":["requests"],"v":[{{"requestId":"q' || CAST(event_id AS STRING) || '","timestamp":"' || {_TS} || '","promptTokens":1,"completionTokens":0}}]}}'
ELSE '{{"kind":1,"k":["requests",' || CAST((event_id % 400) // 4 AS STRING) || ',"completionTokens"],"v":' || CAST(event_id % 13 AS STRING) || '}}' END"""
query(
    "s09_mutation_log",
    """SELECT 'f' || f AS file, 'q' || (f * 400 + idx * 4) AS request_id, tokens AS output_tokens FROM (SELECT event_id // 400 AS f, (event_id % 400) // 4 AS idx, arg_max(event_id % 13, event_id) FILTER (event_id % 4 <> 0) AS tokens FROM events GROUP BY 1, 2) WHERE tokens > 0""",
)(
    lambda s, d: t.folded_requests(_lines(s, d, _MUTATIONS.replace("//", "div"), key="event_id div 400")).withColumn("tk", t.request_tokens()).where("tk IS NOT NULL").select(
        "file", t.get("$.requestId").alias("request_id"), F.col("tk.o").alias("output_tokens")
    )
)
_USAGE = f"""'{{"timestamp":"' || CAST(1704067200000 + event_id AS STRING) || '","model":"m","tokenUsage":{{"inputTokens":' || CAST({_I} AS STRING) || ',"outputTokens":' || CAST(event_id % 3 AS STRING) || ',"totalCents":' || CAST(event_id % 300 * 500 - 1000 AS STRING) || '}}}}'"""
query(
    "s14_usage_events",
    f"SELECT 1704067200000 + event_id AS at_ms, {_I} AS input_tokens, event_id % 3 AS output_tokens, CAST(greatest(event_id % 300 * 500 - 1000, 0) AS DOUBLE) AS cents FROM events WHERE event_id % 300 * 500 - 1000 <= 100000 AND (event_id % 300 * 500 - 1000 > 0 OR {_I} + event_id % 3 > 0)",
)(lambda s, d: t.usage_events(_lines(s, d, _USAGE)).select(F.unix_millis("timestamp").alias("at_ms"), "input_tokens", "output_tokens", F.col("cost_cents_ingested").alias("cents")))
_PRICES = ''''{"sample_spec":{"input_cost_per_token":1.0,"output_cost_per_token":1.0},"a":{"input_cost_per_token":0.5,"output_cost_per_token":0.25,"cache_read_input_token_cost":0.125},"n' || CAST(event_id AS STRING) || '":{"input_cost_per_token":' || CAST(event_id AS STRING) || ',"output_cost_per_token":2},"bad":{"mode":"chat"}}' AS value'''
query(
    "s17_price_list",
    "SELECT 'a' AS model, 0.5e0 AS input_cost_per_token, 0.25e0 AS output_cost_per_token, 0.125e0 AS cache_read_input_token_cost FROM events UNION ALL SELECT 'n' || event_id, CAST(event_id AS DOUBLE), 2e0, NULL FROM events",
)(lambda s, d: t.price_list(a.table(s, d, "events").selectExpr(_PRICES)).drop("cache_creation_input_token_cost"))

_T = ("tickets", "SELECT * FROM (VALUES ('PAVA-12-login', 'PAVA-12', 'branch'), ('fix/1234-typo', '1234', 'branch_numeric'), ('03-20-pava-2120_desc', 'PAVA-2120', 'branch'), ('eng-7/chore/sweep-9', 'ENG-7', 'branch')) v(b, ticket, ticket_source)")
query(
    "x02_daily_export",
    f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS bucket_day, role, d_provider AS provider, d_model AS model, d_project AS repo_id, d_branch AS git_branch, d_surface AS surface, ticket, ticket_source, count(*) AS message_count, {SUMS}, {COST} FROM msg LEFT JOIN tickets ON b = d_branch WHERE CAST(timestamp AS DATE) > DATE '2024-01-20' OR CAST(timestamp AS DATE) = DATE '2024-01-03' GROUP BY ALL",
    _T,
)(lambda s, d: x.daily_export(r.daily(r.hourly(a.messages(s, d))), date(2024, 1, 20), date(2024, 1, 3)).withColumn("bucket_day", F.col("bucket_day").cast("string")))
query(
    "x03_session_export",
    f"""SELECT s.session_id, message_count, input_tokens, output_tokens, cost_cents, primary_model FROM (SELECT session_id, max(timestamp) AS e FROM msg WHERE session_id IS NOT NULL GROUP BY 1) s LEFT JOIN (SELECT session_id, count(*) AS message_count, {SUMS}, {COST} FROM asst GROUP BY 1) g ON g.session_id = s.session_id
LEFT JOIN (SELECT session_id, d_model AS primary_model FROM (SELECT session_id, d_model, row_number() OVER (PARTITION BY session_id ORDER BY sum(input_tokens + output_tokens) DESC, max(timestamp) DESC, d_model) AS k FROM asst WHERE d_model <> '(untagged)' GROUP BY 1, 2) WHERE k = 1) m ON m.session_id = s.session_id WHERE e >= TIMESTAMP '2024-01-20'""".replace("message_count, input", "coalesce(message_count, 0) AS message_count, coalesce(input", 1).replace("coalesce(input_tokens,", "coalesce(input_tokens, 0) AS input_tokens,", 1).replace(" output_tokens, cost_cents, primary", " coalesce(output_tokens, 0) AS output_tokens, coalesce(cost_cents, 0) AS cost_cents, primary", 1),
)(lambda s, d: x.session_export(a.messages(s, d), r.sessions(a.messages(s, d)), datetime(2024, 1, 20)).select("session_id", "message_count", "input_tokens", "output_tokens", "cost_cents", "primary_model"))
query("x06_day_chunks", """WITH RECURSIVE n AS (SELECT bucket_day, count(*) AS c, row_number() OVER (ORDER BY bucket_day) AS k FROM (SELECT DISTINCT CAST(timestamp AS DATE) AS bucket_day, role, coalesce(nullif(d_provider, ''), '') AS p, d_model, d_project, d_branch, d_surface FROM msg) GROUP BY 1),
z AS (SELECT k, bucket_day, c AS run, 0 AS chunk_id FROM n WHERE k = 1 UNION ALL SELECT n.k, n.bucket_day, CASE WHEN z.run >= 1000 THEN n.c ELSE z.run + n.c END, CASE WHEN z.run >= 1000 THEN z.chunk_id + 1 ELSE z.chunk_id END FROM z JOIN n ON n.k = z.k + 1)
SELECT CAST(bucket_day AS VARCHAR) AS bucket_day, chunk_id FROM z""")(lambda s, d: x.chunked_days(r.daily(r.hourly(a.messages(s, d))), 1000).select(F.col("bucket_day").cast("string").alias("bucket_day"), "chunk_id").distinct())
_b = SQL["x06_day_chunks"]
SQL["x06_day_chunks"] = "WITH RECURSIVE " + _b.split(" WITH RECURSIVE ", 1)[0].removeprefix("WITH ") + ", " + _b.split(" WITH RECURSIVE ", 1)[1]
query("x06_session_chunks", "SELECT session_id, (row_number() OVER (ORDER BY session_id) - 1) // 500 AS chunk_id FROM (SELECT DISTINCT session_id FROM base WHERE session_id IS NOT NULL)")(
    lambda s, d: x.chunked_sessions(a.raw_messages(s, d).where("session_id IS NOT NULL").select("session_id").distinct())
)
_PLACES = "SELECT '/w/u' || CAST(k AS STRING) AS path, 'git@github.com:acme/u' || CAST(k AS STRING) || '.git' AS remote_url FROM (SELECT DISTINCT user_id % 7 AS k FROM {e}) x UNION ALL SELECT '/w/u1/p1', 'https://github.com/acme/special'"
query(
    "e04_repo_of_cwd",
    "SELECT id, coalesce(repo_id, CASE WHEN cwd = '/w/u1/p1' THEN 'github.com/acme/special' ELSE 'github.com/acme/' || regexp_extract(cwd, '^/w/(u[0-9]+)', 1) END) AS repo_id FROM base",
)(lambda s, d: e.with_repo(a.raw_messages(s, d), s.sql(_PLACES, e=a.table(s, d, "events"))).select("id", "repo_id"))


def _staged_files(s, d):
    rows = s.sql("SELECT 'm' || CAST(event_id AS STRING) AS id, 'assistant' AS role, '/w/r' AS cwd, array('src/f' || CAST(event_id % 9 AS STRING) || '.py', '/w/r/lib/../a' || CAST(event_id % 4 AS STRING), '/etc/passwd', 'http://x/y', '../out.txt') AS tool_files FROM {e}", e=a.table(s, d, "events"))
    return e.file_tags(rows)


query(
    "e06_file_tags",
    "SELECT 'm' || event_id AS message_id, 'file_path' AS key, 'src/f' || (event_id % 9) || '.py' AS value FROM events UNION ALL SELECT 'm' || event_id, 'file_path', 'a' || (event_id % 4) FROM events UNION ALL SELECT 'm' || event_id, 'file_path_source', 'tool_arg' FROM events UNION ALL SELECT 'm' || event_id, 'file_path_confidence', 'high' FROM events",
)(_staged_files)
