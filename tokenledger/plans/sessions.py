"""Registered rollup, session and list queries with their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.dims import DimFilters, TimeWindow
from ..operators import breakdowns as b
from ..operators import rollups as r
from ..operators import sessions as l
from . import adapters as a
from .adapters import with_ctes
from .breakdowns import COST, IN_WINDOW, SUMS, WINDOW

Q, SQL = {}, {}


def query(name, sql=None, *extra):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_ctes(sql, *extra)
        return f

    return add


_R = f"coalesce(role, 'assistant') AS role, d_provider AS provider, d_model AS model, d_project AS repo_id, d_branch AS git_branch, d_surface AS surface, count(*) AS message_count, {SUMS}, CAST(sum(cents) AS DOUBLE) AS cost_cents_ingested, CAST(sum(cents) AS DOUBLE) AS cost_cents_effective"


def _out(rollup, bucket):
    costs = [F.col(f"cents_{k}").cast("double").alias(f"cost_cents_{k}") for k in ("ingested", "effective")]
    return rollup.select(F.col(bucket).cast("string").alias(bucket), *r.DIMS, "message_count", *r.MEASURES, *costs)


query("r01_hourly_rollup", f"SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS bucket_start, {_R} FROM msg GROUP BY ALL")(lambda s, d: _out(r.hourly(a.messages(s, d)), "bucket_start"))
query("r02_daily_rollup", f"SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS bucket_day, {_R} FROM msg GROUP BY ALL")(lambda s, d: _out(r.daily(r.hourly(a.messages(s, d))), "bucket_day"))


def _kept_by_changes(s, d):
    """Hours of an older state of the table, and signed rows of what has come, changed and gone since."""
    m = a.messages(s, d)
    e = F.expr("CAST(substr(id, 2) AS BIGINT)")
    changed = m.where(e % 7 == 1)
    older = changed.withColumns({"output_tokens": F.col("output_tokens") + 10, "git_branch": F.lit("older"), "cost_cents_effective": F.col("cost_cents_effective") * 2 + 1})
    gone = m.where(e % 7 == 2).withColumns({"id": F.concat("id", F.lit("-gone")), "model": F.lit("gone")})
    before = m.where(e % 7 >= 2).unionByName(older).unionByName(gone)
    return _out(r.maintained(r.hourly(before), r.change_set(m.where(e % 7 <= 1), older.unionByName(gone))), "bucket_start")


query("r03_change_sets", f"SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS bucket_start, {_R} FROM msg GROUP BY ALL")(_kept_by_changes)


def _refresh(s, d):
    m = a.messages(s, d)
    stale = r.hourly(m.where("NOT (day(timestamp) = 7 AND id LIKE '%3')"))
    return _out(r.refreshed(stale, m, s.sql("SELECT DATE'2024-01-07' AS day")), "bucket_start")


query("r03_refreshed_rollup", f"SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS bucket_start, {_R} FROM msg GROUP BY ALL")(_refresh)
_TOTALS = f"SELECT count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, {SUMS}, {COST} FROM msg WHERE timestamp >= TIMESTAMP '%s' AND timestamp < TIMESTAMP '%s'"


def _routed(since, until):
    def run(s, d):
        m = a.messages(s, d)
        h = r.hourly(m)
        return r.summary_routed(TimeWindow.parse(since, until), m, h, r.daily(h))

    return run


query("r04_summary_from_days", _TOTALS % ("2024-01-05", "2024-01-20"))(_routed("2024-01-05", "2024-01-20"))
query("r04_summary_from_hours", _TOTALS % ("2024-01-05 03:00:00", "2024-01-20"))(_routed("2024-01-05 03:00:00", "2024-01-20"))
query("r04_summary_from_messages", _TOTALS % ("2024-01-05 03:00:01", "2024-01-20"))(_routed("2024-01-05 03:00:01", "2024-01-20"))

_SESS = (
    "sess",
    """SELECT session_id AS id, max(d_provider) AS provider, min(timestamp) AS started_at, max(timestamp) AS ended_at,
arg_max(repo_id, {'t': timestamp, 'i': id}) FILTER (repo_id IS NOT NULL AND repo_id <> '') AS repo_id, arg_max(git_branch, {'t': timestamp, 'i': id}) FILTER (git_branch IS NOT NULL AND git_branch <> '') AS git_branch FROM msg WHERE session_id IS NOT NULL GROUP BY 1""",
)
_MODAL = (
    "modal",
    "SELECT session_id, d_surface AS surface FROM (SELECT session_id, d_surface, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, d_surface) AS k FROM msg WHERE session_id IS NOT NULL AND d_surface <> 'unknown' GROUP BY 1, 2) WHERE k = 1",
)
_SESSION_COLUMNS = "s.id, provider, started_at, ended_at, repo_id, git_branch, coalesce(surface, 'unknown') AS surface, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms"
query("a01_sessions", f"SELECT {_SESSION_COLUMNS} FROM sess s LEFT JOIN modal ON modal.session_id = s.id", _SESS, _MODAL)(lambda s, d: r.sessions(a.messages(s, d)))
query(
    "q24_session_audit",
    """SELECT d_provider AS provider, count(*) AS total_messages, count(*) FILTER (session_id IS NULL) AS missing_session_id, count(*) FILTER (session_id IS NOT NULL AND NOT ends_with(session_id, '5')) AS orphan_messages,
round(100.0 * CAST(count(session_id) AS DOUBLE) / count(*), 4) AS coverage_pct FROM asst GROUP BY 1""",
)(lambda s, d: b.session_audit(a.messages(s, d), r.sessions(a.messages(s, d)).where("id LIKE '%5'")))
_NOW = datetime(2024, 1, 25, 12, 0)
_SEEN = "SELECT '{w}' AS \"window\", (SELECT count(DISTINCT session_id) FROM asst WHERE timestamp >= TIMESTAMP '{t}' AND timestamp < TIMESTAMP '2024-01-25 12:00:00') AS message_sessions, (SELECT count(*) FROM sess WHERE ended_at >= TIMESTAMP '{t}' AND ended_at < TIMESTAMP '2024-01-25 12:00:00') AS listed_sessions"
query(
    "q25_session_visibility",
    f"SELECT *, message_sessions <> listed_sessions AS mismatch FROM ({' UNION ALL '.join(_SEEN.format(w=w, t=t) for w, t in (('today', '2024-01-25'), ('7d', '2024-01-18'), ('30d', '2023-12-26')))}) WHERE message_sessions > 0 OR listed_sessions > 0",
    _SESS,
)(lambda s, d: b.session_visibility(a.messages(s, d), r.sessions(a.messages(s, d)), _NOW))


def _list(alias: str, column: str) -> str:
    return f"(SELECT session_id, list(v ORDER BY c DESC, n DESC, v) AS {alias} FROM (SELECT session_id, {column} AS v, sum(cents) AS c, count(*) AS n FROM f WHERE {column} <> '(untagged)' GROUP BY 1, 2) GROUP BY 1) l_{alias} ON l_{alias}.session_id = g.session_id"


_F = ("f", f"SELECT * FROM asst WHERE session_id IS NOT NULL AND {IN_WINDOW} AND d_provider IN ('codex', 'cursor')")
_L_SQL = f"""SELECT g.*, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms, coalesce(array_to_string(models, '|'), '') AS models, coalesce(array_to_string(repo_ids, '|'), '') AS repo_ids, coalesce(surface, 'unknown') AS surface
FROM (SELECT session_id, max(d_provider) AS provider, min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS message_count, {SUMS}, {COST}, CASE WHEN count(*) FILTER (cost_confidence LIKE '%estimated%') > 0 THEN 'estimated' ELSE 'exact' END AS cost_confidence FROM f GROUP BY 1) g
LEFT JOIN {_list('models', 'd_model')} LEFT JOIN {_list('repo_ids', 'd_project')}
LEFT JOIN (SELECT session_id, d_surface AS surface FROM (SELECT session_id, d_surface, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, d_surface) AS k FROM f WHERE d_surface <> 'unknown' GROUP BY 1, 2) WHERE k = 1) m ON m.session_id = g.session_id"""


def _flat(df):
    return df.withColumns({c: F.coalesce(F.array_join(c, "|"), F.lit("")) for c in ("models", "repo_ids")}).drop("git_branches")


def _session_list(s, d, **kind):
    m = a.messages(s, d)
    return l.session_list(m, r.sessions(m), a.tags(s, d), WINDOW, DimFilters(providers=("codex", "cursor")), **kind)


query("l01_session_list", _L_SQL, _F)(lambda s, d: _flat(_session_list(s, d)))
query("l01_session_list_page", _L_SQL + " ORDER BY cost_cents DESC, g.session_id LIMIT 10 OFFSET 5", _F)(lambda s, d: _flat(_session_list(s, d, sort="cost_cents", limit=10, offset=5)))
query(
    "l01_session_list_ticket",
    _L_SQL,
    (_F[0], _F[1] + " AND session_id IN (SELECT session_id FROM asst JOIN tags ON tags.message_id = asst.id WHERE key = 'ticket_id' AND value = 'OPS-1' AND " + IN_WINDOW + " AND d_provider IN ('codex', 'cursor'))"),
)(lambda s, d: _flat(_session_list(s, d, ticket="OPS-1")))
query(
    "l02_session_detail",
    f"SELECT {_SESSION_COLUMNS}, message_count, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, cost_cents FROM sess s LEFT JOIN modal ON modal.session_id = s.id JOIN (SELECT session_id, count(*) AS message_count, {SUMS}, {COST} FROM asst GROUP BY 1) g ON g.session_id = s.id WHERE s.id = 's7-2024-01-12'",
    _SESS, _MODAL,
)(lambda s, d: l.session_detail(a.messages(s, d), r.sessions(a.messages(s, d)), "s7-2024-01-12"))
query(
    "l04_message_list",
    "SELECT id, session_id, timestamp, provider, model, repo_id, git_branch, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, CAST(cents AS DOUBLE) AS cost_cents, NULL::VARCHAR AS title FROM asst WHERE contains(lower(coalesce(git_branch, '')), 'pava') ORDER BY cost_cents DESC, id LIMIT 50",
)(lambda s, d: l.message_list(a.messages(s, d), r.sessions(a.messages(s, d)), search="PAVA", sort="cost_cents"))
query(
    "l05_session_messages",
    """SELECT m.id, m.session_id, CASE WHEN role = 'assistant' THEN count(*) FILTER (role = 'assistant') OVER (PARTITION BY m.session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) END AS assistant_sequence, coalesce(t.tools, '') AS tools, coalesce(t.tags, '') AS tags FROM msg m
LEFT JOIN (SELECT message_id, string_agg(DISTINCT value, '|' ORDER BY value) FILTER (key = 'tool') AS tools, string_agg(DISTINCT key || '=' || value, '|' ORDER BY key || '=' || value) FILTER (key <> 'tool') AS tags FROM tags GROUP BY 1) t ON t.message_id = m.id WHERE m.session_id IS NOT NULL""",
)(lambda s, d: l.session_messages(a.messages(s, d), a.tags(s, d)).select("id", "session_id", "assistant_sequence", F.array_join("tools", "|").alias("tools"), F.array_join("tags", "|").alias("tags")))
query(
    "l07_message_curve",
    "SELECT session_id, id, row_number() OVER w AS seq, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, CAST(cents AS DOUBLE) AS cost_cents, CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_cost_cents FROM asst WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, id)",
)(lambda s, d: l.message_curve(a.messages(s, d)))
query("l08_session_tags", "SELECT DISTINCT session_id, key, value FROM tags JOIN msg ON msg.id = tags.message_id WHERE session_id IS NOT NULL")(lambda s, d: l.session_tags(a.messages(s, d), a.tags(s, d)))
query(
    "l10_session_cwd",
    "SELECT session_id, cwd FROM (SELECT session_id, cwd, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, cwd) AS k FROM msg WHERE session_id IS NOT NULL AND cwd IS NOT NULL GROUP BY 1, 2) WHERE k = 1",
)(lambda s, d: l.session_cwd(a.messages(s, d)))
query("l11_cost_lag_hint", "SELECT id, provider = 'cursor' AND ended_at > TIMESTAMP '2024-01-25 11:50:00' AS cost_lag_hint FROM sess", _SESS)(
    lambda s, d: l.cost_lag_hint(r.sessions(a.messages(s, d)), _NOW).select("id", "cost_lag_hint")
)
