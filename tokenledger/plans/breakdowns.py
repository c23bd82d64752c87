"""Registered breakdown and pricing queries with their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.dims import DimFilters, TimeWindow
from ..operators import breakdowns as b
from ..operators import pricing as p
from . import adapters as a
from .adapters import with_ctes

SINCE, UNTIL = "2024-01-05", "2024-01-20"
WINDOW = TimeWindow.parse(SINCE, UNTIL)
FILTERS = DimFilters(providers=("codex, claude_code",), surfaces=("Terminal", "cursor", "unknown"), branches=("refs/heads/PAVA-12-login", "main", "fix/1234-typo", "(untagged)"))
NOW = datetime(2024, 1, 25, 12, 0)
IN_WINDOW = f"timestamp >= TIMESTAMP '{SINCE}' AND timestamp < TIMESTAMP '{UNTIL}'"
IN_FILTERS = "d_provider IN ('codex', 'claude_code') AND d_surface IN ('terminal', 'cursor', 'unknown') AND d_branch IN ('PAVA-12-login', 'main', 'fix/1234-typo', '(untagged)')"
BOTH = f"{IN_WINDOW} AND {IN_FILTERS}"

SUMS = "CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens"
COST = "CAST(coalesce(sum(cents), 0) AS DOUBLE) AS cost_cents"

Q, SQL = {}, {}


def query(name, sql=None, *extra):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_ctes(sql, *extra)
        return f

    return add


query("q01_usage_summary", f"""
SELECT count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, {SUMS}, {COST} FROM msg WHERE {BOTH}
""")(lambda s, d: b.usage_summary(a.messages(s, d), WINDOW, FILTERS))

query("q02_repo_usage", f"""
SELECT repo_id, display_path, message_count, input_tokens, output_tokens, cost_cents FROM (SELECT d_project AS repo_id, count(*) AS message_count, {SUMS}, {COST} FROM asst WHERE {IN_WINDOW} GROUP BY 1)
JOIN (SELECT d_project AS p, min(cwd) AS display_path FROM msg GROUP BY 1) ON p = repo_id
""")(lambda s, d: b.repo_usage(a.messages(s, d), WINDOW))

query("q03_non_repo_usage", f"""
SELECT regexp_extract(cwd, '[^/]*$', 0) AS name, min(cwd) AS sample_cwd, count(*) AS message_count, {COST} FROM asst WHERE d_project = '(untagged)' AND cwd IS NOT NULL GROUP BY 1
""")(lambda s, d: b.non_repo_usage(a.messages(s, d)))

query("q04_activity_chart_day", f"""
SELECT strftime(timestamp + INTERVAL 90 MINUTE, '%Y-%m-%d') AS bucket, count(*) AS message_count, {SUMS}, {COST} FROM asst WHERE {BOTH} GROUP BY 1
""")(lambda s, d: b.activity_chart(a.messages(s, d), "day", 90, WINDOW, FILTERS))

query("q04_activity_chart_hour", f"SELECT strftime(timestamp - INTERVAL 330 MINUTE, '%H') AS bucket, count(*) AS message_count, {SUMS}, {COST} FROM asst GROUP BY 1")(
    lambda s, d: b.activity_chart(a.messages(s, d), "hour", -330)
)
query("q04_activity_chart_month", f"SELECT strftime(timestamp, '%Y-%m') AS bucket, count(*) AS message_count, {SUMS}, {COST} FROM asst GROUP BY 1")(
    lambda s, d: b.activity_chart(a.messages(s, d), "month")
)
query("q05_branch_cost", f"""
SELECT d_branch AS branch, CASE WHEN d_branch = '(untagged)' OR d_project = '(untagged)' THEN '' ELSE d_project END AS repo_id, count(DISTINCT session_id) AS session_count, count(*) AS message_count, {SUMS}, {COST} FROM asst WHERE {IN_WINDOW} GROUP BY 1, 2
""")(lambda s, d: b.branch_cost(a.messages(s, d), WINDOW))
query("q06_branch_cost_single", f"""
SELECT d_branch AS branch, CASE WHEN count(DISTINCT d_project) = 1 THEN max(d_project) ELSE '' END AS repo_id, count(DISTINCT session_id) AS session_count, count(*) AS message_count, {SUMS}, {COST} FROM asst WHERE d_branch = 'PAVA-12-login' AND d_project = 'github.com/acme/r3' GROUP BY 1
""")(lambda s, d: b.branch_cost_single(a.messages(s, d), "PAVA-12-login", "github.com/acme/r3"))


def _split(key: str, where: str) -> tuple[str, str]:
    return (
        "split",
        f"""SELECT m.id, m.session_id, m.d_branch, m.d_project, coalesce(t.value, '(untagged)') AS value,
 m.input_tokens // coalesce(t.n, 1) AS input_tokens, m.output_tokens // coalesce(t.n, 1) AS output_tokens, m.cache_creation_tokens // coalesce(t.n, 1) AS cache_creation_tokens, m.cache_read_tokens // coalesce(t.n, 1) AS cache_read_tokens,
 CAST(CAST(m.cents AS DOUBLE) / coalesce(t.n, 1) AS DECIMAL(20,8)) AS cents
 FROM asst m LEFT JOIN (SELECT message_id, value, count(*) OVER (PARTITION BY message_id) AS n FROM (SELECT DISTINCT message_id, value FROM tags WHERE key = '{key}')) t ON t.message_id = m.id WHERE {where}""",
    )


query("q07_tag_stats_ticket", f"SELECT 'ticket_id' AS key, value, count(DISTINCT session_id) AS session_count, {COST} FROM split GROUP BY value", _split("ticket_id", BOTH))(
    lambda s, d: b.tag_stats(a.messages(s, d), a.tags(s, d), "ticket_id", WINDOW, FILTERS)
)
query("q07_tag_stats_all", f"SELECT key, value, count(DISTINCT session_id) AS session_count, {COST} FROM (SELECT DISTINCT message_id, key, value FROM tags) t JOIN asst ON t.message_id = asst.id WHERE {IN_WINDOW} GROUP BY key, value")(
    lambda s, d: b.tag_stats(a.messages(s, d), a.tags(s, d), None, WINDOW)
)
query("q07_tag_stats_branch", f"SELECT 'branch' AS key, d_branch AS value, count(DISTINCT session_id) AS session_count, {COST} FROM asst GROUP BY d_branch")(
    lambda s, d: b.tag_stats(a.messages(s, d), a.tags(s, d), "branch")
)


def _pick(column: str, name: str, by: str = "sum(cents)", source: str = "split") -> tuple[str, str]:
    return (
        f"p_{name}",
        f"SELECT value, {column} AS {name} FROM (SELECT value, {column}, row_number() OVER (PARTITION BY value ORDER BY {by} DESC, {column}) AS k FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN ('', '(untagged)') GROUP BY value, {column}) WHERE k = 1",
    )


def _labelled(*keys: str) -> tuple[str, str]:
    joins = " ".join(f"LEFT JOIN (SELECT message_id, min(value) AS l_{k} FROM tags WHERE key = '{k}' GROUP BY 1) j_{k} ON j_{k}.message_id = split.id" for k in keys)
    return ("labelled", f"SELECT split.*, {', '.join(f'l_{k}' for k in keys)} FROM split {joins} WHERE value <> '(untagged)'")


def _costs(value: str, names: list[str], more: str = "", where: str = "") -> str:
    joins = " ".join(f"LEFT JOIN p_{n} ON p_{n}.value = c.value" for n in names)
    return f"""SELECT c.value AS {value}, session_count, message_count, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, cost_cents, {', '.join(f"coalesce({n}, '') AS {n}" for n in names)}{more}
FROM (SELECT value, count(DISTINCT session_id) AS session_count, count(*) AS message_count, {SUMS}, {COST} FROM split GROUP BY value) c {joins} {where}"""


_TICKET = [_labelled("ticket_source"), _pick("d_branch", "top_branch"), _pick("d_project", "top_repo_id"), _pick("l_ticket_source", "source", source="labelled")]
_PREFIX = ", CASE WHEN contains(c.value, '-') THEN split_part(c.value, '-', 1) ELSE '' END AS ticket_prefix"
query("q08_ticket_cost", _costs("ticket_id", ["top_branch", "top_repo_id", "source"], _PREFIX), _split("ticket_id", "true"), *_TICKET)(
    lambda s, d: b.ticket_cost(a.messages(s, d), a.tags(s, d))
)
query("q08_ticket_cost_filtered", _costs("ticket_id", ["top_branch", "top_repo_id", "source"], _PREFIX), _split("ticket_id", BOTH), *_TICKET)(
    lambda s, d: b.ticket_cost(a.messages(s, d), a.tags(s, d), WINDOW, FILTERS)
)
query(
    "q09_ticket_detail",
    _costs("ticket_id", ["top_branch", "top_repo_id", "source"], _PREFIX, "WHERE c.value = 'OPS-1'").replace("coalesce(source, '')", "coalesce(source, 'branch')"),
    _split("ticket_id", "true"), *_TICKET,
)(lambda s, d: b.ticket_detail(a.messages(s, d), a.tags(s, d), "OPS-1"))
_BRANCHES = f"SELECT d_branch AS branch, d_project AS repo_id, count(DISTINCT session_id) AS session_count, count(*) AS message_count, {SUMS}, {COST} FROM split WHERE value = '%s' GROUP BY 1, 2"
query("q09_ticket_branches", _BRANCHES % "OPS-1", _split("ticket_id", "true"))(lambda s, d: b.tag_cost_branches(a.messages(s, d), a.tags(s, d), "ticket_id", "OPS-1"))
_ACTIVITY = [
    _labelled("activity_source", "activity_confidence"), _pick("d_branch", "top_branch"), _pick("d_project", "top_repo_id"),
    _pick("l_activity_source", "source", "count(*)", "labelled"), _pick("l_activity_confidence", "confidence", "count(*)", "labelled"),
]
query("q10_activity_cost", _costs("activity", ["top_branch", "top_repo_id", "source", "confidence"]), _split("activity", IN_WINDOW), *_ACTIVITY)(
    lambda s, d: b.activity_cost(a.messages(s, d), a.tags(s, d), WINDOW)
)
query("q10d_activity_detail", _costs("activity", ["top_branch", "top_repo_id", "source", "confidence"], where="WHERE c.value = 'bugfix'"), _split("activity", "true"), *_ACTIVITY)(
    lambda s, d: b.activity_detail(a.messages(s, d), a.tags(s, d), "bugfix")
)
query("q10d_activity_branches", _BRANCHES % "bugfix", _split("activity", "true"))(lambda s, d: b.tag_cost_branches(a.messages(s, d), a.tags(s, d), "activity", "bugfix"))


def _by(dim: str, name: str, where: str) -> str:
    return f"""SELECT d_{dim} AS {name}, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) FILTER (role = 'user') AS user_messages, count(*) AS total_messages, {SUMS}, {COST},
CAST(round(CAST(coalesce(sum(cents), 0) AS DOUBLE)) / 100 AS DOUBLE) AS cost_dollars FROM msg WHERE {where} GROUP BY 1"""


query("q11_provider_stats", _by("provider", "provider", IN_WINDOW))(lambda s, d: b.provider_stats(a.messages(s, d), WINDOW))
query("q12_surface_stats", _by("surface", "surface", BOTH))(lambda s, d: b.surface_stats(a.messages(s, d), WINDOW, FILTERS))
_FILE = [
    _labelled("ticket_id", "file_path_source"), _pick("d_branch", "top_branch"), _pick("d_project", "top_repo_id"),
    _pick("l_ticket_id", "top_ticket_id", source="labelled"), _pick("l_file_path_source", "source", source="labelled"),
]
_FILE_COLUMNS = ["top_branch", "top_repo_id", "top_ticket_id", "source"]
query("q13_file_cost", _costs("file_path", _FILE_COLUMNS), _split("file_path", BOTH), *_FILE)(lambda s, d: b.file_cost(a.messages(s, d), a.tags(s, d), WINDOW, FILTERS))
query("q13d_file_detail", _costs("file_path", _FILE_COLUMNS, where="WHERE c.value = 'src/f4.py'"), _split("file_path", "true"), *_FILE)(
    lambda s, d: b.file_detail(a.messages(s, d), a.tags(s, d), "src/f4.py")
)
query("q13d_file_branches", _BRANCHES % "src/f4.py", _split("file_path", "true"))(lambda s, d: b.tag_cost_branches(a.messages(s, d), a.tags(s, d), "file_path", "src/f4.py"))
query("q14_model_usage", f"SELECT d_model AS model, d_provider AS provider, count(*) AS message_count, {SUMS}, {COST} FROM asst WHERE {IN_WINDOW} GROUP BY 1, 2")(
    lambda s, d: b.model_usage(a.messages(s, d), WINDOW)
)
_RATED = (
    "rated",
    f"""SELECT g.*, p.model AS known, coalesce(p.input_cost_per_token, 0e0) * 1e6 AS pi, coalesce(p.output_cost_per_token, 0e0) * 1e6 AS po, coalesce(p.cache_creation_input_token_cost, 0e0) * 1e6 AS pw, coalesce(p.cache_read_input_token_cost, 0e0) * 1e6 AS pr
 FROM (SELECT d_provider, d_model, {SUMS}, {COST} FROM asst WHERE {BOTH} GROUP BY 1, 2) g LEFT JOIN alias a ON a.alias = g.d_model LEFT JOIN price p ON p.model = coalesce(a.canonical, g.d_model)""",
)
_D = "CAST({} AS DECIMAL(20,8))".format
query(
    "q15_cost_estimate",
    f"""SELECT round(CAST(t AS DOUBLE)) AS total_cents, round(CAST(i AS DOUBLE)) AS input_cents, round(CAST(o AS DOUBLE)) AS output_cents, round(CAST(w AS DOUBLE)) AS cache_write_cents, round(CAST(r AS DOUBLE)) AS cache_read_cents,
round(CAST(greatest(t - i - o - w - r, 0) AS DOUBLE)) AS other_cents, round(CAST(v AS DOUBLE)) AS cache_savings_cents FROM (SELECT coalesce(sum({_D('cost_cents')}), 0) AS t, coalesce(sum({_D('input_tokens * pi / 1e4')}), 0) AS i, coalesce(sum({_D('output_tokens * po / 1e4')}), 0) AS o,
coalesce(sum({_D('cache_creation_tokens * pw / 1e4')}), 0) AS w, coalesce(sum({_D('cache_read_tokens * pr / 1e4')}), 0) AS r, coalesce(sum({_D('cache_read_tokens * (pi - pr) / 1e4')}), 0) AS v FROM rated)""",
    _RATED,
)(lambda s, d: b.cost_estimate(a.messages(s, d), a.prices(s), a.aliases(s), WINDOW, FILTERS))
query(
    "q16_cache_efficiency",
    f"""SELECT CAST(i AS BIGINT) AS total_input_tokens, CAST(r AS BIGINT) AS total_cache_read_tokens, v AS cache_savings_cents, CASE WHEN i + r > 0 THEN round(CAST(r AS DOUBLE) / (i + r), 6) ELSE 0 END AS cache_hit_rate FROM (SELECT coalesce(sum(input_tokens), 0) AS i, coalesce(sum(cache_read_tokens), 0) AS r,
CAST(coalesce(sum(CASE WHEN known IS NOT NULL THEN {_D('cache_read_tokens * (pi - pr) / 1e4')} END), 0) AS DOUBLE) AS v FROM rated)""",
    _RATED,
)(lambda s, d: b.cache_efficiency(a.messages(s, d), a.prices(s), a.aliases(s), WINDOW, FILTERS))
query(
    "q17_session_cost_curve",
    """SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 60 THEN '31-60' WHEN n <= 100 THEN '61-100' ELSE '100+' END AS bucket, count(*) AS session_count, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avg_messages,
round(CAST(sum(c) AS DOUBLE) / sum(n), 6) AS avg_cost_per_message_cents, CAST(sum(c) AS DOUBLE) AS total_cost_cents FROM (SELECT session_id, count(*) AS n, sum(cents) AS c FROM asst WHERE session_id IS NOT NULL GROUP BY 1) GROUP BY 1""",
)(lambda s, d: b.session_cost_curve(a.messages(s, d)))
query("q18_cost_confidence", f"SELECT coalesce(cost_confidence, 'estimated') AS confidence, count(*) AS message_count, {COST} FROM asst WHERE {BOTH} GROUP BY 1")(
    lambda s, d: b.cost_confidence(a.messages(s, d), WINDOW, FILTERS)
)
query("q19_subagent_cost", f"SELECT CASE WHEN parent_uuid IS NOT NULL THEN 'subagent' ELSE 'main' END AS category, count(*) AS message_count, {SUMS}, {COST} FROM asst GROUP BY 1")(
    lambda s, d: b.subagent_cost(a.messages(s, d))
)
query(
    "q20_filter_options",
    f"SELECT dimension, value, count(*) AS message_count FROM ({' UNION ALL '.join(f'''SELECT '{x}' AS dimension, d_{x} AS value FROM asst WHERE {IN_WINDOW}''' for x in ('provider', 'model', 'project', 'branch', 'surface'))}) WHERE value <> '(untagged)' GROUP BY 1, 2",
)(lambda s, d: b.filter_options(a.messages(s, d), WINDOW))
_ROUND = "round(CAST(coalesce(sum(cents) FILTER ({}), 0) AS DOUBLE)) / 100".format
query(
    "q21_statusline",
    f"""SELECT {_ROUND("timestamp >= TIMESTAMP '2024-01-24 12:00:00'")} AS cost_1d, {_ROUND("timestamp >= TIMESTAMP '2024-01-18 12:00:00'")} AS cost_7d, {_ROUND("timestamp >= TIMESTAMP '2023-12-26 12:00:00'")} AS cost_30d,
{_ROUND("d_branch = 'main'")} AS branch_cost, {_ROUND("d_project = 'github.com/acme/r4'")} AS project_cost, (arg_max(d_provider, {{'t': timestamp, 'i': id}})) AS active_provider FROM asst WHERE timestamp >= TIMESTAMP '2023-12-26 12:00:00' AND timestamp < TIMESTAMP '2024-01-25 12:00:00'""",
)(lambda s, d: b.statusline(a.messages(s, d), NOW, branch="main", project="github.com/acme/r4"))
query("q22_status_snapshot", _by("provider", "provider", IN_FILTERS))(lambda s, d: b.status_snapshot(a.messages(s, d), a.prices(s), a.aliases(s), filters=FILTERS)["providers"])
query(
    "q23_breakdown_page",
    f"""SELECT label, message_count, CAST(c AS DOUBLE) AS cost_cents, CAST((SELECT sum(c) FROM g) AS DOUBLE) AS total_cost_cents FROM (
SELECT label, message_count, c FROM ranked WHERE k <= 4 UNION ALL SELECT '(other)', CAST(sum(message_count) AS BIGINT), sum(c) FROM ranked WHERE k > 4 HAVING count(*) > 0)""",
    _split("file_path", IN_WINDOW),
    ("g", "SELECT value AS label, count(*) AS message_count, CAST(sum(cents) AS DECIMAL(20,8)) AS c FROM split GROUP BY 1"),
    ("ranked", "SELECT *, row_number() OVER (ORDER BY c DESC, label) AS k FROM g"),
)(lambda s, d: b.page(b.file_cost(a.messages(s, d), a.tags(s, d), WINDOW), "file_path", 4))
query("q26_freshness", "SELECT max(timestamp) AS newest_data_at FROM asst")(lambda s, d: b.freshness(a.messages(s, d)))

# pricing
query("p01_priced_messages", "SELECT id, cost_cents_effective FROM msg")(lambda s, d: a.messages(s, d).select("id", "cost_cents_effective"))
_RATES = """SELECT 1 AS row_no, 'claude-*' AS model_pattern, 'global' AS region, 'input' AS token_type, 4.0e0 AS sale_usd_per_mtok UNION ALL SELECT 2, 'claude-*', 'global', 'output', 18.0e0 UNION ALL SELECT 3, 'claude-*', 'global', 'cache_write', 5.0e0
UNION ALL SELECT 4, 'claude-*', 'global', 'cache_read', 0.4e0 UNION ALL SELECT 5, 'claude-opus-4-6', 'global', 'input', 4.5e0 UNION ALL SELECT 6, 'gpt-5.3-codex', 'eu', 'input', 1.0e0 UNION ALL SELECT 7, 'gpt-5.3-codex', 'global', 'output', 10.0e0"""
_TEAM = (
    ("rates", _RATES),
    ("hit", "SELECT m.model, r.* EXCLUDE (model_pattern) FROM (SELECT DISTINCT model FROM base WHERE model IS NOT NULL) m JOIN rates r ON region = 'global' AND (m.model = model_pattern OR (ends_with(model_pattern, '*') AND starts_with(m.model, model_pattern[:-2])))"),
    ("own", "SELECT model, " + ", ".join(f"arg_max(sale_usd_per_mtok, row_no) FILTER (token_type = '{t}') AS {t}" for t in p.TOKEN_TYPES) + " FROM hit GROUP BY model"),
    ("re", """SELECT m.*, CASE WHEN role <> 'assistant' OR (input_tokens > 0 AND input IS NULL) OR (output_tokens > 0 AND output IS NULL) OR (cache_creation_tokens > 0 AND cache_write IS NULL) OR (cache_read_tokens > 0 AND cache_read IS NULL) THEN cost_cents_effective
 ELSE round((input_tokens * coalesce(input, 0) / 1e6 + output_tokens * coalesce(output, 0) / 1e6 + cache_creation_tokens * coalesce(cache_write, 0) / 1e6 + cache_read_tokens * coalesce(cache_read, 0) / 1e6) * 100, 8) END AS e FROM msg m LEFT JOIN own ON own.model = m.model"""),
)
query("p05_team_repricing", "SELECT id, e AS cost_cents_effective FROM re", *_TEAM)(lambda s, d: p.repriced(a.messages(s, d), s.sql(_RATES)).select("id", "cost_cents_effective"))
query(
    "p06_reprice_audit",
    "SELECT count(*) AS processed, count(*) FILTER (abs(e - cost_cents_effective) > 1e-9) AS changed, CAST(sum(cents) AS DOUBLE) AS before_cents, CAST(sum(CAST(e AS DECIMAL(20,8))) AS DOUBLE) AS after_cents FROM re",
    *_TEAM,
)(lambda s, d: p.reprice_audit(a.messages(s, d), p.repriced(a.messages(s, d), s.sql(_RATES))))
query(
    "p11_unknown_models",
    "SELECT b.model, count(*) AS messages FROM base b LEFT JOIN alias a ON a.alias = b.model LEFT JOIN price p ON p.model = coalesce(a.canonical, b.model) WHERE role = 'assistant' AND p.model IS NULL AND b.model IS NOT NULL AND b.cost_cents_ingested IS NULL GROUP BY 1",
)(lambda s, d: p.unknown_models(a.messages(s, d)))
_PRICED_BILL = "SELECT CAST(timestamp AS DATE) AS date, model, CAST(count(*) * 7 AS DOUBLE) AS amount_in_cents FROM {m} WHERE role = 'assistant' AND model IS NOT NULL AND model <> '<synthetic>' GROUP BY 1, 2"
query(
    "p07_reconciled_bill",
    """SELECT m.id, round(round(CASE WHEN s > 0 THEN cost_cents_effective * (amount_in_cents / s) WHEN amount_in_cents IS NOT NULL THEN amount_in_cents / n ELSE cost_cents_effective END, 8), 4) AS cents4,
CASE WHEN s > 0 THEN 'exact' WHEN amount_in_cents IS NOT NULL THEN 'estimated' ELSE cost_confidence END AS cost_confidence FROM msg m LEFT JOIN bill ON bill.date = CAST(m.timestamp AS DATE) AND bill.model = m.model
LEFT JOIN (SELECT CAST(timestamp AS DATE) AS d, model, CAST(sum(cents) AS DOUBLE) AS s, count(*) AS n FROM msg GROUP BY 1, 2) g ON g.d = bill.date AND g.model = bill.model""",
    ("bill", _PRICED_BILL.format(m="msg")),
)(lambda s, d: p.reconciled(a.messages(s, d), s.sql(_PRICED_BILL, m=a.messages(s, d))).select("id", F.round("cost_cents_effective", 4).alias("cents4"), "cost_confidence"))
