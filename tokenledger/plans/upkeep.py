"""Registered health, enrichment and merge queries with their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions import text as t
from ..operators import enrich as e
from ..operators import health as h
from ..operators import merge as m
from ..operators import rollups as r
from . import adapters as a
from .adapters import with_ctes

Q, SQL = {}, {}


def query(name, sql=None, *extra):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = with_ctes(sql, *extra)
        return f

    return add


_EV = ("ev", a.TOOL_EVENTS.format(events="events"))
_KEPT = (
    ("cuts", "SELECT session_id, max(ts) AS cut FROM ev WHERE event = 'pre_compact' GROUP BY 1"),
    ("flagged", "SELECT x.*, cut, coalesce(timestamp > cut, true) AS behind, max(coalesce(timestamp > cut, true)) OVER (PARTITION BY x.session_id) AS has_some FROM asst x LEFT JOIN cuts ON cuts.session_id = x.session_id WHERE x.session_id IS NOT NULL"),
    ("kept", "SELECT * FROM flagged WHERE behind OR NOT has_some"),
    ("best", "SELECT session_id AS s, model AS best FROM (SELECT session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, model) AS k FROM kept WHERE model IS NOT NULL GROUP BY 1, 2) WHERE k = 1"),
    ("dom", "SELECT kept.* FROM kept LEFT JOIN best ON best.s = kept.session_id WHERE model IS NOT DISTINCT FROM best"),
    ("edges", "SELECT session_id, CAST(input_tokens + cache_creation_tokens + cache_read_tokens AS DOUBLE) AS size, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS a, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS z FROM dom"),
    ("drag", """SELECT session_id, CASE WHEN l / f >= 6 AND (l >= 24000 OR l - f >= 12000) THEN 'red' WHEN l / f >= 3 AND (l >= 12000 OR l - f >= 6000) THEN 'yellow' ELSE 'green' END AS context_drag
 FROM (SELECT session_id, count(*) AS n, avg(size) FILTER (a <= 3) AS f, avg(size) FILTER (z <= 3) AS l FROM edges GROUP BY 1) WHERE n >= 5 AND f > 0"""),
    ("tail", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS z, sum(CASE WHEN model IS NOT DISTINCT FROM lastm THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC ROWS UNBOUNDED PRECEDING) AS breaks
 FROM (SELECT *, first_value(model) OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS lastm FROM kept)) WHERE breaks = 0"""),
    ("reuse", """SELECT session_id, CASE WHEN rd / wh < 0.35 THEN 'red' WHEN rd / wh < 0.6 THEN 'yellow' ELSE 'green' END AS cache_efficiency FROM (SELECT session_id, count(*) AS n, CAST(sum(cache_read_tokens) FILTER (z <= 6) AS DOUBLE) AS rd, CAST(sum(input_tokens + cache_read_tokens) FILTER (z <= 6) AS DOUBLE) AS wh FROM tail GROUP BY 1) WHERE n >= 4 AND wh > 0"""),
    ("turns", "SELECT *, count(*) FILTER (event = 'user_prompt_submit') OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS turn FROM ev"),
    ("uses", "SELECT *, CASE WHEN tool_name IS NOT DISTINCT FROM lag(tool_name) OVER (PARTITION BY session_id, turn ORDER BY ts, seq) THEN 0 ELSE 1 END AS new FROM turns WHERE event IN ('post_tool_use', 'post_tool_use_failure')"),
    ("runs", "SELECT session_id, turn, tool_name, event, ts, sum(new) OVER (PARTITION BY session_id, turn ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM uses"),
    ("turned", """SELECT x.session_id, x.turn, n, f, secs, tools, repeated, longest FROM (SELECT session_id, turn, count(*) AS n, count(*) FILTER (event = 'post_tool_use_failure') AS f, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS secs, count(DISTINCT tool_name) AS tools FROM runs GROUP BY 1, 2) x
 JOIN (SELECT session_id, turn, max(c) AS repeated FROM (SELECT session_id, turn, tool_name, count(*) FILTER (event = 'post_tool_use_failure') AS c FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2) y ON x.session_id = y.session_id AND x.turn = y.turn
 JOIN (SELECT session_id, turn, max(c) AS longest FROM (SELECT session_id, turn, run, count(*) AS c FROM runs GROUP BY 1, 2, 3) GROUP BY 1, 2) z ON x.session_id = z.session_id AND x.turn = z.turn"""),
    ("thrash", """SELECT session_id, CASE WHEN s >= 2 THEN 'red' WHEN s >= 1 THEN 'yellow' ELSE 'green' END AS thrashing FROM (SELECT session_id, sum(CASE WHEN n < 4 THEN 0 WHEN repeated >= 5 OR (longest >= 4 AND secs <= 90 AND f >= 4) THEN 2
 WHEN repeated >= 3 OR (f >= 4 AND f * 2 >= n AND secs <= 120) OR (f >= 2 AND ((longest >= 4 AND secs <= 90) OR (n >= 8 AND tools <= 2 AND secs <= 90))) THEN 1 ELSE 0 END) AS s FROM turned GROUP BY 1)"""),
    ("prompt", "SELECT ev.session_id, ts FROM ev LEFT JOIN cuts ON cuts.session_id = ev.session_id WHERE event = 'user_prompt_submit' AND coalesce(ts > cut, true)"),
    ("placed", "SELECT session_id, id, timestamp, cents, (SELECT count(*) FROM prompt p WHERE p.session_id = dom.session_id AND p.ts <= dom.timestamp) AS turn FROM dom"),
    ("costs", """SELECT session_id, 1 AS asked, CAST(turn AS VARCHAR) AS u, min(timestamp) AS t, min(id) AS o, sum(cents) AS c FROM placed WHERE turn > 0 GROUP BY session_id, turn
 UNION ALL SELECT session_id, 0, id, timestamp, id, cents FROM placed WHERE session_id NOT IN (SELECT session_id FROM placed WHERE turn > 0)"""),
    ("halves", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, o) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM costs"),
    ("accel", """SELECT session_id, CASE WHEN b / a >= 4 AND b >= 12 THEN 'red' WHEN b / a >= 2 AND b >= 5 THEN 'yellow' ELSE 'green' END AS cost_acceleration FROM (SELECT session_id, n, asked, CAST(sum(c) AS DOUBLE) AS total, CAST(sum(c) FILTER (i <= n // 2) AS DOUBLE) / (n // 2) AS a,
 CAST(sum(c) FILTER (i > n // 2) AS DOUBLE) / (n - n // 2) AS b FROM halves GROUP BY 1, 2, 3) WHERE n >= CASE WHEN asked = 1 THEN 4 ELSE 6 END AND total >= 25 AND a > 0"""),
    ("vitals", """SELECT s.session_id, context_drag, cache_efficiency, thrashing, cost_acceleration FROM (SELECT DISTINCT session_id FROM msg WHERE session_id IS NOT NULL) s LEFT JOIN drag ON drag.session_id = s.session_id LEFT JOIN reuse ON reuse.session_id = s.session_id
 LEFT JOIN thrash ON thrash.session_id = s.session_id LEFT JOIN accel ON accel.session_id = s.session_id"""),
)
_ANY = "coalesce(context_drag = '{0}', false) OR coalesce(cache_efficiency = '{0}', false) OR coalesce(thrashing = '{0}', false) OR coalesce(cost_acceleration = '{0}', false)".format
_MISSING = "(context_drag IS NULL)::INT + (cache_efficiency IS NULL)::INT + (thrashing IS NULL)::INT + (cost_acceleration IS NULL)::INT"
query(
    "h10_session_health",
    f"SELECT *, CASE WHEN {_ANY('red')} THEN 'red' WHEN {_ANY('yellow')} THEN 'yellow' WHEN {_MISSING} >= 3 THEN 'insufficient_data' ELSE 'green' END AS state FROM vitals",
    _EV, *_KEPT,
)(lambda s, d: h.session_health(a.messages(s, d), a.tool_events(s, d)))
_TIPS = " UNION ALL ".join(f"SELECT '{v}' AS vital, '{s}' AS vital_state, '{tip}' AS tip" for (v, s), tip in h.TIPS.items())
query(
    "h09_health_tips",
    f"SELECT session_id, x.vital, x.vital_state, tip FROM (UNPIVOT vitals ON context_drag, cache_efficiency, thrashing, cost_acceleration INTO NAME vital VALUE vital_state) x JOIN ({_TIPS}) p ON p.vital = x.vital AND p.vital_state = x.vital_state",
    _EV, *_KEPT,
)(lambda s, d: h.health_tips(h.session_health(a.messages(s, d), a.tool_events(s, d))))
query(
    "h11_prompt_counts",
    """SELECT session_id, CASE WHEN u = 0 AND p = 'copilot_chat' THEN q ELSE u END AS prompt_count FROM (SELECT session_id, count(*) FILTER (role = 'user') AS u, count(DISTINCT request_id) FILTER (role = 'assistant' AND cents > 0) AS q, max(provider) AS p FROM msg WHERE session_id IS NOT NULL GROUP BY 1)""",
)(lambda s, d: h.prompt_counts(a.messages(s, d)))
_COMMITS = "SELECT 'github.com/acme/r' || CAST(user_id % 6 AS STRING) AS repo_id, CASE WHEN event_id % 8 = 1 THEN 'refs/heads/PAVA-12-login' ELSE 'fix/1234-typo' END AS branch, 'c' || CAST(event_id AS STRING) AS sha, ts, event_id % 5 = 0 AS on_integration FROM {events} WHERE event_id % 40 IN (1, 2)"
_BRANCHES = "SELECT 'github.com/acme/r' || CAST(k % 6 AS STRING) AS repo_id, CASE WHEN k < 6 THEN 'refs/heads/PAVA-12-login' ELSE 'fix/1234-typo' END AS branch, k % 3 = 0 AS merged, k % 2 = 0 AS same_tip FROM (SELECT DISTINCT event_id % 12 AS k FROM {events}) x"
_SESS = (
    "sess",
    """SELECT session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at, arg_max(repo_id, {'t': timestamp, 'i': id}) FILTER (repo_id IS NOT NULL AND repo_id <> '') AS repo_id,
 arg_max(git_branch, {'t': timestamp, 'i': id}) FILTER (git_branch IS NOT NULL AND git_branch <> '') AS git_branch FROM msg WHERE session_id IS NOT NULL GROUP BY 1""",
)
query(
    "h12_work_outcomes",
    """SELECT s.id AS session_id, CASE WHEN b.branch IS NULL THEN 'unknown' WHEN merged AND NOT same_tip THEN 'branch_merged' WHEN coalesce(n, 0) > 0 THEN 'committed' ELSE 'no_commit' END AS work_outcome, coalesce(n, 0) AS commits FROM sess s LEFT JOIN br b ON b.repo_id = s.repo_id AND b.branch = s.git_branch
LEFT JOIN (SELECT s.id, count(DISTINCT sha) AS n FROM sess s JOIN co ON co.repo_id = s.repo_id AND co.branch = s.git_branch AND NOT on_integration AND co.ts BETWEEN s.started_at AND s.ended_at + INTERVAL 24 HOUR GROUP BY 1) c ON c.id = s.id""",
    _SESS, ("br", _BRANCHES.format(events="events")), ("co", _COMMITS.format(events="events")),
)(lambda s, d: h.work_outcomes(r.sessions(a.messages(s, d)), s.sql(_COMMITS, events=a.table(s, d, "events")), s.sql(_BRANCHES, events=a.table(s, d, "events"))))

# enrichment
_PREV = lambda c: f"coalesce({c}, last_value(nullif({c}, '') IGNORE NULLS) OVER (PARTITION BY coalesce(session_id, id) ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS {c}"
query("e01_carried_context", f"SELECT id, {_PREV('git_branch')}, {_PREV('repo_id')}, {_PREV('cwd')} FROM base")(
    lambda s, d: e.carried_context(a.raw_messages(s, d)).select("id", "git_branch", "repo_id", "cwd")
)
query(
    "e02_identity_tags",
    "SELECT f.message_id, 'machine' AS key, v AS value FROM (SELECT DISTINCT coalesce(session_id, id) AS s, surface AS v FROM base WHERE surface IS NOT NULL AND surface <> '') x JOIN (SELECT coalesce(session_id, id) AS s, arg_min(id, {'t': timestamp, 'i': id}) AS message_id FROM base WHERE role = 'assistant' GROUP BY 1) f ON f.s = x.s",
)(lambda s, d: e.identity_tags(a.raw_messages(s, d), {"machine": "surface"}))
_DENIED = ", ".join(f"'{x}'" for x in t.TICKET_DENYLIST)
_TK = (
    "tk",
    f"""SELECT id, CASE WHEN br IN ('main', 'master', 'develop', 'HEAD') OR br = '' THEN NULL WHEN named IS NOT NULL THEN upper(named) WHEN digits <> '' THEN digits END AS ticket, CASE WHEN named IS NOT NULL THEN 'branch' ELSE 'branch_numeric' END AS source FROM (
 SELECT id, br, list_filter(regexp_extract_all(br, '[A-Za-z]{{2,}}-[0-9]+'), lambda x: upper(split_part(x, '-', 1)) NOT IN ({_DENIED}))[1] AS named, regexp_extract(regexp_extract(br, '[^/]*$'), '^([0-9]+)(-|$)', 1) AS digits
 FROM (SELECT id, regexp_replace(git_branch, '^refs/heads/', '') AS br FROM base WHERE role = 'assistant' AND git_branch IS NOT NULL))""",
)
query(
    "e03_ticket_tags",
    "SELECT id AS message_id, 'ticket_id' AS key, ticket AS value FROM tk WHERE ticket IS NOT NULL UNION ALL SELECT id, 'ticket_source', source FROM tk WHERE ticket IS NOT NULL UNION ALL SELECT id, 'ticket_prefix', split_part(ticket, '-', 1) FROM tk WHERE contains(ticket, '-')",
    _TK,
)(lambda s, d: e.ticket_tags(a.raw_messages(s, d)))
query(
    "e07_cost_tags",
    "SELECT id AS message_id, 'provider' AS key, provider AS value FROM msg WHERE role = 'assistant' AND provider <> '' UNION ALL SELECT id, 'model', model FROM msg WHERE role = 'assistant' AND model <> '' UNION ALL SELECT id, 'cost_confidence', cost_confidence FROM msg WHERE role = 'assistant' AND cost_confidence <> '' UNION ALL SELECT id, 'speed', speed FROM msg WHERE role = 'assistant' AND speed = 'fast'",
)(lambda s, d: e.cost_tags(a.messages(s, d)))
_RULES = "SELECT 'team' AS key, 'core' AS value, 'github.com/acme/r?' AS match_repo UNION ALL SELECT 'org', 'acme', NULL UNION ALL SELECT 'team', 'four', '*/r4'"
query(
    "e08_rule_tags",
    "SELECT DISTINCT id AS message_id, key, value FROM base JOIN ru ON match_repo IS NULL OR (match_repo = '*/r4' AND ends_with(repo_id, '/r4')) OR (match_repo LIKE '%?' AND regexp_full_match(repo_id, 'github\\.com/acme/r.')) WHERE role = 'assistant'",
    ("ru", _RULES),
)(lambda s, d: e.rule_tags(a.raw_messages(s, d), s.sql(_RULES)))


def _classes() -> str:
    hits = ", ".join("(" + " + ".join(f"regexp_matches(low, '{pr.word_pattern(w).replace(chr(39), chr(39) * 2)}')::INT" for w in ws) + f") AS h_{k}" for k, ws in pr.KEYWORDS.items())
    starts = lambda ps: " OR ".join("starts_with(low, '%s')" % p for p in ps)
    return f"""SELECT *, {hits}, ({starts(pr.QUESTION_STARTS)}) AS asks, ({starts(pr.BUGFIX_STARTS)}) AS acts, ends_with(low, '?') AS asked FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user')"""


_CASES = [("bugfix", "h_bugfix", "h_bugfix > 0 AND (acts OR NOT asks)"), ("refactor", "h_refactor", "h_refactor > 0"), ("testing", "h_testing", "h_testing > 0"), ("feature", "h_plan", "h_plan > 0"), ("review", "h_review", "h_review > 0"),
          ("ops", "h_ops", "h_ops > 0"), ("question", "greatest(h_question, asked::INT)", "h_question > 0 OR asked"), ("docs", "h_docs", "h_docs > 0"), ("writing", "h_writing", "h_writing > 0"), ("feature", "h_feature", "h_feature > 0")]
query(
    "e10_prompt_classes",
    f"""SELECT conv_id, turn, category, CASE WHEN hits >= 2 THEN 'high' WHEN hits = 1 AND (strlen(low) >= 40 OR asks OR acts) THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, CASE {' '.join(f"WHEN {w} THEN '{c}'" for c, _, w in _CASES)} END AS category, CASE {' '.join(f"WHEN {w} THEN {n}" for _, n, w in _CASES)} END AS hits FROM cl)
WHERE category IS NOT NULL AND NOT starts_with(low, '/') AND strlen(low) >= 5 AND NOT (starts_with(low, '<') AND NOT contains(low, ' '))""",
    ("cl", _classes()),
)(lambda s, d: a.table(s, d, "conversations").where("role = 'user'").withColumn("c", pr.classify(F.col("text"))).where("c IS NOT NULL").select("conv_id", "turn", "c.category", "c.confidence"))
query(
    "e13_surfaces",
    "SELECT id, coalesce(nullif(lower(surface), ''), CASE provider WHEN 'claude_code' THEN 'terminal' WHEN 'codex' THEN 'terminal' WHEN 'cursor' THEN 'cursor' WHEN 'copilot_chat' THEN 'vscode' ELSE 'unknown' END) AS surface FROM base",
)(lambda s, d: e.with_surface(a.raw_messages(s, d)).select("id", "surface"))

# merges and repairs
query("d01_dedup_requests", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY coalesce(request_id, id) ORDER BY output_tokens DESC, id) AS k FROM base) WHERE k = 1")(
    lambda s, d: m.dedup_requests(a.raw_messages(s, d), "id").select("id")
)


_E = "CAST(substr(id, 2) AS BIGINT) % 3"


def _merge(s, d):
    rows = a.messages(s, d).where("role = 'assistant'")
    return m.merged(rows.where(f"{_E} = 0"), rows.where(f"{_E} <> 0"))[0].select("id", "output_tokens", "cost_cents_effective")


# every row is stored or in the batch; a batch row without a session meets its request in any session
query(
    "d02_merged",
    """SELECT s.id, greatest(s.output_tokens, coalesce(b.output_tokens, 0)) AS output_tokens, CASE WHEN b.output_tokens > s.output_tokens THEN b.cost_cents_effective ELSE s.cost_cents_effective END AS cost_cents_effective FROM st s LEFT JOIN best b ON b.old = s.id
UNION ALL SELECT id, output_tokens, cost_cents_effective FROM ba WHERE old IS NULL""",
    ("st", f"SELECT * FROM asst WHERE {_E} = 0"), ("own", "SELECT request_id, session_id, min(id) AS o FROM st WHERE session_id IS NOT NULL GROUP BY 1, 2"), ("anyone", "SELECT request_id, min(id) AS o FROM st GROUP BY 1"),
    ("ba", f"SELECT a.*, coalesce(own.o, CASE WHEN a.session_id IS NULL THEN anyone.o END) AS old FROM asst a LEFT JOIN own ON own.request_id = a.request_id AND own.session_id = a.session_id LEFT JOIN anyone ON anyone.request_id = a.request_id WHERE CAST(substr(a.id, 2) AS BIGINT) % 3 <> 0"),
    ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY output_tokens DESC, id) AS k FROM ba WHERE old IS NOT NULL) WHERE k = 1"),
)(_merge)


def _all_windows(s, d):
    ms = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000)
    return r.sessions(a.messages(s, d)).select(F.col("id").alias("session_id"), ms("started_at").alias("start_ms"), ms("ended_at").alias("end_ms"))


#: Rows without a session and the session whose window they fall into.
BY_TIME = """SELECT p.id, arg_min(w.session_id, {'a': CASE WHEN p.t BETWEEN w.a AND w.b THEN 0 ELSE 1 END, 'b': CASE WHEN p.t BETWEEN w.a AND w.b THEN p.t - w.a ELSE least(abs(p.t - w.a), abs(p.t - w.b)) END, 'c': -w.a, 'd': w.session_id}) AS session_id
FROM (SELECT id, epoch_us(timestamp) // 1000 AS t FROM base WHERE session_id IS NULL) p JOIN (SELECT id AS session_id, epoch_us(started_at) // 1000 AS a, epoch_us(ended_at) // 1000 AS b FROM sess) w ON p.t BETWEEN w.a - 5000 AND w.b + 5000 GROUP BY 1"""
query("j03_sessions_by_time", BY_TIME, _SESS)(  # every session's window
    lambda s, d: m.in_interval(a.raw_messages(s, d).where("session_id IS NULL").select("id", F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).alias("at_ms")), _all_windows(s, d))
)
query(
    "d05_repaired_branches",
    """SELECT b.id, coalesce(nullif(b.git_branch, ''), nullif(s.git_branch, ''), o.g) AS git_branch FROM base b LEFT JOIN sess s ON s.id = b.session_id LEFT JOIN (SELECT session_id, arg_min(git_branch, {'t': timestamp, 'i': id}) AS g FROM base WHERE git_branch <> '' AND session_id IS NOT NULL GROUP BY 1) o ON o.session_id = b.session_id""",
    _SESS,
)(lambda s, d: m.repaired_branches(a.raw_messages(s, d), r.sessions(a.messages(s, d))).select("id", "git_branch"))
_NOW = datetime(2024, 2, 1)
query(
    "d06_ticket_backfill",
    "SELECT id AS message_id, 'ticket_id' AS key, ticket AS value FROM tk2 UNION ALL SELECT id, 'ticket_source', source FROM tk2 UNION ALL SELECT id, 'ticket_prefix', split_part(ticket, '-', 1) FROM tk2 WHERE contains(ticket, '-')",
    _TK, ("tk2", "SELECT * FROM tk WHERE ticket IS NOT NULL AND id NOT IN (SELECT message_id FROM tags WHERE key = 'ticket_id' AND value LIKE 'OPS%')"),
)(lambda s, d: m.ticket_backfill(a.raw_messages(s, d), a.tags(s, d).where("value LIKE 'OPS%'"), _NOW))
query(
    "d08_session_titles",
    "SELECT session_id, value AS title FROM (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, value) AS k FROM tags JOIN base ON base.id = tags.message_id WHERE key = 'session_title' AND session_id IS NOT NULL GROUP BY 1, 2) WHERE k = 1",
)(lambda s, d: m.session_titles(a.raw_messages(s, d), a.tags(s, d)))
query("d09_first_prompts", "SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1")(
    lambda s, d: a.table(s, d, "conversations").where("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"))
)
_LINE = "trim(regexp_replace(split_part(trim(text), chr(10), 1), '\\s+', ' ', 'g'))"
query(
    "d09_prompt_titles",
    f"""SELECT conv_id, CASE WHEN length(line) <= 80 THEN line WHEN substr(line, 81, 1) = ' ' THEN rtrim(left(line, 80)) || '…' ELSE regexp_replace(left(line, 80), '\\s+\\S*$', '') || '…' END AS title
FROM (SELECT conv_id, {_LINE} AS line FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1))""",
)(lambda s, d: m.first_prompt_titles(a.table(s, d, "conversations"), "conv_id", "turn"))
query(
    "d10_purged_tickets",
    "SELECT t.message_id, key, value FROM tags t LEFT JOIN bad ON bad.message_id = t.message_id WHERE bad.message_id IS NULL OR key NOT IN ('ticket_id', 'ticket_prefix', 'ticket_source')",
    ("bad", "SELECT DISTINCT message_id FROM tags WHERE key = 'ticket_id' AND starts_with(value, 'OPS-')"),
)(lambda s, d: m.purged_tickets(a.tags(s, d), ("OPS",)))
query("d12_false_repos", "SELECT id, CASE WHEN regexp_matches(repo_id, '^[^/]*\\.[^/]*/[^/]*/.*$') THEN repo_id END AS repo_id FROM base")(
    lambda s, d: m.without_false_repos(a.raw_messages(s, d)).select("id", "repo_id")
)
query("d16_before_first_legacy", "SELECT id FROM base WHERE timestamp < (SELECT min(timestamp) FROM base WHERE cost_confidence = 'otel_exact' AND id LIKE '%4')")(
    lambda s, d: m.before_first_legacy(a.raw_messages(s, d), a.raw_messages(s, d).where("cost_confidence = 'otel_exact' AND id LIKE '%4'")).select("id")
)
query("d18_minimized", "SELECT id, CASE WHEN cwd IS NOT NULL AND cwd <> '' THEN 'sha256:' || substr(sha256(cwd), 1, 24) ELSE cwd END AS cwd FROM base")(
    lambda s, d: a.raw_messages(s, d).select("id", m.minimized(F.col("cwd"), "hash").alias("cwd"))
)
query("d20_rollup_drift", "SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS bucket_start, count(*) AS n FROM (SELECT DISTINCT date_trunc('hour', timestamp) AS timestamp, coalesce(role, 'assistant'), d_provider, d_model, d_project, d_branch, d_surface FROM msg WHERE day(timestamp) = 7) GROUP BY 1")(
    lambda s, d: r.drift(r.hourly(a.messages(s, d).where("day(timestamp) <> 7")), r.hourly(a.messages(s, d)), ("bucket_start", *r.DIMS)).groupBy(F.col("bucket_start").cast("string").alias("bucket_start")).agg(F.count("*").alias("n"))
)
query(
    "d04_matched_exact",
    """SELECT id, match, how FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, match) AS k FROM (SELECT *, CASE WHEN same THEN 'request' WHEN sames = 0 AND pr AND prs = 1 THEN 'fingerprint' WHEN sames = 0 AND prs <> 1 AND n = 1 THEN 'sole' END AS how FROM (
SELECT x.id, y.id AS match, abs(epoch_us(x.timestamp) - epoch_us(y.timestamp)) AS gap, coalesce(x.request_id = y.request_id, false) AS same, x.input_tokens = y.input_tokens AND x.output_tokens = y.output_tokens AS pr, count(*) OVER (PARTITION BY x.id) AS n,
count(*) FILTER (coalesce(x.request_id = y.request_id, false)) OVER (PARTITION BY x.id) AS sames, count(*) FILTER (x.input_tokens = y.input_tokens AND x.output_tokens = y.output_tokens) OVER (PARTITION BY x.id) AS prs
FROM asst x JOIN asst y ON x.session_id = y.session_id AND x.model IS NOT DISTINCT FROM y.model AND abs(epoch_us(x.timestamp) - epoch_us(y.timestamp)) <= 7200000000 AND x.id <> y.id WHERE coalesce(x.cost_confidence, '') <> 'otel_exact' AND y.cost_confidence = 'otel_exact')) WHERE how IS NOT NULL) WHERE k = 1""",
)(lambda s, d: m.matched_exact(a.messages(s, d).where("role = 'assistant' AND coalesce(cost_confidence, '') <> 'otel_exact'"), a.messages(s, d).where("role = 'assistant' AND cost_confidence = 'otel_exact'"), 7200))

# scalar functions over tables
query("f04_page_hosts", "SELECT page_id, CASE WHEN strpos(u, '/') > 0 AND length(u) > strpos(u, '/') THEN lower(split_part(u, '/', 1)) END AS host FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', ''), '(\\.git)?/*$', '') AS u FROM pages)")(
    lambda s, d: a.table(s, d, "pages").select("page_id", F.split_part(t.repo_of_url(F.col("url")), F.lit("/"), F.lit(1)).alias("host"))
)
query("f08_stable_ids", "SELECT id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS uuid FROM (SELECT id, sha256(concat_ws(chr(31), coalesce(session_id, ''), coalesce(request_id, ''), id)) AS h FROM base)")(
    lambda s, d: a.raw_messages(s, d).select("id", t.uuid_of(F.col("session_id"), F.col("request_id"), F.col("id")).alias("uuid"))
)
