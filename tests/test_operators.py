"""Operators on small literal frames, and the invariants that hold between them."""

import hashlib
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenledger.functions.dims import DimFilters, TimeWindow
from tokenledger.operators import breakdowns as b
from tokenledger.operators import enrich as e
from tokenledger.operators import exports as x
from tokenledger.operators import health as h
from tokenledger.operators import merge as m
from tokenledger.operators import pricing as p
from tokenledger.operators import rollups as r
from tokenledger.operators import sessions as s
from tokenledger.plans import adapters as a

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
MESSAGE = "id string, session_id string, role string, timestamp timestamp, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cwd string, repo_id string, provider string, cost_cents_ingested double, cost_cents_effective double, parent_uuid string, git_branch string, cost_confidence string, request_id string, pricing_source string, surface string"
NAMES = [c.split()[0] for c in MESSAGE.split(", ")]


def messages(spark, *rows):
    base = dict.fromkeys(NAMES) | {"role": "assistant", "timestamp": T0, "input_tokens": 0, "output_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0, "cost_cents_ingested": 0.0, "cost_cents_effective": 0.0, "session_id": "s"}
    out = []
    for k, row in enumerate(rows):
        d = base | {"id": f"m{k}", "timestamp": T0 + timedelta(seconds=k)} | row
        if isinstance(d["timestamp"], (int, float)):
            d["timestamp"] = T0 + timedelta(seconds=d["timestamp"])
        out.append(tuple(d[n] for n in NAMES))
    return spark.createDataFrame(out, MESSAGE)


@pytest.fixture(scope="module")
def real(spark):
    return a.messages(spark, DATA).cache(), a.tags(spark, DATA).cache()


@pytest.mark.parametrize("limit", [3, 0])
def test_rows_and_other_make_up_the_total(spark, real, limit):
    rows, tags = real
    for filters in (DimFilters(providers="codex"),) if limit else (DimFilters(),):
        total = b.usage_summary(rows.where("role = 'assistant'"), filters=filters).first().cost_cents
        for breakdown, key in ((b.ticket_cost(rows, tags, filters=filters), "ticket_id"), (b.tag_cost_branches(rows, tags, "activity", "(untagged)", filters=filters), None), (b.model_usage(rows, filters=filters), "model")):
            if key is None:
                assert breakdown.agg(F.sum("cost_cents")).first()[0] <= total + 1e-6
                continue
            page = b.page(breakdown, key, limit).collect()
            assert abs(sum(q.cost_cents for q in page) - page[0].total_cost_cents) < 1e-6
            assert abs(page[0].total_cost_cents - total) < 1e-4  # shares are rounded to 8 places
            assert len(page) <= limit + 1 or not limit


def test_partitions_add_up(real):
    rows, _ = real
    total = b.usage_summary(rows).first()
    for stats in (b.provider_stats(rows), b.surface_stats(rows)):
        got = stats.agg(F.sum("total_messages").alias("n"), F.sum("input_tokens").alias("i")).first()
        assert (got.n, got.i) == (total.total_messages, total.input_tokens)


def test_rollups_follow_messages(spark, real):
    rows, _ = real
    hours = r.hourly(rows)
    assert r.drift(r.daily(hours), r.daily(hours), ("bucket_day", *r.DIMS)).count() == 0
    changed = rows.withColumn("output_tokens", F.when(F.col("id") == "m5", 10**6).otherwise(F.col("output_tokens")))
    day = rows.where("id = 'm5'").select(F.col("timestamp").cast("date").alias("day"))
    assert r.drift(hours, r.hourly(changed), ("bucket_start", *r.DIMS)).count() == 1
    assert r.drift(r.refreshed(hours, changed, day), r.hourly(changed), ("bucket_start", *r.DIMS)).count() == 0


def test_split_cost(spark):
    rows = messages(spark, {"cost_cents_effective": 10.0, "input_tokens": 5}, {"cost_cents_effective": 1.0})
    tags = spark.createDataFrame([("m0", "ticket_id", "A-1"), ("m0", "ticket_id", "B-2"), ("m0", "ticket_id", "A-1"), ("m0", "ticket_source", "branch")], "message_id string, key string, value string")
    got = {t.ticket_id: (t.cost_cents, t.input_tokens, t.source) for t in b.ticket_cost(rows, tags).collect()}
    assert got == {"A-1": (5.0, 2, "branch"), "B-2": (5.0, 2, "branch"), "(untagged)": (1.0, 0, "")}
    assert b.ticket_detail(rows, tags, "none").count() == 0
    assert {t.value for t in b.tag_stats(rows, tags, "repo").collect()} == {"(untagged)"}


def test_pricing(spark):
    prices = spark.createDataFrame([("m", 1e-6, 2e-6, None, 5e-7), ("bad", -1.0, 1e-6, None, None), ("high", 2e-3, 1e-6, None, None), ("nan", float("nan"), 1e-6, None, None)], "model string, input_cost_per_token double, output_cost_per_token double, cache_creation_input_token_cost double, cache_read_input_token_cost double")
    aliases = spark.createDataFrame([("alias", "m")], "alias string, canonical string")
    rows = messages(spark, {"model": "alias", "input_tokens": 10**6, "output_tokens": 10**6}, {"model": "x", "input_tokens": 1}, {"model": "m"}, {"role": "user"}).drop("cost_cents_ingested", "cost_cents_effective", "pricing_source")  # none is known yet
    got = [(q.cost_cents_effective, q.pricing_source) for q in p.priced(rows, prices, aliases).orderBy("id").collect()]
    assert got == [(300.0, "manifest:v1:alias"), (0.0, "unknown"), (0.0, "manifest:v1"), (0.0, "unpriced:no_tokens")]
    kept, refused, fine = p.checked_prices(prices, prices.where("model = 'm'"))
    assert [q.model for q in kept.collect()] == ["m"] and [q.model for q in refused.collect()] == ["bad", "high", "nan"] and fine
    assert not p.checked_prices(prices, prices)[2]
    more = prices.where("model = 'm'").union(spark.createDataFrame([("x", 1.0e-6, 0.0, None, None)], prices.schema))
    later = p.backfilled(p.priced(rows, prices, aliases), more, aliases, 7).orderBy("id").collect()
    assert [q.pricing_source for q in later][:2] == ["manifest:v1:alias", "backfilled:v7"] and later[1].cost_cents_effective == 0.0001
    cost = spark.createDataFrame([(100, 10, 50, 0, 20, True, 2)], "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, long_writes long, fast boolean, n long")
    unit = {k: F.lit(float(v)) for k, v in {"input": 1, "output": 2, "write": 3, "read": 4}.items()}
    assert cost.select(p.cost_cents(unit, F.col("long_writes"), F.col("fast"), F.col("n"))).first()[0] == pytest.approx(((100 + 20 + 30 * 3 + 20 * 2) * 6 / 1e6 + 0.02) * 100)
    labels = spark.createDataFrame([("backfilled:v12",), ("unknown",), ("unpriced:no_tokens",), (None,)], "c string").select(p.pricing_label(F.col("c")).alias("l")).collect()
    assert [(q.l.kind, q.l.version) for q in labels] == [("backfilled", 12), ("unknown", None), ("unpriced", None), (None, None)]


OPUS = ("opus", 5e-6, 25e-6, 6.25e-6, 0.5e-6)
RATED = "model string, input_cost_per_token double, output_cost_per_token double, cache_creation_input_token_cost double, cache_read_input_token_cost double"


def call(spark, *rows):
    """Assistant rows of the staging schema, as parsers give them."""
    from tokenledger.sources.transcripts import STAGING

    base = {"role": "assistant", "model": "opus", "provider": "claude_code", "input_tokens": 0, "output_tokens": 0, "cache_creation_tokens": 0, "cache_read_tokens": 0, "cache_creation_1h_tokens": 0, "web_search_requests": 0}
    schema = ", ".join(f"{k} {v}" for k, v in STAGING.items())
    return spark.createDataFrame([tuple(({**base, "id": f"c{k}", **r}).get(c) for c in STAGING) for k, r in enumerate(rows)], schema)


def test_costs_of_enrichment(spark):
    prices, aliases = spark.createDataFrame([OPUS, ("named", 1e-6, 1e-6, None, None)], RATED), spark.createDataFrame([("o", "opus"), ("named", "opus"), ("lost", "nowhere")], "alias string, canonical string")
    m = 10**6
    cases = [
        ({"input_tokens": m, "output_tokens": 100_000, "speed": "standard"}, 750.0, "manifest:v4", "estimated"),
        ({"input_tokens": m, "output_tokens": 100_000, "speed": "fast"}, 4500.0, "manifest:v4", "estimated"),
        ({"cache_creation_tokens": m, "cache_creation_1h_tokens": m}, 1000.0, "manifest:v4", "estimated"),
        ({"cache_creation_tokens": m, "cache_creation_1h_tokens": 200_000}, 700.0, "manifest:v4", "estimated"),
        ({"cache_creation_tokens": m, "cache_creation_1h_tokens": 3 * m}, 1000.0, "manifest:v4", "estimated"),
        ({"web_search_requests": 5}, 5.0, "manifest:v4", "estimated"),
        ({"input_tokens": m, "speed": "fast", "web_search_requests": 10}, 3010.0, "manifest:v4", "estimated"),
        ({"model": "o", "input_tokens": m}, 500.0, "manifest:v4:alias", "estimated"),
        ({"model": "named", "input_tokens": m}, 100.0, "manifest:v4", "estimated"),  # its own price, though it is an alias too
        ({"model": "lost", "input_tokens": m, "web_search_requests": 9}, 0.0, "unknown", "estimated_unknown_model"),
        ({"model": None, "input_tokens": m}, 0.0, "unknown", "estimated_unknown_model"),
        ({"input_tokens": m, "cost_cents_ingested": 777.0, "cost_confidence": "exact"}, 777.0, "upstream:api", "exact"),
        ({"input_tokens": m, "cost_cents_ingested": 0.0, "cost_confidence": "exact"}, 0.0, "upstream:api", "exact"),
        ({"model": "lost", "cost_cents_ingested": 3.0, "cost_confidence": ""}, 3.0, "upstream:api", "estimated"),
        ({"role": "user", "model": None}, 0.0, "unpriced:no_tokens", None),
        ({"role": "user", "input_tokens": m, "speed": "fast"}, 0.0, None, None),
    ]
    got = {r.id: r for r in p.priced(call(spark, *[c[0] for c in cases]), prices, aliases, 4).collect()}
    for k, (row, cents, source, sure) in enumerate(cases):
        r = got[f"c{k}"]
        assert (r.cost_cents_ingested, r.cost_cents_effective, r.pricing_source, r.cost_confidence) == (cents, cents, source, sure), row
    tags = {(r.key, r.value) for r in e.cost_tags(p.priced(call(spark, {"speed": "standard"}, {"speed": "fast", "model": None}), prices, aliases)).collect()}
    assert tags == {("provider", "claude_code"), ("model", "opus"), ("speed", "fast"), ("cost_confidence", "estimated"), ("cost_confidence", "estimated_unknown_model")}


def test_bills(spark):
    rows = messages(spark, {"model": "m", "cost_cents_effective": 1.0, "cost_cents_ingested": 1.0}, {"model": "m", "cost_cents_effective": 3.0, "cost_cents_ingested": 3.0}, {"model": "z"}, {"model": "z"}, {"model": "q", "cost_cents_effective": 5.0})
    bill = spark.createDataFrame([(date(2024, 1, 1), "m", 8.0), (date(2024, 1, 1), "z", 3.0), (date(2024, 1, 1), "q", 0.0)], "date date, model string, amount_in_cents double")
    got = [(q.cost_cents_ingested, q.cost_cents_effective, q.cost_confidence) for q in p.reconciled(rows, bill).orderBy("id").collect()]
    assert got == [(2.0, 2.0, "exact"), (6.0, 6.0, "exact"), (0.0, 1.5, "estimated"), (0.0, 1.5, "estimated"), (0.0, 5.0, None)]
    runs = spark.createDataFrame([("c1", 1, 0), ("c1", 2, 0), ("c2", 1, 0), ("c2", 2, 3), ("c2", 3, 0)], "cycle_end string, run_at int, n_rows int")
    assert {q.cycle_end: q.org_managed for q in p.org_managed(runs).collect()} == {"c1": True, "c2": False}


def test_team_rates(spark):
    rates = spark.createDataFrame([(1, "m*", "g", "input", 1.0), (2, "m1", "g", "input", 2.0), (3, "m*", "eu", "output", 9.0)], "row_no int, model_pattern string, region string, token_type string, sale_usd_per_mtok double")
    rows = messages(spark, {"model": "m1", "input_tokens": 10**6}, {"model": "m2", "input_tokens": 10**6}, {"model": "m2", "output_tokens": 1, "cost_cents_ingested": 4.0}, {"model": "z", "input_tokens": 1, "cost_cents_ingested": 5.0})
    assert [q.cost_cents_effective for q in p.repriced(rows, rates, "g").orderBy("id").collect()] == [200.0, 100.0, 4.0, 5.0]
    assert [q.cost_cents_effective for q in p.repriced(rows, None).orderBy("id").collect()] == [0.0, 0.0, 4.0, 5.0]


USES = "id string, session_id string, role string, timestamp timestamp, tool_names array<string>, tool_use_ids array<string>, tool_files array<string>, tool_outcomes array<struct<tool_use_id:string,outcome:string>>, cwd string"


def test_tool_outcomes_and_retries(spark):
    at = lambda k: T0 + timedelta(seconds=k)
    rows = [
        ("a1", "s", "assistant", at(1), ["Edit"], ["t1"], ["src/x"], [], "/r"), ("u1", "s", "user", at(2), [], [], [], [("t1", "error")], None),
        ("a2", "s", "assistant", at(3), ["Edit", " Bash "], ["t2", "t3"], [], [], "/r"), ("u2", "s", "user", at(4), [], [], [], [("t3", "denied"), ("t3", "success")], None),
        ("a3", "s", "assistant", at(5), ["Edit"], ["t4"], [], [], "/r"), ("a4", "s", "assistant", at(6), ["Edit"], ["t5"], [], [], "/r"), ("u4", "s", "user", at(7), [], [], [], [("t5", "success")], None),
        ("a5", "z", "assistant", at(8), ["Edit"], ["t6"], [], [], "/r"),
    ]
    got = {(q.message_id, q.use_id): (q.outcome, q.source, q.confidence) for q in e.tool_outcomes(spark.createDataFrame(rows, USES)).collect()}
    real = ("tool_result", "high")
    assert got == {("a1", "t1"): ("error", *real), ("a2", "t2"): ("retry", "heuristic", "medium"), ("a2", "t3"): ("denied", *real), ("a4", "t5"): ("success", *real)}
    tags = {(q.message_id, q.key, q.value) for q in e.tool_tags(spark.createDataFrame(rows, USES)).collect()}
    assert ("a2", "tool", "Bash") in tags and ("a2", "tool_use_id", "t3") in tags
    assert {q.key for q in e.tool_outcome_tags(spark.createDataFrame(rows, USES)).collect()} == {"tool_outcome", "tool_outcome_source", "tool_outcome_confidence"}


def test_carried_context_and_activity(spark):
    rows = messages(spark, {"git_branch": "b1", "role": "user"}, {"git_branch": None}, {"git_branch": ""}, {"git_branch": None}, {"git_branch": None, "session_id": None}, {"git_branch": None, "session_id": "t"})
    assert [q.git_branch for q in e.carried_context(rows).orderBy("id").collect()] == ["b1", "b1", "", "b1", None, None]
    texts = rows.withColumn("text", F.when(F.col("role") == "user", "please fix the crash bug"))
    carried = e.carried_context(e.classified(texts))
    tags = {(q.message_id, q.key, q.value) for q in e.activity_tags(carried).collect()}
    assert ("m1", "activity", "bugfix") in tags and ("m3", "activity_confidence", "high") in tags and not any(t[0] in ("m0", "m4", "m5") for t in tags)


def test_merge_and_rekey(spark):
    stored = messages(spark, {"id": "old", "request_id": "r", "output_tokens": 5, "cost_cents_effective": 1.0}, {"id": "same", "request_id": "q"})
    batch = messages(spark, {"id": "n1", "request_id": "r", "output_tokens": 9, "cost_cents_effective": 2.0}, {"id": "n2", "request_id": "r", "output_tokens": 3}, {"id": "same", "request_id": "q", "output_tokens": 99}, {"id": "n3", "request_id": None}, {"id": "n4", "request_id": "r", "session_id": "other"})
    rows, ids = m.merged(stored, batch)
    assert {q.id: (q.output_tokens, q.cost_cents_effective) for q in rows.collect()} == {"old": (9, 2.0), "same": (0, 0.0), "n3": (0, 0.0), "n4": (0, 0.0)}
    tags = spark.createDataFrame([("n1", "k", "v"), ("n2", "k", "v"), ("n3", "k", "w")], "message_id string, key string, value string")
    assert {tuple(q) for q in m.rekeyed(tags, ids).collect()} == {("old", "k", "v"), ("n3", "k", "w")}
    assert [q.id for q in m.dedup_requests(batch.withColumn("line_no", F.col("id")), "line_no").orderBy("id").collect()] == ["n1", "n3", "same"]


def test_windows_in_time(spark):
    windows = spark.createDataFrame([("a", 0, 10_000), ("b", 5_000, 20_000), ("open", 7_200_000, None)], "session_id string, start_ms long, end_ms long")
    points = spark.createDataFrame([("p1", 6_000), ("p2", 2_000), ("p3", 24_000), ("p4", 26_000), ("p5", 7_200_000 + 86_400_000), ("p6", -4_000)], "id string, at_ms long")
    assert {q.id: q.session_id for q in m.in_interval(points, windows).collect()} == {"p1": "b", "p2": "a", "p3": "b", "p5": "open", "p6": "a"}
    rows = messages(spark, {"session_id": None, "timestamp": 3}, {"session_id": "keep"})
    near = windows.withColumns({"start_ms": F.col("start_ms") + int(T0.timestamp() * 0) + 1704067200000, "end_ms": F.col("end_ms") + 1704067200000})
    assert [q.session_id for q in m.assigned_sessions(rows, near).orderBy("id").collect()] == ["a", "keep"]


def test_exact_matches(spark):
    x_ = lambda k, t, **o: {"id": k, "timestamp": t, "model": "m"} | o
    rows = messages(spark, x_("a", 0, request_id="r1"), x_("b", 100, input_tokens=7), x_("c", 200), x_("d", 300), x_("e", 400))
    exact = messages(spark, x_("A1", 0.5, request_id="zz"), x_("A2", 0.9, request_id="r1"), x_("B1", 100.2, input_tokens=7), x_("B2", 100.1, input_tokens=8), x_("C", 200.5, output_tokens=3), x_("D1", 300, input_tokens=1), x_("D2", 300, input_tokens=2), x_("E", 401.5))
    assert {q.id: (q.match, q.how) for q in m.matched_exact(rows, exact).collect()} == {"a": ("A2", "request"), "b": ("B1", "fingerprint"), "c": ("C", "sole")}


def test_repairs(spark):
    sessions = spark.createDataFrame([("s", "b", "/w", "h.x/a/b", "bugfix", T0, T0, "{}", "e@x"), ("old", None, None, None, None, T0 - timedelta(days=100), None, "{}", "e@x")], "id string, git_branch string, workspace_root string, repo_id string, prompt_category string, started_at timestamp, ended_at timestamp, raw_json string, user_email string")
    rows = messages(spark, {"git_branch": ""}, {"git_branch": "own"}, {"session_id": "t", "git_branch": None}, {"session_id": "t", "git_branch": "sib"})
    assert [q.git_branch for q in m.repaired_branches(rows, sessions).orderBy("id").collect()] == ["b", "own", "sib", "sib"]
    assert [(q.cwd, q.repo_id) for q in m.repaired_context(rows, sessions).orderBy("id").collect()][:2] == [("/w", "h.x/a/b")] * 2
    kept = {q.id: (q.raw_json, q.user_email) for q in m.retained(sessions, T0 + timedelta(days=31)).collect()}
    assert kept == {"s": (None, "e@x"), "old": (None, None)}
    none = spark.createDataFrame([("m1", "activity", "ops"), ("m1", "branch", "x")], "message_id string, key string, value string")
    got = {(q.message_id, q.key, q.value) for q in m.activity_backfill(rows, none, sessions, T0 + timedelta(days=1)).collect()}
    assert got == {("m0", "activity", "bugfix"), ("m0", "activity_source", "session"), ("m0", "activity_confidence", "low")}
    assert m.without_legacy_tags(none).count() == 1
    titles = spark.createDataFrame([("short",), ("x" * 10 + " " + "word " * 30,), ("first\nsecond",)], "t string").select(m.truncated_title(F.col("t"))).collect()
    assert titles[0][0] == "short" and titles[2][0] == "first" and titles[1][0].endswith("word…") and len(titles[1][0]) <= 81
    raw = '{"cwd":"/w","n":1,"b":true,"e":"é","in":{"cwd":"/secret","x":[{"project_dir":"/p"}]},"workspace_roots":["/a"," ",3],"user_email":{"cwd":"/deep"}}'
    j = spark.createDataFrame([(raw,), ("no json",), (None,)], "j string")
    assert [q[0] for q in j.select(m.minimized_json(F.col("j"), "omit")).collect()] == [None, None, None]
    assert [q[0] for q in j.select(m.minimized_json(F.col("j"), "full")).collect()] == [raw, "no json", None]
    got = [q[0] for q in j.select(m.minimized_json(F.col("j"), "hash")).collect()]
    h = lambda x: "sha256:" + hashlib.sha256(x.encode()).hexdigest()[:24]
    assert got[1:] == [None, None] and json.loads(got[0]) == {
        "cwd": h("/w"), "n": 1, "b": True, "e": "é", "in": {"cwd": h("/secret"), "x": [{"project_dir": h("/p")}]}, "workspace_roots": [h("/a"), " ", 3], "user_email": {"cwd": h("/deep")},
    }
    assert not any(x in got[0] for x in ("/w", "/secret", "/p", "/deep"))
    assert j.select(m.minimized(F.lit("a@b"), "hash")).first()[0].startswith("sha256:")
    with pytest.raises(ValueError):
        m.minimized(F.lit("x"), "maybe")


def test_long_and_open_windows(spark):
    day = 86_400_000
    windows = spark.createDataFrame([("long", 0, 50 * day), ("open", 60 * day, None), ("short", 100 * day, 100 * day)], "session_id string, start_ms long, end_ms long")
    points = spark.createDataFrame([("in", 40 * day), ("late", 50 * day + 6000), ("edge", 50 * day + 4000), ("o", 89 * day), ("past", 91 * day), ("s", 100 * day)], "id string, at_ms long")
    assert {q.id: q.session_id for q in m.in_interval(points, windows).collect()} == {"in": "long", "edge": "long", "o": "open", "s": "short"}
    assert m.in_interval(points, windows.where("false")).count() == 0


def test_watermarks_outlive_a_reset(spark, tmp_path):
    path = f"{tmp_path}/w"
    assert x.read_watermark(spark, path) is None
    seen = []
    for day in (date(2024, 1, 3), date(2024, 1, 9), None, date(2024, 1, 1)):
        x.write_watermark(spark, path, day)
        seen.append(x.read_watermark(spark, path))
    assert seen == [date(2024, 1, 3), date(2024, 1, 9), None, date(2024, 1, 1)]


def test_models_not_known_yet_merge(spark):
    rows = messages(spark, {"id": "a", "model": "default", "provider": "cursor", "cost_cents_effective": 0.0}, {"id": "b", "model": None, "provider": "cursor"}, {"id": "c", "model": "", "provider": "codex", "cost_cents_effective": 3.0}, {"id": "d", "model": "gpt-5.3-codex-high", "provider": "codex"})
    shown, hidden = b.model_page(b.labelled_models(rows))
    assert {(q.model, q.provider, q.message_count) for q in shown.collect()} == {("(model not yet attributed)", "codex", 1), ("GPT-5.3 Codex · high", "codex", 1)}
    assert hidden.first().suppressed_rows == 1
    assert b.model_page(b.labelled_models(rows), include_pending=True)[0].count() == 3


def test_sessions(spark, real):
    rows, tags = real
    table = r.sessions(rows)
    assert s.resolve_session(rows, table, "nothing") == ("none", None) and s.resolve_session(rows, table, "s1")[0] == "ambiguous"
    one = table.orderBy("id").first().id
    assert s.resolve_session(rows, table, one) == ("unique", one)
    assert s.session_detail(rows, spark.createDataFrame([("lone",)], "id string"), "lone").first().message_count == 0
    listed = s.session_list(rows, table, sort="cost_cents").collect()
    assert [q.cost_cents for q in listed] == sorted((q.cost_cents for q in listed), reverse=True)
    with pytest.raises(ValueError):
        s.session_list(rows, table, sort="drop table")
    assert s.message_list(rows, table, search="100%_").count() == 0
    assert s.message_detail(rows, tags, "m5").count() == 1
    curve = s.message_curve(rows).groupBy("session_id").agg(F.max("cumulative_cost_cents").alias("c")).join(s.session_list(rows, table), "session_id")
    assert curve.where(F.abs(F.col("c") - F.col("cost_cents")) > 1e-9).count() == 0
    hint = spark.createDataFrame([("a", "cursor", T0), ("b", "cursor", T0 - timedelta(minutes=10)), ("c", "codex", T0)], "id string, provider string, ended_at timestamp")
    assert [q.cost_lag_hint for q in s.cost_lag_hint(hint, T0).orderBy("id").collect()] == [True, False, False]
    w = spark.createDataFrame([("a", 5, 9, None, "r", None), ("a", 3, 7, "/w", "", "b")], "session_id string, start_ms long, end_ms long, workspace_root string, repo_id string, git_branch string")
    assert tuple(r.session_windows(w.limit(1), w.offset(1), 10).first()) == ("a", 3, 9, "/w", "r", "b")


def test_health_states(spark):
    heavy = [{"model": "m", "input_tokens": n, "cost_cents_effective": c} for n, c in ((1000, 1.0), (1000, 1.0), (1000, 1.0), (40_000, 20.0), (40_000, 20.0), (40_000, 20.0))]
    rows = messages(spark, *heavy, {"session_id": "calm", "model": "m"})
    events = spark.createDataFrame([("s", k, T0 + timedelta(seconds=k), "post_tool_use_failure", "Bash") for k in range(5)], "session_id string, seq long, ts timestamp, event string, tool_name string")
    got = {q.session_id: q for q in h.session_health(rows, events).collect()}
    assert (got["s"].context_drag, got["s"].cache_efficiency, got["s"].thrashing, got["s"].cost_acceleration, got["s"].state) == ("red",) * 5
    assert got["calm"].state == "insufficient_data"
    assert h.health_tips(h.session_health(rows, events)).count() == 4
    cut = events.limit(0).union(spark.createDataFrame([("s", 9, T0 + timedelta(seconds=2), "pre_compact", None)], events.schema))
    assert h.session_health(rows, cut).where("session_id = 's'").first().context_drag is None
    asked = messages(spark, {"role": "user"}, {"request_id": "q", "cost_cents_effective": 1.0, "session_id": "c", "provider": "copilot_chat"})
    assert {q.session_id: q.prompt_count for q in h.prompt_counts(asked).collect()} == {"s": 1, "c": 1}


def test_exports(spark, real, tmp_path):
    rows, _ = real
    days, table = r.daily(r.hourly(rows)), r.sessions(rows)
    assert set(x.daily_export(days, None, date(2024, 1, 1)).columns) == set(x.ROLLUP_COLUMNS) and not {"cwd", "user_email", "text"} & {*x.ROLLUP_COLUMNS, *x.SESSION_COLUMNS}
    path = f"{tmp_path}/mark"
    assert x.read_watermark(spark, path) is None
    x.write_watermark(spark, path, date(2024, 1, 9))
    assert x.read_watermark(spark, path) == date(2024, 1, 9)
    n = x.pending(days, rows, table, date(2024, 1, 9), date(2024, 1, 1), datetime(2024, 1, 20)).first()
    assert n.rollups == x.daily_export(days, date(2024, 1, 9), date(2024, 1, 1)).count() and n.sessions == x.session_export(rows, table, datetime(2024, 1, 20)).count()
    chunks = x.chunked_days(days, 100).groupBy("bucket_day").agg(F.count_distinct("chunk_id").alias("n")).where("n > 1")
    assert chunks.count() == 0 and not x.stale_shape(days) and x.stale_shape(days.withColumn("wire_shape_version", F.lit(0)))
    x.write_days(rows, f"{tmp_path}/days")
    x.write_days(rows.where("day(timestamp) = 3").limit(0), f"{tmp_path}/days")
    x.write_days(rows.where("day(timestamp) = 3").limit(1), f"{tmp_path}/days")
    back = spark.read.parquet(f"{tmp_path}/days")
    assert back.where("day(timestamp) = 3").count() == 1 and back.count() == rows.where("day(timestamp) <> 3").count() + 1


def test_audits(spark):
    rows = messages(spark, {"session_id": None, "timestamp": 10}, {"session_id": "x"}, {"session_id": "s"})
    sess = spark.createDataFrame([("s", T0)], "id string, ended_at timestamp")
    assert tuple(b.session_audit(rows, sess).first()) == ("claude_code", 3, 1, 1, pytest.approx(66.6667))
    seen = {q.window: (q.message_sessions, q.listed_sessions, q.mismatch) for q in b.session_visibility(rows, sess, T0 + timedelta(hours=1)).collect()}
    assert seen == {w: (2, 1, True) for w in ("today", "7d", "30d")}
    line = b.statusline(rows.withColumn("cost_cents_effective", F.lit(250.4)), T0 + timedelta(hours=30), session="x").first()
    assert (line.cost_1d, line.cost_7d, line.session_cost, line.active_provider) == (0.0, 7.51, 2.5, "claude_code")
    assert b.usage_summary(rows, TimeWindow(since=T0 + timedelta(seconds=2))).first().total_messages == 2
