"""Session health: four vitals and a state for every session at once, work outcomes and tips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import MONEY
from .pricing import small

# Fixed values.
DRAG_RATIO, DRAG_INPUT, DRAG_DELTA = {"yellow": 3.0, "red": 6.0}, {"yellow": 12_000.0, "red": 24_000.0}, {"yellow": 6_000.0, "red": 12_000.0}
REUSE, REUSE_ROWS, REUSE_LEAST = {"yellow": 0.60, "red": 0.35}, 6, 4
ACCEL_RATIO, ACCEL_CENTS, ACCEL_SESSION_CENTS = {"yellow": 2.0, "red": 4.0}, {"yellow": 5.0, "red": 12.0}, 25.0
ACCEL_TURNS, ACCEL_REPLIES, DRAG_ROWS, DRAG_EDGE = 4, 6, 5, 3
VITALS = ("context_drag", "cache_efficiency", "thrashing", "cost_acceleration")
TIPS = {
    ("context_drag", "yellow"): "Context is growing: compact the session or start a new one for the next task.",
    ("context_drag", "red"): "Context has grown a lot: start a new session and bring only what it needs.",
    ("cache_efficiency", "yellow"): "Little of the prompt is reused: keep the model and the opening of the context stable.",
    ("cache_efficiency", "red"): "The cache is hardly used: avoid switching models and editing early context.",
    ("thrashing", "yellow"): "A tool keeps failing: look at its error before another try.",
    ("thrashing", "red"): "Tools fail in loops: stop and fix the cause by hand.",
    ("cost_acceleration", "yellow"): "Turns are becoming dearer: narrow the task.",
    ("cost_acceleration", "red"): "Turns cost several times what they did: split the work over new sessions.",
}


#: Rows of messages, or of events, that a task gets, about: windows and joins by session hold them several times.
PART_ROWS = 200_000


def _by_session(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a session, in as many parts as asked, which are not put together again: all that is asked by session finds them in place."""
    return rows.where("session_id IS NOT NULL").repartition(parts, "session_id")


def _state(red: Column, yellow: Column) -> Column:
    return F.when(red, "red").when(yellow, "yellow").otherwise("green")


def after_compaction(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Assistant rows behind their session's last compaction; all of a session if that leaves none."""
    rows = messages.where("session_id IS NOT NULL").where(F.coalesce(F.col("role"), F.lit("assistant")) == "assistant")
    last = events.where("event = 'pre_compact'").groupBy("session_id").agg(F.max("ts").alias("__cut"))
    met = rows.join(last, "session_id", "left")
    behind = F.col("__cut").isNull() | (F.col("timestamp") > F.col("__cut"))
    marked = met.withColumn("__behind", behind).withColumn("__some", F.max("__behind").over(W.partitionBy("session_id")))
    return marked.where("__behind OR NOT __some").drop("__cut", "__behind", "__some")


def dominant_model(rows: DataFrame) -> DataFrame:
    """Of each session the rows of its commonest model, ties to the smaller name; rows without a model if there is none."""
    n = rows.where("model IS NOT NULL").groupBy("session_id", "model").count()
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "model"))
    best = n.withColumn("k", top).where("k = 1").select("session_id", F.col("model").alias("__best"))
    return rows.join(best, "session_id", "left").where(F.col("model").eqNullSafe(F.col("__best"))).drop("__best")


def recent_run(rows: DataFrame) -> DataFrame:
    """Of each session the rows at its end that share the last row's model."""
    w = W.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    last = F.first("model").over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("__last", last).withColumn("__breaks", F.sum((~F.col("model").eqNullSafe(F.col("__last"))).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("__breaks = 0").drop("__last", "__breaks")


def context_drag(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("session_id")
    order = w.orderBy("timestamp", "id")
    back = w.orderBy(F.desc("timestamp"), F.desc("id"))
    size = (F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")).cast("double")
    d = dominant_model(rows).withColumns({"a": F.row_number().over(order), "z": F.row_number().over(back), "size": size})
    s = d.groupBy("session_id").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("a") <= DRAG_EDGE, F.col("size"))).alias("first"), F.avg(F.when(F.col("z") <= DRAG_EDGE, F.col("size"))).alias("last")
    ).where((F.col("n") >= DRAG_ROWS) & (F.col("first") > 0))
    ratio, delta = F.col("last") / F.col("first"), F.col("last") - F.col("first")
    over = lambda k: (ratio >= DRAG_RATIO[k]) & ((F.col("last") >= DRAG_INPUT[k]) | (delta >= DRAG_DELTA[k]))
    return s.select("session_id", _state(over("red"), over("yellow")).alias("context_drag"))


def cache_efficiency(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("session_id").orderBy(F.desc("timestamp"), F.desc("id"))
    run = recent_run(rows).withColumn("z", F.row_number().over(w))
    near = F.col("z") <= REUSE_ROWS
    s = run.groupBy("session_id").agg(
        F.count("*").alias("n"), F.sum(F.when(near, F.col("cache_read_tokens"))).alias("read"), F.sum(F.when(near, F.col("input_tokens") + F.col("cache_read_tokens"))).alias("whole")
    ).where((F.col("n") >= REUSE_LEAST) & (F.col("whole") > 0))
    rate = F.col("read") / F.col("whole")
    return s.select("session_id", _state(rate < REUSE["red"], rate < REUSE["yellow"]).alias("cache_efficiency"))


def thrashing(events: DataFrame, order: str = "seq") -> DataFrame:
    """Retry loops, scored by turn: how often one tool fails, storms of failures, bursts of one tool, two tools in turns."""
    w = W.partitionBy("session_id").orderBy("ts", order)
    turns = events.withColumn("turn", F.count_if(F.col("event") == "user_prompt_submit").over(w.rowsBetween(W.unboundedPreceding, 0)))
    uses = turns.where("event IN ('post_tool_use', 'post_tool_use_failure')").withColumn("tool", F.coalesce("tool_name", F.lit("unknown")))
    t = W.partitionBy("session_id", "turn").orderBy("ts", order)
    marked = uses.withColumn("new", (~F.col("tool").eqNullSafe(F.lag("tool").over(t))).cast("int")).withColumn("run", F.sum("new").over(t.rowsBetween(W.unboundedPreceding, 0)))
    failed = F.count_if(F.col("event") == "post_tool_use_failure")
    runs = marked.groupBy("session_id", "turn", "tool", "run").agg(F.count("*").alias("n"), failed.alias("f"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    tools = runs.groupBy("session_id", "turn", "tool").agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.max("n").alias("run"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    turn = tools.groupBy("session_id", "turn").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.max("f").alias("repeated"), F.max("run").alias("run"), F.count("*").alias("tools"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    ).withColumn("secs", F.floor((micros("hi") - micros("lo")) / 1_000_000))
    c = F.col
    storm = (c("f") >= 4) & (c("f") * 2 >= c("n")) & (c("secs") <= 120)
    burst, pingpong = (c("run") >= 4) & (c("secs") <= 90), (c("n") >= 8) & (c("tools") <= 2) & (c("secs") <= 90)
    score = (
        F.when(c("n") < 4, 0)
        .when((c("repeated") >= 5) | (burst & (c("f") >= 4)), 2)
        .when((c("repeated") >= 3) | storm | ((burst | pingpong) & (c("f") >= 2)), 1)
        .otherwise(0)
    )
    s = turn.groupBy("session_id").agg(F.sum(score).alias("score"))
    return s.select("session_id", _state(F.col("score") >= 2, F.col("score") >= 1).alias("thrashing"))


def cost_acceleration(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Halves of the turns' costs, or of the replies' where there are no prompts."""
    d = dominant_model(rows).select("session_id", "timestamp", F.col("id").alias("o"), F.col("cost_cents_effective").cast(MONEY).alias("c"), F.lit(1).alias("k"))
    cuts = events.where("event = 'pre_compact'").groupBy("session_id").agg(F.max("ts").alias("__cut"))
    asked = events.where("event = 'user_prompt_submit'").join(cuts, "session_id", "left").where(F.col("__cut").isNull() | (F.col("ts") > F.col("__cut")))
    prompts = asked.select("session_id", F.col("ts").alias("timestamp"), F.lit("").alias("o"), F.lit(0).cast(MONEY).alias("c"), F.lit(0).alias("k"))
    w = W.partitionBy("session_id").orderBy("timestamp", "k", "o").rowsBetween(W.unboundedPreceding, 0)
    both = d.unionByName(prompts).withColumn("turn", F.count_if(F.col("k") == 0).over(w)).where("k = 1")
    both = both.withColumn("asked", (F.max("turn").over(W.partitionBy("session_id")) > 0).cast("int")).where("turn > 0 OR asked = 0")
    unit = F.when(F.col("asked") == 1, F.col("turn").cast("string")).otherwise(F.concat_ws("|", F.col("timestamp").cast("string"), "o"))
    costs = both.groupBy("session_id", "asked", unit.alias("u")).agg(F.min("timestamp").alias("t"), F.min("o").alias("o"), F.sum("c").alias("c"))
    s = W.partitionBy("session_id")
    at = costs.withColumns({"i": F.row_number().over(s.orderBy("t", "o")), "n": F.count("*").over(s)})
    half = F.floor(F.col("n") / 2)
    out = at.groupBy("session_id", "asked", "n").agg(
        F.sum("c").cast("double").alias("total"),
        (F.sum(F.when(F.col("i") <= half, F.col("c"))).cast("double") / F.first(half)).alias("first"),
        (F.sum(F.when(F.col("i") > half, F.col("c"))).cast("double") / (F.first(F.col("n")) - F.first(half))).alias("second"),
    )
    least = F.when(F.col("asked") == 1, ACCEL_TURNS).otherwise(ACCEL_REPLIES)
    out = out.where((F.col("n") >= least) & (F.col("total") >= ACCEL_SESSION_CENTS) & (F.col("first") > 0))
    over = lambda k: (F.col("second") / F.col("first") >= ACCEL_RATIO[k]) & (F.col("second") >= ACCEL_CENTS[k])
    return out.select("session_id", _state(over("red"), over("yellow")).alias("cost_acceleration"))


def session_health(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Per session its vitals (null: too little to tell) and state: red before yellow before insufficient_data (three or more null) before green."""
    parts = -(-max(messages.count(), events.count()) // PART_ROWS) or 1
    messages, events = _by_session(messages, parts), _by_session(events, parts)
    rows = after_compaction(messages, events)
    # each vital ends with a shuffle of one row a session: the sorts of all of them would else be held by one task
    out = messages.select("session_id").distinct().repartition("session_id")
    for vital in (context_drag(rows), cache_efficiency(rows), thrashing(events), cost_acceleration(rows, events)):
        out = out.join(vital.repartition("session_id"), "session_id", "left")
    any_ = lambda s: F.exists(F.array(*VITALS), lambda v: F.coalesce(v == s, F.lit(False)))
    missing = sum((F.col(v).isNull().cast("int") for v in VITALS), F.lit(0))
    return out.withColumn("state", F.when(any_("red"), "red").when(any_("yellow"), "yellow").when(missing >= 3, "insufficient_data").otherwise("green"))


def latest_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The id (one row, none without sessions) of the session with the last assistant row; of sessions without one the last begun, then the larger id."""
    last = _assistant_rows(messages).groupBy("session_id").agg(F.max("timestamp").alias("__last"))
    out = sessions.select("id", F.coalesce("started_at", "ended_at").alias("__at")).join(last, F.col("id") == F.col("session_id"), "left")
    return out.orderBy(F.desc_nulls_last("__last"), F.desc_nulls_last("__at"), F.desc("id")).limit(1).select("id")


def latest_health(messages: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Health of the latest session alone: only its rows are looked at."""
    one = F.broadcast(latest_session(messages, sessions).select(F.col("id").alias("session_id")))  # one row
    return session_health(messages.join(one, "session_id", "left_semi"), events.join(one, "session_id", "left_semi"))


def _assistant_rows(messages: DataFrame) -> DataFrame:
    return messages.where("session_id IS NOT NULL AND coalesce(role, 'assistant') = 'assistant'")


def health_tips(health: DataFrame) -> DataFrame:
    """A row for each vital that is yellow or red, with its tip."""
    tips = health.sparkSession.createDataFrame([(*k, t) for k, t in TIPS.items()], "vital string, vital_state string, tip string")
    each = health.select("session_id", F.explode(F.array(*[F.struct(F.lit(v).alias("vital"), F.col(v).alias("vital_state")) for v in VITALS])).alias("v")).select("session_id", "v.*")
    return each.join(F.broadcast(tips), ["vital", "vital_state"])  # a fixed table


def prompt_counts(messages: DataFrame) -> DataFrame:
    """User prompts per session; sessions of ``copilot_chat`` without any count their distinct priced requests."""
    asked = F.count_if(F.col("role") == "user")
    requests = F.count_distinct(F.when((F.col("role") == "assistant") & (F.col("cost_cents_effective") > 0), F.col("request_id")))
    out = messages.where("session_id IS NOT NULL").groupBy("session_id").agg(asked.alias("a"), requests.alias("r"), F.max("provider").alias("p"))
    return out.select("session_id", F.when((F.col("a") == 0) & F.coalesce(F.col("p") == "copilot_chat", F.lit(False)), F.col("r")).otherwise(F.col("a")).alias("prompt_count"))


def _commit_counts(windows: DataFrame, commits: DataFrame) -> DataFrame:
    """Per session the distinct commits of its branch from ``lo`` to ``hi``, by running counts: no session meets its commits one by one.

    Time is cut into hours, so a busy branch is many groups: a window's count is what came up to its end less what came before its start, each
    the sum of whole hours before and a running count inside the hour. Commits told with several times on one branch, which hardly are, meet
    the windows by days."""
    on = ["repo_id", "branch"]
    told = commits.where("NOT on_integration AND sha IS NOT NULL").groupBy(*on, "sha").agg(F.collect_set("ts").alias("__at")).where(F.size("__at") > 0)
    hour = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 3_600_000_000)
    points = told.where(F.size("__at") == 1).groupBy(*on, F.element_at("__at", 1).alias("at")).agg(F.count("*").alias("n"))
    points = points.select(*on, "at", F.lit(1).alias("k"), "n", F.lit(None).cast(windows.schema["session_id"].dataType).alias("session_id"))
    edges = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("k")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("k")))).alias("e")
    asked = windows.select(*on, "session_id", edges).select(*on, "e.at", "e.k", F.lit(0).cast("bigint").alias("n"), "session_id")
    both = points.unionByName(asked).withColumn("hour", hour)
    held = both.groupBy(*on, "hour").agg(F.sum("n").alias("h"))
    before = F.coalesce(F.sum("h").over(W.partitionBy(*on).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*on, "hour", before.alias("before"))
    w = W.partitionBy(*on, "hour").orderBy("at", "k").rowsBetween(W.unboundedPreceding, 0)
    run = both.withColumn("run", F.sum("n").over(w)).where("session_id IS NOT NULL").join(held, [*on, "hour"])
    single = run.select("session_id", (F.when(F.col("k") == 2, 1).otherwise(-1) * (F.col("run") + F.col("before"))).alias("n"))
    day = lambda c: F.unix_date(F.to_date(F.col(c)))
    again = told.where(F.size("__at") > 1).select(*on, "sha", F.explode("__at").alias("at")).withColumn("day", day("at"))
    near = windows.withColumn("day", F.explode(F.sequence(day("lo"), day("hi"))))
    several = near.join(again, [*on, "day"]).where("at BETWEEN lo AND hi").groupBy("session_id").agg(F.count_distinct("sha").alias("n"))
    return single.unionByName(several).groupBy("session_id").agg(F.sum("n").alias("commits"))


def work_outcomes(sessions: DataFrame, commits: DataFrame, branches: DataFrame) -> DataFrame:
    """branch_merged, committed (commits of the branch alone from the start to a day after the end), no_commit or unknown."""
    s = sessions.select(F.col("id").alias("session_id"), "repo_id", "git_branch", "started_at", "ended_at")
    b = branches.select(F.col("repo_id").alias("__r"), F.col("branch").alias("__b"), "merged", "same_tip")
    met = s.join(small(b), (F.col("repo_id") == F.col("__r")) & (F.col("git_branch") == F.col("__b")), "left")
    own = s.select("session_id", "repo_id", F.col("git_branch").alias("branch"), F.col("started_at").alias("lo"), (F.col("ended_at") + F.expr("INTERVAL 24 HOURS")).alias("hi"))
    busy = commits.where("NOT on_integration").select("repo_id", "branch").distinct()
    n = _commit_counts(own.where("lo <= hi").join(small(busy), ["repo_id", "branch"], "left_semi"), commits)
    out = met.join(n, "session_id", "left")
    outcome = (
        F.when(F.col("__b").isNull(), "unknown")
        .when(F.col("merged") & ~F.col("same_tip"), "branch_merged")
        .when(F.coalesce("commits", F.lit(0)) > 0, "committed")
        .otherwise("no_commit")
    )
    return out.select("session_id", outcome.alias("work_outcome"), F.coalesce("commits", F.lit(0)).alias("commits"))
