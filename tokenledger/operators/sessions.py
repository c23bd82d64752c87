"""Session and message lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import ALL_TIME, MEASURES, NO_FILTERS, UNTAGGED, DimFilters, TimeWindow, facts, money_sum, selected, token_sums

SESSION_SORTS = ("started_at", "ended_at", "duration_ms", "message_count", "cost_cents", "input_tokens", "output_tokens", "provider", "title")
MESSAGE_SORTS = ("timestamp", "model", "provider", "repo_id", "git_branch", "input_tokens", "output_tokens", "cost_cents", "session_id")
#: Tag keys that link rows and describe no session.
LINKAGE_KEYS = ("tool_use_id", "tool_outcome", "tool_outcome_source", "tool_outcome_confidence")


def _by_cost(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Per session the values of a column, by cost, then count, then value."""
    each = rows.where(F.col(column) != UNTAGGED).groupBy("session_id", column).agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), (-F.col("n")).alias("n"), F.col(column).alias("v"))))
    return each.groupBy("session_id").agg(F.transform(listed, lambda x: x["v"]).alias(name))


def _ordered(df: DataFrame, sort: str, ascending: bool, allowed: tuple[str, ...], last: str) -> DataFrame:
    if sort not in allowed:
        raise ValueError(f"no such sort key: {sort}")
    c = F.col(sort)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), last)


def like_literal(c: Column, text: str) -> Column:
    quoted = "".join("\\" + x if x in "\\%_" else x for x in text)
    return F.coalesce(c.ilike(f"%{quoted}%"), F.lit(False))


def session_list(
    messages: DataFrame, sessions: DataFrame, tags: DataFrame | None = None, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS,
    search: str | None = None, ticket: str | None = None, activity: str | None = None, sort: str = "started_at", ascending: bool = False, limit: int = 0, offset: int = 0,
) -> DataFrame:
    """Per session: totals, lists by cost, confidence, surface, title; with total_count of all pages."""
    meta = sessions.select(F.col("id").alias("__s"), F.col("git_branch").alias("__branch"), *[c for c in ("title",) if c in sessions.columns])
    rows = messages.where("session_id IS NOT NULL").join(meta, F.col("session_id") == F.col("__s"), "left")
    rows = rows.withColumn("git_branch", F.coalesce("git_branch", "__branch"))
    rows = selected(rows, window, filters)
    for key, value in (("ticket_id", ticket), ("activity", activity)):
        if value is not None:
            ids = tags.where((F.col("key") == key) & (F.col("value") == value)).select("message_id")
            wanted = rows.join(ids, rows["id"] == ids["message_id"], "left_semi").select("session_id").distinct()
            rows = rows.join(wanted, "session_id", "left_semi")
    if search:
        hit = F.lit(False)
        for c in ("session_id", "model", "repo_id", "git_branch", "provider"):
            hit = hit | like_literal(F.col(c), search)
        rows = rows.join(rows.where(hit).select("session_id").distinct(), "session_id", "left_semi")
    out = rows.groupBy("session_id").agg(
        F.max("d_provider").alias("provider"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("message_count"),
        *token_sums(), money_sum().alias("cost_cents"),
        F.when(F.bool_or(F.coalesce(F.col("cost_confidence"), F.lit("")).ilike("%estimated%")), "estimated").otherwise("exact").alias("cost_confidence"),
    )
    out = out.withColumn("duration_ms", F.floor((F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long"))
    for column, name in (("d_model", "models"), ("d_project", "repo_ids"), ("d_branch", "git_branches")):
        out = out.join(_by_cost(rows, column, name), "session_id", "left")
    seen = rows.where("d_surface <> 'unknown'").groupBy("session_id", "d_surface").count()
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "d_surface"))
    modal = seen.withColumn("k", top).where("k = 1").select("session_id", F.col("d_surface").alias("surface"))
    out = out.join(modal, "session_id", "left").withColumn("surface", F.coalesce("surface", F.lit("unknown")))
    if "title" in meta.columns:
        out = out.join(meta.select(F.col("__s").alias("session_id"), "title"), "session_id", "left")
    out = _ordered(out, sort, ascending, SESSION_SORTS, "session_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def session_detail(messages: DataFrame, sessions: DataFrame, session_id: str) -> DataFrame:
    """One session, also one without messages."""
    rows = facts(messages.where(F.col("session_id") == session_id)).where("d_role = 'assistant'")
    sums = rows.groupBy("session_id").agg(F.count("*").alias("message_count"), *token_sums(), money_sum().alias("cost_cents"))
    one = sessions.where(F.col("id") == session_id)
    out = one.join(sums, one["id"] == sums["session_id"], "left").drop("session_id")
    return out.na.fill(0, ["message_count", *MEASURES, "cost_cents"])


def resolve_session(messages: DataFrame, sessions: DataFrame, prefix: str) -> tuple[str, str | None]:
    """('unique', id), ('none', None) or ('ambiguous', None)."""
    ids = messages.select(F.col("session_id").alias("id")).union(sessions.select("id")).where(F.col("id").startswith(prefix)).distinct()
    found = [r["id"] for r in ids.orderBy("id").limit(2).collect()]
    if prefix in found:
        return "unique", prefix
    return ("none", None) if not found else ("unique", found[0]) if len(found) == 1 else ("ambiguous", None)


def resolved_sessions(messages: DataFrame, sessions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix, outcome (unique, none, ambiguous) and id of many prefixes at once, by equal keys: the beginnings of ids in the lengths that prefixes have."""
    ids = messages.select(F.col("session_id").alias("id")).union(sessions.select("id")).where("id IS NOT NULL").distinct()
    asked = prefixes.select("prefix").distinct()
    lengths = [r["n"] for r in asked.select(F.length("prefix").alias("n")).distinct().collect()]  # a few tens
    begun = ids.select("id", F.explode(F.array(*[F.when(F.length("id") >= n, F.left("id", F.lit(n))) for n in lengths]).cast("array<string>")).alias("prefix"))
    found = begun.where("prefix IS NOT NULL").groupBy("prefix").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.bool_or(F.col("id") == F.col("prefix")).alias("own"))
    met = asked.join(found, "prefix", "left")
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("own") | (F.col("n") == 1), "unique").otherwise("ambiguous")
    return met.select("prefix", outcome.alias("outcome"), F.when(F.col("own"), F.col("prefix")).when(F.col("n") == 1, F.col("one")).alias("id"))


def message_list(
    messages: DataFrame, sessions: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS, search: str | None = None,
    sort: str = "timestamp", ascending: bool = False, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of assistant rows with their session's title."""
    meta = sessions.select(F.col("id").alias("__s"), F.col("title") if "title" in sessions.columns else F.lit(None).cast("string").alias("title"))
    rows = selected(messages, window, filters).withColumn("cost_cents", F.col("cents").cast("double"))
    if search:
        hit = F.lit(False)
        for c in ("model", "repo_id", "provider", "git_branch", "session_id"):
            hit = hit | like_literal(F.col(c), search)
        rows = rows.where(hit)
    page = _ordered(rows, sort, ascending, MESSAGE_SORTS, "id").offset(offset).limit(limit)
    names = ["id", "session_id", "timestamp", "provider", "model", "repo_id", "git_branch", *MEASURES, "cost_cents"]
    out = page.join(meta, page["session_id"] == meta["__s"], "left").select(*names, "title")
    return _ordered(out, sort, ascending, MESSAGE_SORTS, "id")


def _tag_arrays(tags: DataFrame) -> DataFrame:
    named = tags.where(~F.col("key").isin(*LINKAGE_KEYS, "tool"))
    of = named.groupBy("message_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))).alias("tags"))
    tools = tags.where("key = 'tool'").groupBy("message_id").agg(F.array_sort(F.collect_set("value")).alias("tools"))
    return of.join(tools, "message_id", "full_outer")


def session_messages(messages: DataFrame, tags: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Messages of all sessions, or of those given, with tools, tags and the number among the session's assistant rows."""
    rows = messages.where("session_id IS NOT NULL")
    if sessions is not None:
        rows = rows.join(sessions.select(F.col("id").alias("__s")), F.col("session_id") == F.col("__s"), "left_semi")
    order = W.partitionBy("session_id").orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, 0)
    mine = F.coalesce(F.col("role"), F.lit("assistant")) == "assistant"
    rows = rows.withColumn("assistant_sequence", F.when(mine, F.count_if(mine).over(order)))
    arrays = _tag_arrays(tags)
    out = rows.join(arrays, rows["id"] == arrays["message_id"], "left").drop("message_id")
    empty = F.array().cast("array<string>")
    return out.withColumns({"tools": F.coalesce("tools", empty), "tags": F.coalesce("tags", empty)})


def session_page(messages: DataFrame, tags: DataFrame, session_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a session's assistant rows, in order, with their number among all of them."""
    own = messages.where(F.col("session_id") == session_id)
    rows = session_messages(own, tags.join(own.select(F.col("id").alias("__id")), F.col("message_id") == F.col("__id"), "left_semi"))
    return rows.where("assistant_sequence IS NOT NULL").orderBy("timestamp", "id").offset(offset).limit(limit)


def message_curve(messages: DataFrame) -> DataFrame:
    """Per session, message by message: number, tokens, running cost."""
    rows = facts(messages.where("session_id IS NOT NULL")).where("d_role = 'assistant'")
    w = W.partitionBy("session_id").orderBy("timestamp", "id")
    return rows.select(
        "session_id", "id", F.row_number().over(w).alias("seq"), *MEASURES, F.col("cents").cast("double").alias("cost_cents"),
        F.sum("cents").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("cumulative_cost_cents"),
    )


#: Messages that a task of the join with tags gets, about; each has several tags.
PART_ROWS = 20_000


def session_tags(messages: DataFrame, tags: DataFrame) -> DataFrame:
    rows = messages.where("session_id IS NOT NULL").select("id", "session_id")
    parts = -(-rows.count() // PART_ROWS) or 1
    # parts asked for by number are not put together again, so a task's sorts stay as small as they are
    rows = rows.repartition(parts, "id")
    own = tags.where(~F.col("key").isin(*LINKAGE_KEYS)).repartition(parts, "message_id")
    return own.join(rows, own["message_id"] == rows["id"]).select("session_id", "key", "value").distinct()


def message_detail(messages: DataFrame, tags: DataFrame, message_id: str) -> DataFrame:
    return session_messages(messages.where(F.col("id") == message_id), tags.where(F.col("message_id") == message_id)).drop("assistant_sequence")


def session_cwd(messages: DataFrame) -> DataFrame:
    """Per session its commonest cwd, ties to the smaller."""
    each = messages.where("session_id IS NOT NULL AND cwd IS NOT NULL AND cwd <> ''").groupBy("session_id", "cwd").count()
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "cwd"))
    return each.withColumn("k", top).where("k = 1").select("session_id", "cwd")


def cost_lag_hint(sessions: DataFrame, now: datetime, lag: timedelta = timedelta(minutes=10)) -> DataFrame:
    """Sessions whose bill is likely to lag: of ``cursor``, ended less than ``lag`` before ``now``."""
    return sessions.withColumn("cost_lag_hint", F.coalesce((F.col("provider") == "cursor") & TimeWindow(since=now - lag + timedelta(microseconds=1)).where("ended_at"), F.lit(False)))


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))


