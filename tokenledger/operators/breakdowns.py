"""Cost and usage breakdowns. All take messages (and tags), a window and dimension filters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import ALL_TIME, DIMENSIONS, MEASURES, MONEY, NO_FILTERS, OTHER, UNTAGGED, DimFilters, TimeWindow, dollars, facts, money_sum, selected, token_sums
from ..functions.text import UNATTRIBUTED, basename, display_model, model_label
from .pricing import per_million, with_prices



def usage_summary(messages: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    rows = selected(messages, window, filters, assistant=False)
    return rows.agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col("d_role") == "user").alias("user_messages"),
        F.count_if(F.col("d_role") == "assistant").alias("assistant_messages"),
        *token_sums(),
        money_sum().alias("cost_cents"),
    )


def _grouped(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("message_count"), *token_sums(), money_sum().alias("cost_cents"))


def repo_usage(messages: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS, limit: int = 0) -> DataFrame:
    """Per project; the display path is the smallest cwd of all time, looked up for the projects kept only."""
    top = _grouped(selected(messages, window, filters), F.col("d_project").alias("repo_id")).orderBy(F.desc("cost_cents"), "repo_id")
    top = top.limit(limit) if limit else top
    paths = facts(messages).groupBy(F.col("d_project").alias("repo_id")).agg(F.min("cwd").alias("display_path"))
    return top.join(paths, "repo_id", "left").select("repo_id", "display_path", "message_count", "input_tokens", "output_tokens", "cost_cents")


def non_repo_usage(messages: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """Rows without a project by the last part of their cwd."""
    rows = selected(messages, window, filters).where((F.col("d_project") == UNTAGGED) & F.col("cwd").isNotNull())
    out = rows.groupBy(basename(F.col("cwd")).alias("name")).agg(F.min("cwd").alias("sample_cwd"), F.count("*").alias("message_count"), money_sum().alias("cost_cents"))
    return out.orderBy(F.desc("cost_cents"), "name")


_BUCKETS = {"hour": "HH", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}


def activity_chart(messages: DataFrame, granularity: str = "day", offset_minutes: int = 0, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """By hour of day, day (also for ``week``) or month, shifted by a fixed offset."""
    at = F.col("timestamp") + F.make_interval(mins=F.lit(offset_minutes))
    rows = selected(messages, window, filters)
    return _grouped(rows, F.date_format(at, _BUCKETS[granularity]).alias("bucket")).orderBy("bucket")


def branch_cost(messages: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    rows = selected(messages, window, filters)
    repo = F.when(F.col("d_branch") == UNTAGGED, "").otherwise(F.when(F.col("d_project") == UNTAGGED, "").otherwise(F.col("d_project")))
    out = rows.groupBy(F.col("d_branch").alias("branch"), repo.alias("repo_id")).agg(
        F.count_distinct("session_id").alias("session_count"), F.count("*").alias("message_count"), *token_sums(), money_sum().alias("cost_cents")
    )
    return out.orderBy(F.desc("cost_cents"), "branch", "repo_id")


def branch_cost_single(messages: DataFrame, branch: str, project: str | None = None, window: TimeWindow = ALL_TIME) -> DataFrame:
    """One branch; its project is shown if there is only one."""
    rows = selected(messages, window, DimFilters(branches=(branch,), projects=(project,) if project else ()))
    return rows.groupBy(F.col("d_branch").alias("branch")).agg(
        F.when(F.count_distinct("d_project") == 1, F.max("d_project")).otherwise("").alias("repo_id"),
        F.count_distinct("session_id").alias("session_count"),
        F.count("*").alias("message_count"),
        *token_sums(),
        money_sum().alias("cost_cents"),
    )


def _values(tags: DataFrame, key: str) -> DataFrame:
    """message_id, value and the number of values of the message, over all its tags of the key."""
    own = tags.where(F.col("key") == key).select("message_id", "value").distinct()
    return own.withColumn("n_values", F.count("*").over(W.partitionBy("message_id")))


def split_by_tag(messages: DataFrame, tags: DataFrame, key: str, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """Facts with value and their share: tokens by integer division, cost rounded to 8 places; rows without the key are (untagged)."""
    rows = selected(messages, window, filters)
    values = _values(tags, key)
    met = rows.join(values, rows["id"] == values["message_id"], "left").drop("message_id")
    n = F.coalesce("n_values", F.lit(1))
    share = {m: F.expr(f"{m} div coalesce(n_values, 1)") for m in MEASURES}
    share["cents"] = (F.col("cents").cast("double") / n).cast(MONEY)
    share["value"] = F.coalesce("value", F.lit(UNTAGGED))
    return met.withColumns(share).drop("n_values")


def tag_stats(messages: DataFrame, tags: DataFrame, key: str | None = None, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """Cost by the values of a key, split over a message's values; without a key all keys, unsplit. repo and branch keys read the columns."""
    if key is None:
        rows = selected(messages, window, filters).select("id", "session_id", "cents")
        # a message's tags, each once, come together where they meet their message: one shuffle of tags
        own = tags.groupBy("message_id").agg(F.collect_set(F.struct("key", "value")).alias("__tags"))
        met = own.join(rows, F.col("message_id") == F.col("id")).select("session_id", "cents", F.explode("__tags").alias("t"))
        out = met.select("session_id", "cents", "t.*").groupBy("key", "value")
    elif key.startswith(("repo", "branch")):
        column = "d_project" if key.startswith("repo") else "d_branch"
        out = selected(messages, window, filters).withColumns({"key": F.lit(key), "value": F.col(column)}).groupBy("key", "value")
    else:
        out = split_by_tag(messages, tags, key, window, filters).withColumn("key", F.lit(key)).groupBy("key", "value")
    return out.agg(F.count_distinct("session_id").alias("session_count"), money_sum().alias("cost_cents")).orderBy("key", F.desc("cost_cents"), "value")


def _split_and_labelled(messages, tags, key: str, window, filters, labels: dict[str, str]) -> DataFrame:
    """As ``split_by_tag``, with the least value of each label's tag as l_<label>: one pass over tags and one join."""
    own = tags.where(F.col("key").isin(key, *labels.values())).groupBy("message_id").agg(
        F.collect_set(F.when(F.col("key") == key, F.col("value"))).alias("__values"),  # a message's own tags
        *[F.min(F.when(F.col("key") == tag, F.col("value"))).alias(f"l_{name}") for name, tag in labels.items()],
    )
    rows = selected(messages, window, filters)
    met = rows.join(own, rows["id"] == own["message_id"], "left").drop("message_id")
    met = met.withColumn("__n", F.greatest(F.coalesce(F.size("__values"), F.lit(1)), F.lit(1))).withColumn("value", F.explode_outer("__values"))
    share = {m: F.expr(f"{m} div __n") for m in MEASURES}
    share["cents"] = (F.col("cents").cast("double") / F.col("__n")).cast(MONEY)
    share["value"] = F.coalesce("value", F.lit(UNTAGGED))
    return met.withColumns(share).drop("__n", "__values")


def _tag_cost(messages, tags, key, window, filters, picks: dict[str, str], labels: dict[str, str], by_count: bool) -> DataFrame:
    """Sums by value, and per value the dominant of each pick (greatest cost) and label (greatest cost, or count), ties to the smaller;
    blanks do not count, nor labels of untagged rows. All dominants come from one aggregation."""
    rows = _split_and_labelled(messages, tags, key, window, filters, labels)
    out = rows.groupBy("value").agg(
        F.count_distinct("session_id").alias("session_count"), F.count("*").alias("message_count"), *token_sums(), money_sum().alias("cost_cents")
    )
    of = {**picks, **{name: f"l_{name}" for name in labels}}
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("label")) for n, c in of.items()]))
    each = rows.select("value", "cents", named.alias("x")).select("value", "cents", "x.*").where(F.col("label").isNotNull() & ~F.col("label").isin("", UNTAGGED))
    each = each.where(F.col("name").isin(*picks) | (F.col("value") != UNTAGGED)).groupBy("value", "name", "label").agg(F.sum("cents").alias("c"), F.count("*").alias("n"))
    counted = F.col("name").isin(*labels) if by_count else F.lit(False)
    weight = F.struct(-F.when(counted, F.col("n").cast("decimal(38,8)")).otherwise(F.col("c")), "label")
    top = lambda n: F.min_by(F.when(F.col("name") == n, F.col("label")), F.when(F.col("name") == n, weight)).alias(n)
    out = out.join(each.groupBy("value").agg(*[top(n) for n in of]), "value", "left").na.fill("", [*of])
    return out.where((F.col("value") != UNTAGGED) | (F.col("message_count") > 0)).orderBy(F.desc("cost_cents"), "value")


def ticket_cost(messages: DataFrame, tags: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """Per ticket: split tokens and cost, sessions, the branch, project and source of the greatest cost."""
    out = _tag_cost(messages, tags, "ticket_id", window, filters, {"top_branch": "d_branch", "top_repo_id": "d_project"}, {"source": "ticket_source"}, False)
    return out.withColumnRenamed("value", "ticket_id").withColumn("ticket_prefix", F.when(F.instr("ticket_id", "-") > 0, F.split_part("ticket_id", F.lit("-"), F.lit(1))).otherwise(""))


def activity_cost(messages: DataFrame, tags: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    out = _tag_cost(messages, tags, "activity", window, filters, {"top_branch": "d_branch", "top_repo_id": "d_project"}, {"source": "activity_source", "confidence": "activity_confidence"}, True)
    return out.withColumnRenamed("value", "activity")


def file_cost(messages: DataFrame, tags: DataFrame, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    out = _tag_cost(
        messages, tags, "file_path", window, filters, {"top_branch": "d_branch", "top_repo_id": "d_project"}, {"top_ticket_id": "ticket_id", "source": "file_path_source"}, False
    )
    return out.withColumnRenamed("value", "file_path")


def tag_cost_branches(messages: DataFrame, tags: DataFrame, key: str, value: str, window: TimeWindow = ALL_TIME, filters: DimFilters = NO_FILTERS) -> DataFrame:
    """Of one ticket, activity or file: its shares by branch and project."""
    rows = split_by_tag(messages, tags, key, window, filters).where(F.col("value") == value)
    out = rows.groupBy(F.col("d_branch").alias("branch"), F.col("d_project").alias("repo_id")).agg(
        F.count_distinct("session_id").alias("session_count"), F.count("*").alias("message_count"), *token_sums(), money_sum().alias("cost_cents")
    )
    return out.orderBy(F.desc("cost_cents"), "branch", "repo_id")


def ticket_detail(messages, tags, ticket: str, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    """Totals of one ticket; a ticket without a source comes from a branch."""
    one = ticket_cost(messages, tags, window, filters).where(F.col("ticket_id") == ticket)
    return one.withColumn("source", F.when(F.col("source") == "", "branch").otherwise(F.col("source")))


def activity_detail(messages, tags, activity: str, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    return activity_cost(messages, tags, window, filters).where(F.col("activity") == activity)


def file_detail(messages, tags, path: str, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    return file_cost(messages, tags, window, filters).where(F.col("file_path") == path)


def _stats(messages, dimension: str, name: str, window, filters) -> DataFrame:
    rows = selected(messages, window, filters, assistant=False)
    mine = F.col("d_role") == "assistant"
    return (
        rows.groupBy(F.col(f"d_{dimension}").alias(name))
        .agg(
            F.count_if(mine).alias("assistant_messages"),
            F.count_if(F.col("d_role") == "user").alias("user_messages"),
            F.count("*").alias("total_messages"),
            *[F.coalesce(F.sum(F.when(mine, F.col(m))), F.lit(0)).alias(m) for m in MEASURES],
            F.coalesce(F.sum(F.when(mine, F.col("cents"))), F.lit(0).cast(MONEY)).cast("double").alias("cost_cents"),
        )
        .withColumn("cost_dollars", dollars(F.col("cost_cents")))
        .orderBy(F.desc("cost_cents"), name)
    )


def provider_stats(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    return _stats(messages, "provider", "provider", window, filters)


def surface_stats(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    return _stats(messages, "surface", "surface", window, filters)


def model_usage(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    rows = selected(messages, window, filters)
    return _grouped(rows, F.col("d_model").alias("model"), F.col("d_provider").alias("provider")).orderBy(F.desc("cost_cents"), "model", "provider")


def labelled_models(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    """Model usage under display names: rows of models not known yet merge by provider; ``suppressed`` marks those of them without a cost."""
    rows = selected(messages, window, filters).withColumn("__d", display_model(F.col("d_model")))
    label = F.when(F.col("__d.placeholder"), UNATTRIBUTED).otherwise(model_label(F.col("d_model")))
    raw = F.when(~F.col("__d.placeholder"), F.col("d_model"))  # two raw names of one label stay two rows
    out = _grouped(rows, label.alias("model"), raw.alias("__raw"), F.col("d_provider").alias("provider"))
    return out.withColumn("suppressed", F.col("__raw").isNull() & (F.col("cost_cents") <= 0)).drop("__raw").orderBy(F.desc("cost_cents"), "model", "provider")


def model_page(labelled: DataFrame, include_pending: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that show, a row with the number of those that do not) of ``labelled_models``."""
    hidden = F.lit(False) if include_pending else F.col("suppressed")
    return labelled.where(~hidden).drop("suppressed"), labelled.agg(F.count_if(hidden).alias("suppressed_rows"))


def cost_estimate(messages, price_list: DataFrame, aliases: DataFrame, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    """The stored total beside parts recomputed from tokens; what they leave is ``other``, never below 0."""
    by = _grouped(selected(messages, window, filters), F.col("d_provider").alias("provider"), F.col("d_model").alias("model"))
    rows = with_prices(by, price_list, aliases)
    p = per_million()
    part = lambda tokens, price: F.coalesce(F.sum((F.col(tokens) * price / 1e4).cast(MONEY)), F.lit(0).cast(MONEY))
    total = F.coalesce(F.sum(F.col("cost_cents").cast(MONEY)), F.lit(0).cast(MONEY))
    parts = {"input_cents": part("input_tokens", p["input"]), "output_cents": part("output_tokens", p["output"]), "cache_write_cents": part("cache_creation_tokens", p["write"]), "cache_read_cents": part("cache_read_tokens", p["read"])}
    saved = part("cache_read_tokens", p["input"] - p["read"])
    sums = rows.agg(total.alias("total"), *[c.alias(k) for k, c in parts.items()], saved.alias("saved"))
    other = F.greatest(F.col("total") - sum((F.col(k) for k in parts), F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY))
    cents = lambda c: F.round(c.cast("double"), 0)
    return sums.select(
        cents(F.col("total")).alias("total_cents"), *[cents(F.col(k)).alias(k) for k in parts], cents(other).alias("other_cents"), cents(F.col("saved")).alias("cache_savings_cents")
    )


def cache_efficiency(messages, price_list: DataFrame, aliases: DataFrame, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    by = _grouped(selected(messages, window, filters), F.col("d_provider").alias("provider"), F.col("d_model").alias("model"))
    rows = with_prices(by, price_list, aliases)
    p = per_million()
    saved = F.when(F.col("priced_model").isNotNull(), (F.col("cache_read_tokens") * (p["input"] - p["read"]) / 1e4).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    sums = rows.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"), F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).alias("total_cache_read_tokens"), F.coalesce(F.sum(saved), F.lit(0).cast(MONEY)).cast("double").alias("cache_savings_cents")
    )
    whole = F.col("total_input_tokens") + F.col("total_cache_read_tokens")
    return sums.withColumn("cache_hit_rate", F.when(whole > 0, F.round(F.col("total_cache_read_tokens") / whole, 6)).otherwise(0.0))


SESSION_SIZES = ((5, "1-5"), (15, "6-15"), (30, "16-30"), (60, "31-60"), (100, "61-100"))


def session_cost_curve(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    """Sessions by their number of messages."""
    each = selected(messages, window, filters).where("session_id IS NOT NULL").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    size, order = F.lit("100+"), F.lit(6)
    for i, (most, name) in reversed(list(enumerate(SESSION_SIZES, 1))):
        size, order = F.when(F.col("n") <= most, name).otherwise(size), F.when(F.col("n") <= most, i).otherwise(order)
    out = each.groupBy(size.alias("bucket"), order.alias("o")).agg(
        F.count("*").alias("session_count"), F.round(F.sum("n") / F.count("*"), 6).alias("avg_messages"),
        F.round(F.sum("cents").cast("double") / F.sum("n"), 6).alias("avg_cost_per_message_cents"), F.sum("cents").cast("double").alias("total_cost_cents"),
    )
    return out.orderBy("o").drop("o")


def cost_confidence(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    rows = selected(messages, window, filters)
    return rows.groupBy(F.coalesce("cost_confidence", F.lit("estimated")).alias("confidence")).agg(F.count("*").alias("message_count"), money_sum().alias("cost_cents")).orderBy(F.desc("cost_cents"), "confidence")


def subagent_cost(messages, window=ALL_TIME, filters=NO_FILTERS) -> DataFrame:
    rows = selected(messages, window, filters)
    kind = F.when(F.col("parent_uuid").isNotNull(), "subagent").otherwise("main")
    return _grouped(rows, kind.alias("category")).orderBy(F.desc("cost_cents"), "category")


def filter_options(messages, window=ALL_TIME) -> DataFrame:
    """Values of each dimension by frequency."""
    rows = selected(messages, window)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"d_{d}").alias("value")) for d in DIMENSIONS])).alias("x")).select("x.*")
    return each.where(F.col("value") != UNTAGGED).groupBy("dimension", "value").agg(F.count("*").alias("message_count")).orderBy("dimension", F.desc("message_count"), "value")


def statusline(messages, now: datetime, session: str | None = None, branch: str | None = None, project: str | None = None) -> DataFrame:
    """Rolling costs in dollars, in one pass over the last 30 days, and the most recent provider."""
    rows = selected(messages, TimeWindow(now - timedelta(days=30), now))
    since = lambda d: TimeWindow(since=now - timedelta(days=d)).where()
    cost = lambda c: dollars(F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0).cast(MONEY)).cast("double"))
    kept = {f"cost_{d}d": cost(since(d)) for d in (1, 7, 30)}
    for name, value, column in (("session", session, "session_id"), ("branch", branch, "d_branch"), ("project", project, "d_project")):
        if value is not None:
            kept[f"{name}_cost"] = cost(F.col(column) == value)
    return rows.agg(*[c.alias(k) for k, c in kept.items()], F.max_by("d_provider", F.struct("timestamp", "id")).alias("active_provider"))


def status_snapshot(messages, price_list, aliases, window=ALL_TIME, filters=NO_FILTERS) -> dict[str, DataFrame]:
    """Summary, estimate and providers from one read."""
    rows = messages.where(window.where())
    return {"summary": usage_summary(rows, filters=filters), "estimate": cost_estimate(rows, price_list, aliases, filters=filters), "providers": provider_stats(rows, filters=filters)}


def page(breakdown: DataFrame, key: str, limit: int = 30) -> DataFrame:
    """The top rows, an (other) row for all below them and the grand total on each row: rows and (other) make up the total exactly.

    The top rows come from a bounded sort; totals are partial sums, so nothing is ranked whole."""
    cents = F.col("cost_cents").cast(MONEY)
    rows = breakdown.select(F.col(key).alias("label"), "message_count", cents.alias("c"))
    total = rows.agg(F.coalesce(F.sum("c"), F.lit(0).cast(MONEY)).cast(MONEY).alias("t"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("tm"), F.count("*").alias("all"))
    top = rows.orderBy(F.desc("c"), "label")
    top = top.limit(limit) if limit else top
    kept = top.agg(F.coalesce(F.sum("c"), F.lit(0).cast(MONEY)).cast(MONEY).alias("k"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("km"), F.count("*").alias("n"))
    rest = (
        total.join(F.broadcast(kept), F.lit(True)).where("all > n")  # one row each
        .select(F.lit(OTHER).alias("label"), (F.col("tm") - F.col("km")).alias("message_count"), (F.col("t") - F.col("k")).cast(MONEY).alias("c"))
    )
    both = top.unionByName(rest).join(F.broadcast(total), F.lit(True))
    return both.select("label", "message_count", F.col("c").cast("double").alias("cost_cents"), F.col("t").cast("double").alias("total_cost_cents"))


def session_audit(messages, sessions: DataFrame) -> DataFrame:
    """Per provider: messages, those without a session id, those whose session is unknown, coverage in per cent."""
    rows = facts(messages).where(F.col("d_role") == "assistant")
    known = sessions.select(F.col("id").alias("__s")).distinct()
    met = rows.join(known, rows["session_id"] == known["__s"], "left")
    none = F.col("session_id").isNull() | (F.col("session_id") == "")
    out = met.groupBy(F.col("d_provider").alias("provider")).agg(
        F.count("*").alias("total_messages"), F.count_if(none).alias("missing_session_id"), F.count_if(~none & F.col("__s").isNull()).alias("orphan_messages")
    )
    return out.withColumn("coverage_pct", F.round(100.0 * (F.col("total_messages") - F.col("missing_session_id")) / F.col("total_messages"), 4)).orderBy("provider")


def session_visibility(messages, sessions: DataFrame, now: datetime) -> DataFrame:
    """Sessions seen in messages and in the session table, for today, 7 and 30 days, and whether they differ."""
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    starts = {"today": day, "7d": day - timedelta(days=7), "30d": day - timedelta(days=30)}
    windows = lambda at: F.filter(F.array(*[F.when(TimeWindow(s, now).where(at), F.lit(k)) for k, s in starts.items()]), lambda x: x.isNotNull())
    rows = facts(messages).where((F.col("d_role") == "assistant") & F.col("session_id").isNotNull())
    seen = rows.select("session_id", F.explode(windows(F.col("timestamp"))).alias("window")).groupBy("window").agg(F.count_distinct("session_id").alias("message_sessions"))
    listed = sessions.select("id", F.explode(windows(F.col("ended_at"))).alias("window")).groupBy("window").agg(F.count_distinct("id").alias("listed_sessions"))
    out = seen.join(listed, "window", "full_outer").na.fill(0, ["message_sessions", "listed_sessions"])
    return out.withColumn("mismatch", F.col("message_sessions") != F.col("listed_sessions")).orderBy("window")


def freshness(messages) -> DataFrame:
    return messages.where(F.coalesce(F.col("role"), F.lit("assistant")) == "assistant").agg(F.max("timestamp").alias("newest_data_at"))
