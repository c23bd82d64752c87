"""Enrichment of staged messages: carried context and tags. Tags are rows (message_id, key, value) of assistant rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prompts import classify
from ..functions.text import glob_match, repo_of_url, repo_path, repo_root, ticket, ticket_prefix
from .pricing import small

CATEGORY = ("prompt_category", "prompt_category_source", "prompt_category_confidence")
MOST_FILES = 16
#: Default surfaces by provider. Fixed values.
SURFACES = {"claude_code": "terminal", "codex": "terminal", "copilot": "terminal", "cursor": "cursor", "copilot_chat": "vscode", "jetbrains_ai_assistant": "jetbrains"}


def _session_key() -> Column:
    return F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.col("id"))


def _assistant(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("role"), F.lit("assistant")) == "assistant")


def _tags(rows: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """(message_id, key, value) of the non-empty values."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in tags.items()]))
    return rows.select(F.col("id").alias("message_id"), each.alias("t")).select("message_id", "t.*").where("value IS NOT NULL AND value <> ''")


def carried_context(messages: DataFrame, columns: tuple[str, ...] = ("git_branch", "repo_id", "cwd")) -> DataFrame:
    """Null branch, project and cwd take the session's latest earlier value, as does the category as a whole.

    An empty text neither inherits nor passes on."""
    w = W.partitionBy(_session_key()).orderBy("timestamp", "id").rowsBetween(W.unboundedPreceding, -1)
    new = {}
    for c in columns:
        if c in messages.columns:
            new[c] = F.coalesce(F.col(c), F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w))
    if set(CATEGORY) <= set(messages.columns):
        whole = F.when(F.coalesce(F.col(CATEGORY[0]), F.lit("")) != "", F.struct(*CATEGORY))
        last = F.last(whole, ignorenulls=True).over(w)
        for c in CATEGORY:
            new[c] = F.when(F.col(CATEGORY[0]).isNull(), last[c]).otherwise(F.col(c))
    return messages.withColumns(new)


def classified(messages: DataFrame, text: str = "text") -> DataFrame:
    """User rows with the category of their prompt."""
    found = messages.withColumn("__c", F.when(F.col("role") == "user", classify(F.col(text))))
    return found.withColumns({n: F.col(f"__c.{f}") for n, f in zip(CATEGORY, ("category", "source", "confidence"))}).drop("__c")


def activity_tags(messages: DataFrame) -> DataFrame:
    return _tags(_assistant(messages).where(F.coalesce(F.col(CATEGORY[0]), F.lit("")) != ""), dict(zip(("activity", "activity_source", "activity_confidence"), map(F.col, CATEGORY))))


def ticket_tags(messages: DataFrame) -> DataFrame:
    rows = _assistant(messages).withColumn("__t", ticket(F.col("git_branch"))).where("__t IS NOT NULL")
    return _tags(rows, {"ticket_id": F.col("__t.id"), "ticket_prefix": ticket_prefix(F.col("__t.id")), "ticket_source": F.col("__t.source")})


def identity_tags(messages: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Session-wide values (tag key to column), once per session and value: on its first assistant row, user rows' values included."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in keys.items()]))
    each = messages.select(_session_key().alias("__s"), values.alias("t")).select("__s", "t.*").where("value IS NOT NULL AND value <> ''").distinct()
    first = _assistant(messages).groupBy(_session_key().alias("__s")).agg(F.min_by("id", F.struct("timestamp", "id")).alias("message_id"))
    return each.join(first, "__s").select("message_id", "key", "value")


def tool_tags(messages: DataFrame) -> DataFrame:
    """tool and tool_use_id tags from the arrays of a row."""
    trimmed = lambda c: F.array_distinct(F.transform(F.col(c), lambda x: F.trim(x)))
    rows = _assistant(messages)
    out = None
    for key, column in (("tool", "tool_names"), ("tool_use_id", "tool_use_ids")):
        part = rows.select(F.col("id").alias("message_id"), F.lit(key).alias("key"), F.explode(trimmed(column)).alias("value")).where("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out


def file_tags(messages: DataFrame, root: str = "cwd") -> DataFrame:
    """Paths inside the repository, at most MOST_FILES a message in their order, with source and confidence."""
    def found(raw: Column) -> Column:
        whole = raw.startswith("/") | raw.startswith("file://") | raw.rlike("^[A-Za-z]:")
        return F.struct(repo_path(raw, F.col(root), F.col("__base")).alias("value"), whole.alias("__whole"))

    # paths are made inside arrays, once each, behind the one shuffle, and all tags of a message in one pass
    rows = _assistant(messages).select("id", root, "tool_files").repartition("id").select("*", F.explode_outer(F.array(repo_root(F.col(root)))).alias("__base"))
    made = rows.select("id", F.posexplode_outer(F.transform("tool_files", found)).alias("__i", "__f")).select("id", "__i", "__f.*").where("value IS NOT NULL")
    first = made.groupBy("id", "value").agg(F.min("__i").alias("__i"), F.bool_or("__whole").alias("__whole"))
    kept = first.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("__i", "value"))).where(F.col("k") <= MOST_FILES)
    kept = kept.withColumn("w", F.bool_or("__whole").over(W.partitionBy("id")))
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    label = F.array(
        tag("file_path_source", F.when(F.col("w"), F.lit("tool_arg")).otherwise("cwd_relative")), tag("file_path_confidence", F.when(F.col("w"), F.lit("high")).otherwise("medium"))
    )
    path = F.array(tag("file_path", F.col("value")))
    each = F.explode(F.when(F.col("k") == 1, F.concat(path, label)).otherwise(path))
    return kept.select(F.col("id").alias("message_id"), each.alias("t")).select("message_id", "t.*")


def cost_tags(messages: DataFrame) -> DataFrame:
    """provider, model, cost_confidence, and a speed other than the standard one."""
    columns = {k: F.col(k) for k in ("provider", "model", "speed", "cost_confidence") if k in messages.columns}
    if "speed" in columns:
        columns["speed"] = F.nullif(F.col("speed"), F.lit("standard"))
    return _tags(_assistant(messages), columns)


def cwd_source_tags(messages: DataFrame) -> DataFrame:
    return _tags(_assistant(messages), {"cwd_source": F.col("cwd_source")})


def rule_tags(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """User rules: key and value where the project fits the rule's glob; a rule without one always holds."""
    rows = _assistant(messages).select(F.col("id").alias("message_id"), "repo_id")
    # rules meet the distinct projects, far fewer than messages, and messages their project's tags by key
    repos = rows.select("repo_id").distinct()
    plain = F.col("match_repo").isNotNull() & ~F.col("match_repo").rlike("[*?]")
    by_name = repos.join(rules.where(plain), F.col("repo_id") == F.col("match_repo"))
    fits = F.col("match_repo").isNull() | F.coalesce(glob_match(F.col("repo_id"), F.col("match_repo")), F.lit(False))
    by_glob = repos.join(small(rules.where(~plain)), fits)
    own = by_name.unionByName(by_glob).select(F.col("repo_id").alias("__repo"), "key", "value").distinct()
    own = own.groupBy("__repo").agg(F.collect_set(F.struct("key", "value")).alias("__tags"))  # as many as there are rules
    met = rows.join(own, F.col("repo_id").eqNullSafe(F.col("__repo")))
    return met.select("message_id", F.explode("__tags").alias("t")).select("message_id", "t.*").distinct()


def tool_outcomes(messages: DataFrame) -> DataFrame:
    """Per tool use its outcome: the first result of its id in the session; a use of the same tool right after an error is a retry.

    Among the uses of one tool in a session the state before a use is the raw outcome of the last use that has one. Uses
    without a result after an error are retries: the first because of the error, later ones find a retry and are none."""
    uses = _assistant(messages).select(
        _session_key().alias("s"), F.col("id").alias("message_id"), "timestamp", F.posexplode(F.arrays_zip(F.col("tool_names").alias("n"), F.col("tool_use_ids").alias("u"))).alias("pos", "x")
    ).select("s", "message_id", "timestamp", "pos", F.col("x.n").alias("tool"), F.col("x.u").alias("use_id"))
    results = messages.select(_session_key().alias("s"), "timestamp", "id", F.posexplode("tool_outcomes").alias("rp", "o")).groupBy("s", F.col("o.tool_use_id").alias("use_id")).agg(
        F.min_by(F.col("o.outcome"), F.struct("timestamp", "id", "rp")).alias("raw")
    )
    met = uses.join(results, ["s", "use_id"], "left")
    w = W.partitionBy("s", "tool").orderBy("timestamp", "message_id", "pos")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    prior = F.last("raw", ignorenulls=True).over(before)
    # uses without a result since the last one that has one
    bare = F.count_if(F.col("raw").isNull()).over(w.rowsBetween(W.unboundedPreceding, -1)) - F.max(F.when(F.col("raw").isNotNull(), F.col("bares"))).over(before)
    met = met.withColumn("bares", F.count_if(F.col("raw").isNull()).over(w.rowsBetween(W.unboundedPreceding, 0)))
    met = met.withColumns({"prior": prior, "since": F.coalesce(bare, F.lit(0))})
    after_error = (F.col("prior") == "error") & (F.col("since") == 0)
    outcome = F.when(F.coalesce(after_error, F.lit(False)), "retry").otherwise(F.col("raw"))
    out = met.withColumn("outcome", outcome).where("outcome IS NOT NULL")
    heuristic = F.col("outcome") == "retry"
    return out.select(
        "message_id", F.col("s").alias("session_id"), "tool", "use_id", "outcome",
        F.when(heuristic, "heuristic").otherwise("tool_result").alias("source"), F.when(heuristic, "medium").otherwise("high").alias("confidence"),
    )


def tool_outcome_tags(messages: DataFrame) -> DataFrame:
    rows = tool_outcomes(messages).withColumn("id", F.col("message_id"))
    return _tags(rows, {"tool_outcome": F.col("outcome"), "tool_outcome_source": F.col("source"), "tool_outcome_confidence": F.col("confidence")}).distinct()


def with_repo(messages: DataFrame, workspaces: DataFrame) -> DataFrame:
    """repo_id of a cwd from the workspace of the longest path that holds it."""
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    cwds = messages.where("cwd IS NOT NULL").select("cwd").distinct().withColumn("__p", F.explode(up))
    places = workspaces.select(F.regexp_replace("path", "/+$", "").alias("__p"), "remote_url")
    found = cwds.join(places, "__p").groupBy("cwd").agg(F.max_by("remote_url", F.length("__p")).alias("__url"))
    out = messages.join(found, "cwd", "left")
    return out.withColumn("repo_id", F.coalesce("repo_id", repo_of_url(F.col("__url")))).select(*messages.columns)


def with_surface(messages: DataFrame, path: str | None = None) -> DataFrame:
    """Missing surfaces by the source's path, if given, else by the provider."""
    by = F.lit("unknown")
    for p, s in SURFACES.items():
        by = F.when(F.col("provider") == p, s).otherwise(by)
    if path:
        p = F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/")))
        by = F.when(p.rlike("/cursor/"), "cursor").when(p.rlike("/jetbrains/"), "jetbrains").when(p.rlike("/(code|code - insiders|vscodium|\\.vscode-server)/"), "vscode").otherwise(by)
    return messages.withColumn("surface", F.coalesce(F.nullif(F.lower("surface"), F.lit("")), by))
