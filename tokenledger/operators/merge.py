"""Dedup, merge, matching and repair of messages, tags and sessions."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import TimeWindow
from ..functions.text import looks_like_repo
from ..functions.workers import importable
from .enrich import ticket_tags
from .intervals import in_interval

TICKET_KEYS = ("ticket_id", "ticket_prefix", "ticket_source")
#: Keys of older releases. Fixed values.
LEGACY_KEYS = ("branch", "repo", "cwd", "dominant_tool")


def dedup_requests(messages: DataFrame, order: str = "line_no") -> DataFrame:
    """Within a batch one row per request: the most output tokens, the first of equals; rows without a request stay."""
    w = W.partitionBy(F.coalesce("request_id", "id")).orderBy(F.desc("output_tokens"), order)
    return messages.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def merged(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, id map of batch rows to survivors). A row of the same request and session keeps the stored id; output tokens and
    costs become those of the larger output, of equal ones those of the smaller id. A row without a session meets its request in any
    session. Rows of a known id are not taken again."""
    fresh = batch.join(stored.select("id"), "id", "left_anti")
    following = [c for c in ("output_tokens", "cost_cents_ingested", "cost_cents_effective") if c in stored.columns]
    requests = stored.where("request_id IS NOT NULL").select("request_id", "session_id", "id")
    own = requests.where("session_id IS NOT NULL").groupBy("request_id", "session_id").agg(F.min("id").alias("__own"))
    of_any = requests.groupBy("request_id").agg(F.min("id").alias("__any"))
    met = fresh.join(own, ["request_id", "session_id"], "left").join(of_any, "request_id", "left")
    met = met.withColumn("__old", F.coalesce("__own", F.when(F.col("session_id").isNull(), F.col("__any"))))
    best = met.where("__old IS NOT NULL").groupBy(F.col("__old").alias("id")).agg(
        F.min_by(F.struct(*following), F.when(F.col("output_tokens").isNotNull(), F.struct(-F.col("output_tokens"), "id"))).alias("__new")
    )
    larger = F.col("__new.output_tokens") > F.col("output_tokens")
    kept = stored.join(best, "id", "left")
    changed = {c: F.when(larger, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in following}
    rows = kept.withColumns(changed).select(*stored.columns).unionByName(met.where("__old IS NULL").select(*stored.columns))
    return rows, met.select("id", F.coalesce("__old", "id").alias("survivor"))


def rekeyed(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Tags of batch rows on the rows that survived them, each once."""
    t = tags.join(ids, tags["message_id"] == ids["id"], "left")
    return t.select(F.coalesce("survivor", "message_id").alias("message_id"), "key", "value").dropDuplicates()


def matched_exact(messages: DataFrame, exact: DataFrame, seconds: int = 1) -> DataFrame:
    """(id, match, how): the authoritative row of each message within ``seconds`` in the same session and of the same model.

    The same request id first (the nearest), else the only one of equal tokens, else the only one there; others have none."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds * 1_000_000
    near = lambda c: F.floor(at(c) / span)
    m = messages.select("id", "session_id", "model", "request_id", "input_tokens", "output_tokens", at("timestamp").alias("t"), near("timestamp").alias("__b"))
    e = exact.select(
        F.col("id").alias("match"), F.col("session_id").alias("__s"), F.col("model").alias("__m"), F.col("request_id").alias("e_request"),
        F.col("input_tokens").alias("e_in"), F.col("output_tokens").alias("e_out"), at("timestamp").alias("e_t"),
        F.explode(F.array(near("timestamp") - 1, near("timestamp"), near("timestamp") + 1)).alias("__eb"),
    )
    on = (F.col("session_id") == F.col("__s")) & F.col("model").eqNullSafe(F.col("__m")) & (F.col("__b") == F.col("__eb"))
    pairs = m.join(e, on).where((F.abs(F.col("t") - F.col("e_t")) <= span) & (F.col("id") != F.col("match")))
    same = F.coalesce(F.col("request_id") == F.col("e_request"), F.lit(False))
    print_ = (F.col("input_tokens") == F.col("e_in")) & (F.col("output_tokens") == F.col("e_out"))
    mine = W.partitionBy("id")
    ranked = pairs.withColumns({"same": same, "print": print_, "n": F.count("*").over(mine), "prints": F.count_if(print_).over(mine), "sames": F.count_if(same).over(mine)})
    how = F.when(F.col("same"), "request").when((F.col("sames") == 0) & F.col("print") & (F.col("prints") == 1), "fingerprint").when((F.col("sames") == 0) & (F.col("prints") != 1) & (F.col("n") == 1), "sole")
    best = F.row_number().over(mine.orderBy(F.abs(F.col("t") - F.col("e_t")), "match"))
    return ranked.withColumn("how", how).where("how IS NOT NULL").withColumn("k", best).where("k = 1").select("id", "match", "how")


def assigned_sessions(messages: DataFrame, windows: DataFrame, **kind) -> DataFrame:
    """Messages without a session get that of the window they fall into."""
    at = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000)
    orphans = messages.where("session_id IS NULL").select("id", at.alias("at_ms"))
    found = in_interval(orphans, windows, **kind).withColumnRenamed("session_id", "__s")
    return messages.join(found, "id", "left").withColumn("session_id", F.coalesce("session_id", "__s")).select(*messages.columns)


def _blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def repaired_branches(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Missing branches from the session's row, else from the session's messages."""
    s = sessions.select(F.col("id").alias("__s"), F.nullif(F.col("git_branch"), F.lit("")).alias("__b"))
    own = messages.where("session_id IS NOT NULL AND git_branch <> ''").groupBy("session_id").agg(F.min_by("git_branch", F.struct("timestamp", "id")).alias("__m"))
    out = messages.join(s, messages["session_id"] == s["__s"], "left").join(own, "session_id", "left")
    return out.withColumn("git_branch", F.coalesce(_blank("git_branch"), "__b", "__m")).select(*messages.columns)


def repaired_context(messages: DataFrame, sessions: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Missing cwd, project and branch from the session's row; workspaces (path, remote) rewrite roots first."""
    s = sessions.select(F.col("id").alias("__s"), *[F.col(c).alias(f"__{c}") for c in ("workspace_root", "repo_id", "git_branch")])
    if workspaces is not None:
        s = s.join(workspaces.select(F.col("path").alias("__workspace_root"), F.col("repo_id").alias("__w")), "__workspace_root", "left").withColumn("__repo_id", F.coalesce(_blank("__repo_id"), "__w"))
    out = messages.join(s, messages["session_id"] == s["__s"], "left")
    new = {"cwd": "__workspace_root", "repo_id": "__repo_id", "git_branch": "__git_branch"}
    return out.withColumns({c: F.coalesce(_blank(c), _blank(o)) for c, o in new.items()}).select(*messages.columns)


def _since(now: datetime, days: int) -> Column:
    return TimeWindow(since=now - timedelta(days=days)).where()


def ticket_backfill(messages: DataFrame, tags: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """Ticket tags of rows that have none yet."""
    have = tags.where("key = 'ticket_id'").select(F.col("message_id").alias("id")).distinct()
    return ticket_tags(messages.where(_since(now, days)).join(have, "id", "left_anti"))


def activity_backfill(messages: DataFrame, tags: DataFrame, sessions: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """Activity tags, from the session's category, of rows that have none."""
    have = tags.where("key = 'activity'").select(F.col("message_id").alias("id")).distinct()
    s = sessions.where("prompt_category <> ''").select(F.col("id").alias("session_id"), "prompt_category")
    rows = messages.where(_since(now, days)).where("role = 'assistant'").join(have, "id", "left_anti").join(s, "session_id")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("activity", F.col("prompt_category")), ("activity_source", F.lit("session")), ("activity_confidence", F.lit("low")))]))
    return rows.select(F.col("id").alias("message_id"), each.alias("t")).select("message_id", "t.*")


def session_titles(messages: DataFrame, tags: DataFrame) -> DataFrame:
    """Per session its commonest title tag, ties to the smaller."""
    own = tags.where("key = 'session_title'").join(messages.where("session_id IS NOT NULL").select("id", "session_id"), F.col("message_id") == F.col("id"))
    each = own.groupBy("session_id", "value").count()
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "value"))
    return each.withColumn("k", top).where("k = 1").select("session_id", F.col("value").alias("title"))


def truncated_title(text: Column, most: int = 80) -> Column:
    """The first line, cut before a word that would pass ``most`` characters."""
    line = F.trim(F.regexp_replace(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), r"\s+", " "))
    cut = F.regexp_replace(F.left(line, F.lit(most)), r"\s+\S*$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.when(F.substring(line, most + 1, 1) == " ", F.rtrim(F.left(line, F.lit(most)))).otherwise(cut), F.lit("…")))


def first_prompt_titles(turns: DataFrame, session: str = "session_id", order: str = "timestamp", text: str = "text") -> DataFrame:
    first = turns.where("role = 'user'").where(F.trim(text) != "").groupBy(session).agg(F.min_by(text, order).alias("__t"))
    return first.select(session, truncated_title(F.col("__t")).alias("title"))


def purged_tickets(tags: DataFrame, denied: tuple[str, ...]) -> DataFrame:
    """Without the ticket tags of messages whose ticket's prefix is denied."""
    bad = tags.where("key = 'ticket_id'").where(F.upper(F.split_part("value", F.lit("-"), F.lit(1))).isin(*denied)).select(F.col("message_id").alias("__m")).distinct()
    return tags.join(bad, (F.col("message_id") == F.col("__m")) & F.col("key").isin(*TICKET_KEYS), "left_anti")


def without_legacy_tags(tags: DataFrame) -> DataFrame:
    return tags.where(~F.col("key").isin(*LEGACY_KEYS))


def without_false_repos(messages: DataFrame) -> DataFrame:
    return messages.withColumn("repo_id", F.when(looks_like_repo(F.col("repo_id")), F.col("repo_id")))


def before_first_legacy(messages: DataFrame, legacy: DataFrame) -> DataFrame:
    """Imported rows from before the first retained legacy row; all if there is none."""
    first = legacy.agg(F.min("timestamp").alias("__first"))
    return messages.join(F.broadcast(first), F.lit(True)).where(F.col("__first").isNull() | (F.col("timestamp") < F.col("__first"))).drop("__first")


def retained(sessions: DataFrame, now: datetime, raw_days: int = 30, identity_days: int = 90) -> DataFrame:
    """Raw payloads and identities of sessions that ended too long ago go."""
    old = lambda days: ~TimeWindow(since=now - timedelta(days=days)).where(F.coalesce("ended_at", "started_at"))
    null = F.lit(None).cast("string")
    return sessions.withColumns(
        {"raw_json": F.when(old(raw_days), null).otherwise(F.col("raw_json"))}
        | {c: F.when(old(identity_days), null).otherwise(F.col(c)) for c in ("user_email", "workspace_root")}
    )


def minimized(c: Column, policy: str) -> Column:
    """A sensitive value in full, hashed or left out."""
    if policy == "full":
        return c
    if policy == "omit":
        return F.lit(None).cast("string")
    if policy != "hash":
        raise ValueError(f"no such policy: {policy}")
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit("sha256:"), F.left(F.sha2(c, 256), F.lit(24)))).otherwise(c)


#: Keys whose texts are minimized, at any depth. Fixed values.
SENSITIVE_KEYS = ("user_email", "cwd", "workspace_root", "workspace_roots", "project_dir")


def _hashed_text(x):
    return "sha256:" + hashlib.sha256(x.encode()).hexdigest()[:24] if isinstance(x, str) and x.strip() else x


def _without_sensitive(x):
    """A JSON value in which texts, and texts of lists, under a sensitive key are hashed; all else stays as it is."""
    if isinstance(x, list):
        return [_without_sensitive(v) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if k in SENSITIVE_KEYS:
            v = [_hashed_text(i) for i in v] if isinstance(v, list) else _hashed_text(v)
        out[k] = _without_sensitive(v)
    return out


def _hashed_json(t: str | None) -> str | None:
    try:
        return json.dumps(_without_sensitive(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
    except (TypeError, ValueError):
        return None


def minimized_json(c: Column, policy: str) -> Column:
    """A raw payload in full, with its sensitive texts hashed at any depth (null if it is no JSON), or left out.

    JSON of any shape is beyond column functions: Arrow batches through a small helper."""
    if policy == "full":
        return c
    if policy == "omit":
        return F.lit(None).cast("string")
    if policy != "hash":
        raise ValueError(f"no such policy: {policy}")
    importable(SparkSession.active())

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(_hashed_json)

    return hashed(c)
