"""Hourly and daily rollups, session rows and which table serves a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.dims import MEASURES, TimeWindow, facts, money, money_sum

DIMS = ("role", "provider", "model", "repo_id", "git_branch", "surface")
_OF = {"role": "d_role", "provider": "d_provider", "model": "d_model", "repo_id": "d_project", "git_branch": "d_branch", "surface": "d_surface"}
#: Of the rows that daily rollups are exported as.
WIRE_SHAPE = 1


def _rollup(rows: DataFrame, bucket) -> DataFrame:
    return rows.groupBy(bucket, *[F.col(d).alias(n) for n, d in _OF.items()]).agg(
        F.count("*").alias("message_count"),
        *[F.sum(m).alias(m) for m in MEASURES],
        F.sum(money("cost_cents_ingested")).cast("decimal(28,8)").alias("cents_ingested"),
        F.sum("cents").cast("decimal(28,8)").alias("cents_effective"),
    )


def hourly(messages: DataFrame) -> DataFrame:
    """bucket_start, dimensions, message count, token sums and both costs (exact decimals, so rollups add up)."""
    return _rollup(facts(messages), F.date_trunc("hour", F.col("timestamp")).alias("bucket_start"))


def daily(hours: DataFrame) -> DataFrame:
    """Daily from hourly: every measure adds up."""
    return hours.groupBy(F.col("bucket_start").cast("date").alias("bucket_day"), *DIMS).agg(
        *[F.sum(c).alias(c) for c in ("message_count", *MEASURES)], *[F.sum(c).cast("decimal(28,8)").alias(c) for c in ("cents_ingested", "cents_effective")]
    ).withColumn("wire_shape_version", F.lit(WIRE_SHAPE))


def refreshed(hours: DataFrame, messages: DataFrame, touched: DataFrame) -> DataFrame:
    """``hours`` with the days in ``touched`` (column day) made anew from ``messages``; all others stay."""
    days = touched.select(F.col("day").alias("__day")).distinct()
    stay = hours.join(days, hours["bucket_start"].cast("date") == days["__day"], "left_anti")
    anew = hourly(messages.join(days, messages["timestamp"].cast("date") == days["__day"], "left_semi"))
    return stay.unionByName(anew)


SUMS = ("message_count", *MEASURES, "cents_ingested", "cents_effective")


def change_set(added: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """Signed hourly rows of messages that came and went; a changed message is one of each."""
    parts = [hourly(added)] if added is not None else []
    if removed is not None:
        parts.append(hourly(removed).withColumns({c: -F.col(c) for c in SUMS}))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _summed(both, "bucket_start")


def _summed(rows: DataFrame, bucket: str) -> DataFrame:
    sums = rows.groupBy(bucket, *DIMS).agg(*[F.sum(c).cast("decimal(28,8)" if c.startswith("cents") else "bigint").alias(c) for c in SUMS])
    empty = F.lit(True)
    for c in SUMS:
        empty = empty & (F.col(c) == 0)
    return sums.where(~empty)


def maintained(hours: DataFrame, changes: DataFrame) -> DataFrame:
    """``hours`` with signed rows added in; groups without a message are gone. Measures are whole numbers and decimals, so this is what a
    recomputation gives."""
    return _summed(hours.select(*changes.columns).unionByName(changes), "bucket_start").where("message_count > 0")


def drift(stored: DataFrame, recomputed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose stored measures are not those recomputed."""
    measures = ["message_count", *MEASURES, "cents_ingested", "cents_effective"]
    side = lambda df, x: df.select(*[F.col(k).alias(f"{x}_{k}") for k in keys], F.struct(*measures).alias(x))
    on = [F.col(f"s_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    both = side(stored, "s").join(side(recomputed, "r"), on, "full_outer")
    return both.where(~F.col("s").eqNullSafe(F.col("r"))).select(*[F.coalesce(f"s_{k}", f"r_{k}").alias(k) for k in keys], F.col("s").alias("stored"), F.col("r").alias("recomputed"))


def summary_routed(window: TimeWindow, messages: DataFrame, hours: DataFrame, days: DataFrame) -> DataFrame:
    """Totals of a window from the smallest table that serves it: days, hours or messages."""
    to = window.aligned()
    if to == "raw":
        rows = facts(messages.where(window.where())).select("d_role", F.lit(1).alias("message_count"), *MEASURES, "cents")
    else:
        table, at = (days, F.col("bucket_day").cast("timestamp")) if to == "day" else (hours, F.col("bucket_start"))
        rows = table.where(window.where(at)).select(F.col("role").alias("d_role"), "message_count", *MEASURES, F.col("cents_effective").alias("cents"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("message_count"))), F.lit(0))
    return rows.agg(
        n(F.lit(True)).alias("total_messages"), n(F.col("d_role") == "user").alias("user_messages"), n(F.col("d_role") == "assistant").alias("assistant_messages"),
        *dims.token_sums(), money_sum("cents").alias("cost_cents"),
    )


def _latest(c: str):
    return F.max_by(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(c)), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("timestamp", "id")))


def sessions(messages: DataFrame) -> DataFrame:
    """Session rows: first and last time, latest non-empty project and branch, commonest known surface, provider."""
    rows = messages.where("session_id IS NOT NULL AND session_id <> ''")
    base = rows.groupBy(F.col("session_id").alias("id")).agg(
        F.max(dims.provider()).alias("provider"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        _latest("repo_id").alias("repo_id"),
        _latest("git_branch").alias("git_branch"),
    )
    seen = rows.select("session_id", dims.surface().alias("surface")).where("surface <> 'unknown'").groupBy("session_id", "surface").count()
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("count"), "surface"))
    modal = seen.withColumn("k", top).where("k = 1").select(F.col("session_id").alias("id"), "surface")
    out = base.join(modal, "id", "left").withColumn("surface", F.coalesce("surface", F.lit("unknown")))
    return out.withColumn("duration_ms", (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).cast("long") / 1000).withColumn("duration_ms", F.floor("duration_ms").cast("long"))


def session_windows(first: DataFrame, second: DataFrame, newest_ms: int, look_back_ms: int = 30 * 86_400_000) -> DataFrame:
    """Windows of two sources merged: least start, greatest end, missing places filled; those of the look-back only."""
    both = first.unionByName(second).where(F.coalesce("end_ms", F.lit(newest_ms)) >= newest_ms - look_back_ms)
    keep = lambda c: F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("start_ms"))).alias(c)
    return both.groupBy("session_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *[keep(c) for c in ("workspace_root", "repo_id", "git_branch")])


