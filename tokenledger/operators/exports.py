"""Exports: daily rollups and session summaries behind a watermark, in chunks that keep days whole; loading by day."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dims import MEASURES, facts, money_sum
from ..functions.text import ticket
from .rollups import WIRE_SHAPE

CHUNK = 500
#: Parts that sessions are numbered in.
PARTS = 64
#: All that leaves: aggregates, no paths, addresses or texts.
ROLLUP_COLUMNS = ("bucket_day", "role", "provider", "model", "repo_id", "git_branch", "surface", "ticket", "ticket_source", "message_count", *MEASURES, "cost_cents")
SESSION_COLUMNS = ("session_id", "provider", "started_at", "ended_at", "duration_ms", "repo_id", "git_branch", "surface", "ticket", "message_count", *MEASURES, "cost_cents", "primary_model")


def daily_export(days: DataFrame, watermark: date | None, today: date) -> DataFrame:
    """Rollups of days after the watermark, and of today; late rows of closed days do not go again."""
    new = F.lit(True) if watermark is None else (F.col("bucket_day") > F.lit(watermark)) | (F.col("bucket_day") == F.lit(today))
    t = ticket(F.col("git_branch"))
    return days.where(new).withColumns({"ticket": t["id"], "ticket_source": t["source"], "cost_cents": F.col("cents_effective").cast("double")}).select(*ROLLUP_COLUMNS)


def session_export(messages: DataFrame, sessions: DataFrame, since: datetime | None, open_since: datetime | None = None) -> DataFrame:
    """Summaries of sessions that changed since, or are still open, with the model of the most tokens (ties: the latest used)."""
    rows = facts(messages.where("session_id IS NOT NULL")).where("d_role = 'assistant'")
    sums = rows.groupBy("session_id").agg(F.count("*").alias("message_count"), *[F.sum(m).alias(m) for m in MEASURES], money_sum().alias("cost_cents"))
    each = rows.where("d_model <> '(untagged)'").groupBy("session_id", "d_model").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"), F.max("timestamp").alias("at"))
    top = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("t"), F.desc("at"), "d_model"))
    primary = each.withColumn("k", top).where("k = 1").select("session_id", F.col("d_model").alias("primary_model"))
    bound = lambda c, x: F.col(c).cast("timestamp_ntz") >= F.lit(x.isoformat(" ")).cast("timestamp_ntz")
    changed = F.lit(True) if since is None else bound("ended_at", since)
    if open_since is not None:
        changed = changed | bound("ended_at", open_since)
    s = sessions.where(changed).withColumnRenamed("id", "session_id").withColumn("ticket", ticket(F.col("git_branch"))["id"])
    out = s.join(sums, "session_id", "left").join(primary, "session_id", "left").na.fill(0, ["message_count", *MEASURES, "cost_cents"])
    return out.select(*SESSION_COLUMNS)


def pending(days: DataFrame, messages: DataFrame, sessions: DataFrame, watermark: date | None, today: date, since: datetime | None) -> DataFrame:
    """How many rows the next export has."""
    a = daily_export(days, watermark, today).agg(F.count("*").alias("rollups"))
    return a.join(F.broadcast(session_export(messages, sessions, since).agg(F.count("*").alias("sessions"))), F.lit(True))  # one row each


def chunked_days(rollups: DataFrame, least: int = CHUNK) -> DataFrame:
    """``rollups`` with chunk_id: whole days, in order, until a chunk has ``least`` rows. Days are counted on the driver: one row each."""
    chunk, n, cuts = 0, 0, []
    for r in rollups.groupBy("bucket_day").count().orderBy("bucket_day").collect():
        cuts.append((r["bucket_day"], chunk))
        n += r["count"]
        if n >= least:
            chunk, n = chunk + 1, 0
    of = rollups.sparkSession.createDataFrame(cuts, "bucket_day date, chunk_id int")
    return rollups.join(F.broadcast(of), "bucket_day")


def chunked_sessions(sessions: DataFrame, most: int = CHUNK) -> DataFrame:
    """``sessions`` with chunk_id: ``most`` a chunk, in order of their ids; numbers come from parts of that order and their sizes."""
    # parts of the ids' order between the ids of the smallest hashes: the same in every run, unlike a range partitioning's
    bounds = sorted((r[0] for r in sessions.orderBy(F.xxhash64("session_id"), "session_id").limit(PARTS - 1).select("session_id").collect()), key=str.encode)
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<string>"), lambda b: b <= F.col("session_id")))
    ranged = sessions.withColumn("__p", part)
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}  # PARTS rows at most
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    bases = sessions.sparkSession.createDataFrame(base, "__p int, __base long")
    at = F.row_number().over(W.partitionBy("__p").orderBy("session_id")) - 1 + F.col("__base")
    return ranged.join(F.broadcast(bases), "__p").withColumn("chunk_id", F.floor(at / most).cast("int")).drop("__p", "__base")


def read_watermark(spark: SparkSession, path: str) -> date | None:
    """The latest day since the last reset; None before the first export."""
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max(F.struct("epoch", "watermark")).alias("w")).first()["w"]["watermark"]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("epoch long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def write_watermark(spark: SparkSession, path: str, watermark: date | None) -> None:
    """Advance after an export has succeeded: a new file beside the old ones, so a crash loses none. None resets by a row that older ones do not outlive."""
    seen = spark.read.parquet(path).agg(F.max("epoch")).first()[0] if _exists(spark, path) else None
    row = [(0 if seen is None else seen + 1 if watermark is None else seen, watermark)]
    spark.createDataFrame(row, "epoch long, watermark date").coalesce(1).write.mode("append").parquet(path)


def stale_shape(days: DataFrame) -> bool:
    """Whether exported rows are of an older shape, so that all must go again."""
    row = days.agg(F.max("wire_shape_version").alias("v")).first()
    return row["v"] is not None and row["v"] < WIRE_SHAPE


def write_days(messages: DataFrame, path: str) -> None:
    """Messages by day; only the days that ``messages`` has are replaced. Ranges of day and hashed id: a large day is several tasks' work."""
    _by_day(messages).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_day").parquet(path)


def _by_day(messages: DataFrame) -> DataFrame:
    return messages.withColumn("bucket_day", F.col("timestamp").cast("date")).repartitionByRange("bucket_day", F.xxhash64("id"))


def reload_days(messages: DataFrame, path: str) -> None:
    """A forced reload: ``messages`` replace the whole table, days that they lack included. Streams begin again with a checkpoint of their own."""
    rows = _by_day(messages)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket_day").parquet(path)


