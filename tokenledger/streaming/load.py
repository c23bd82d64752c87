"""Batches into the message table, its tags, its sessions and its index of requests, all by one commit.

* ``path``: messages by ``bucket_day``. A batch replaces the days that get new rows or whose rows change, and no others.
* ``path.keys``: by bucket of a key's hash and load: the day and id of each message, by its id and by its request. A batch meets it to learn
  which days hold rows that it meets, whatever their age; only these days are read.
* ``path.tags``: tags by the day of their message and load, each once.
* ``path.sessions``: by load, what a batch's new messages say of a session; ``session_rows`` adds the loads up.
* ``path.hours``: hourly rollups by day, kept by signed rows of what came, went or changed, if messages have both costs.
* ``path.runs``: by load, what ``rewrite`` has changed.

What grows by load has a partition for each, so putting a commit in place again adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..functions import dims
from ..operators.commits import Commits, Write, found
from ..operators import rollups
from ..operators.merge import dedup_requests, merged, rekeyed

#: Partitions of the index.
BUCKETS = 16
KEYS = "bucket int, load string, kind string, key string, session_id string, id string, bucket_day date"
TAGS = "bucket_day date, load string, message_id string, key string, value string"
HOURS = (
    "bucket_day date, bucket_start timestamp, role string, provider string, model string, repo_id string, git_branch string, surface string, message_count bigint, input_tokens bigint, output_tokens bigint, "
    "cache_creation_tokens bigint, cache_read_tokens bigint, cents_ingested decimal(28,8), cents_effective decimal(28,8)"
)
RUNS = "load string, kind string, at timestamp, processed bigint, changed bigint, before_cents decimal(28,8), after_cents decimal(28,8)"
#: What a repricing or a reconciliation changes in a message.
COSTS = ("cost_cents_ingested", "cost_cents_effective", "pricing_source", "cost_confidence")
_AT = "struct<timestamp:timestamp,id:string>"
SESSIONS = (
    "load string, id string, provider string, started_at timestamp, ended_at timestamp, "
    f"repo_id string, repo_at {_AT}, git_branch string, branch_at {_AT}, prompt_category string, category_at {_AT}, surfaces map<string,bigint>"
)


def keys_of(rows: DataFrame) -> DataFrame:
    """(bucket, kind, key, session_id, id, bucket_day) of messages: one by the id, one by the request if there is one."""
    each = F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("request").alias("kind"), F.col("request_id").alias("key"))))
    out = rows.select("session_id", "id", "bucket_day", each.alias("k")).select("k.*", "session_id", "id", "bucket_day").where("key IS NOT NULL")
    return out.withColumn("bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(BUCKETS)).cast("int"))


def in_days(days: list) -> Column:
    """A condition on ``bucket_day`` that prunes folders."""
    some = [d for d in days if d is not None]
    own = F.col("bucket_day").isin(some) if some else F.lit(False)
    return own | F.col("bucket_day").isNull() if None in days else own


def _days(rows: DataFrame) -> list:
    return [r[0] for r in rows.select("bucket_day").distinct().collect()]  # one row a day


def met_days(batch: DataFrame, index: DataFrame | None) -> list:
    """Days of stored messages whose id or request a batch row has; a row without a session meets its request in any."""
    if index is None:
        return []
    mine = keys_of(batch.withColumn("bucket_day", F.lit(None).cast("date"))).select("bucket", "kind", "key", F.col("session_id").alias("__s")).distinct()
    buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # BUCKETS at most
    same = (F.col("kind") == "id") | F.col("__s").isNull() | (F.col("session_id") == F.col("__s"))
    return _days(index.where(F.col("bucket").isin(buckets)).join(mine, ["bucket", "kind", "key"]).where(same))


def session_parts(rows: DataFrame) -> DataFrame:
    """What messages say of their sessions, in a form that adds up: ``session_rows``."""
    rows = rows.where("session_id IS NOT NULL AND session_id <> ''")
    at = F.struct(F.col("timestamp").cast("timestamp").alias("timestamp"), "id")
    last = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", at)
    category = "prompt_category" if "prompt_category" in rows.columns else None
    own = rows.withColumns({"__surface": dims.surface(), "__category": F.col(category) if category else F.lit(None).cast("string")})
    known = own.groupBy("session_id", "__surface").agg(
        F.max(dims.provider()).alias("provider"), F.min(F.col("timestamp").cast("timestamp")).alias("started_at"), F.max(F.col("timestamp").cast("timestamp")).alias("ended_at"), F.count("*").alias("n"),
        *[x for c, a in (("repo_id", "repo_at"), ("git_branch", "branch_at"), ("__category", "category_at")) for x in (F.max_by(c, last(c)).alias(c), F.max(last(c)).alias(a))],
    )
    counts = F.map_from_entries(F.collect_list(F.when(F.col("__surface") != "unknown", F.struct("__surface", "n"))))  # a few surfaces a session
    return known.groupBy(F.col("session_id").alias("id")).agg(
        F.max("provider").alias("provider"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        *[x for c, a, n in (("repo_id", "repo_at", "repo_id"), ("git_branch", "branch_at", "git_branch"), ("__category", "category_at", "prompt_category")) for x in (F.max_by(c, a).alias(n), F.max(a).alias(a))],
        counts.alias("surfaces"),
    )


def session_rows(parts: DataFrame) -> DataFrame:
    """Sessions from the parts of all loads: first and last time, the latest known project, branch and category, the commonest known surface."""
    base = parts.groupBy("id").agg(
        F.max("provider").alias("provider"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.max_by("repo_id", "repo_at").alias("repo_id"), F.max_by("git_branch", "branch_at").alias("git_branch"), F.max_by("prompt_category", "category_at").alias("prompt_category"),
    )
    seen = parts.select("id", F.explode("surfaces").alias("surface", "n")).groupBy("id", "surface").agg(F.sum("n").alias("n"))
    modal = seen.groupBy("id").agg(F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("surface"))
    span = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000
    return base.join(modal, "id", "left").withColumns({"surface": F.coalesce("surface", F.lit("unknown")), "duration_ms": F.floor(span).cast("long")})


def stored_tags(spark: SparkSession, path: str) -> DataFrame | None:
    out = found(spark, f"{path}.tags", TAGS)
    return None if out is None else out.select("message_id", "key", "value")


def stored_sessions(spark: SparkSession, path: str) -> DataFrame | None:
    out = found(spark, f"{path}.sessions", SESSIONS)
    return None if out is None else session_rows(out)


def clear(spark: SparkSession, path: str) -> None:
    """The tables of ``path`` without a row: every partition goes."""
    day = StructType([StructField("id", StringType()), StructField("bucket_day", DateType())])
    for at, schema, by in ((path, day, ("bucket_day",)), (f"{path}.keys", KEYS, ("bucket", "load")), (f"{path}.tags", TAGS, ("bucket_day", "load")), (f"{path}.sessions", SESSIONS, ("load",)), (f"{path}.hours", HOURS, ("bucket_day",))):
        if found(spark, at, schema) is not None:
            spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(at)


def stored_hours(spark: SparkSession, path: str) -> DataFrame | None:
    out = found(spark, f"{path}.hours", HOURS)
    return None if out is None else out.where("message_count > 0").drop("bucket_day")


def _hours(spark: SparkSession, path: str, changes: DataFrame, days: list) -> Write:
    """The hours of ``days`` with signed rows added in."""
    old = found(spark, f"{path}.hours", HOURS)
    old = spark.createDataFrame([], HOURS) if old is None else old.where(in_days(days))
    new = rollups.maintained(old, changes).withColumn("bucket_day", F.col("bucket_start").cast("date"))
    # a day that has lost its last group keeps a row of nothing: a partition without rows would not be replaced
    lost = old.select("bucket_day").distinct().join(new.select("bucket_day").distinct(), "bucket_day", "left_anti")
    kept = new.unionByName(lost, allowMissingColumns=True)
    return Write("hours", kept.na.fill(0, ["message_count"]), f"{path}.hours", ("bucket_day",), "bucket_start")


def _finish(spark: SparkSession, others: Sequence[str]) -> None:
    for staging in others:
        Commits(spark, staging).last()


def rewrite(spark: SparkSession, path: str, staging: str, epoch: int, change: Callable[[DataFrame], DataFrame], kind: str, now: datetime, others: Sequence[str] = ()) -> dict | None:
    """Costs of stored messages made anew by ``change`` (a repricing, a backfill of prices, a bill), with their rollups and an audit row, by one
    commit; what it has done, or None if the number is committed.

    ``change`` gets messages of whole days and returns them with the same columns. A first pass over the table counts, by day, the
    rows that change (an effective cost by more than 1e-9, or any other of ``COSTS``); only days that have some are read again and
    written. ``others`` are staging folders of the table's other writers, of which only one may be at work at a time."""
    _finish(spark, others)
    commits = Commits(spark, staging)
    last = commits.last()
    if last is not None and epoch <= last:
        return None
    table = spark.read.parquet(path)
    costs = [c for c in COSTS if c in table.columns]
    before = F.struct(*costs)

    def marked(rows: DataFrame) -> DataFrame:
        out = change(rows.withColumn("__old", before))
        near = F.abs(F.col("cost_cents_effective") - F.col("__old.cost_cents_effective")) <= 1e-9
        same = F.coalesce(near, F.col("cost_cents_effective").isNull() & F.col("__old.cost_cents_effective").isNull())
        for c in costs:
            if c != "cost_cents_effective":
                same = same & F.col(c).eqNullSafe(F.col(f"__old.{c}"))
        return out.withColumn("__new", ~same)

    exact = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,8)")), F.lit(0)).cast("decimal(28,8)")
    by_day = marked(table).groupBy("bucket_day").agg(
        F.count("*").alias("processed"), F.count_if("__new").alias("changed"), exact("__old.cost_cents_effective").alias("before"), exact("cost_cents_effective").alias("after")
    ).collect()  # one row a day
    told = {"processed": sum(r["processed"] for r in by_day), "changed": sum(r["changed"] for r in by_day), "before_cents": sum((r["before"] for r in by_day), Decimal(0)), "after_cents": sum((r["after"] for r in by_day), Decimal(0))}
    days = [r["bucket_day"] for r in by_day if r["changed"]]
    rows = marked(table.where(in_days(days)))
    load = commits.name(epoch)
    run = spark.createDataFrame([(load, kind, now, *told.values())], RUNS)
    writes = [Write("runs", run, f"{path}.runs", ("load",), "kind")]
    if days:
        writes.append(Write("messages", rows.select(*table.columns), path, ("bucket_day",), "id"))
        changed = rows.where("__new")
        gone = changed.withColumns({c: F.col(f"__old.{c}") for c in costs})
        writes.append(_hours(spark, path, rollups.change_set(changed, gone), days))
    commits.commit(epoch, writes)
    return told


def load_batch(batch: DataFrame, path: str, staging: str, epoch: int, tags: Callable[[DataFrame], DataFrame] | None = None, others: Sequence[str] = ()) -> None:
    """Merge a batch and the tags (message_id, key, value) that ``tags`` makes of it into the tables of ``path``.

    A batch whose number is committed changes nothing; one that a dead run has sealed is put in place as it was sealed. Ids and requests
    that are stored are met, at any age: a larger output takes over in the stored row, tags go to the row that survives."""
    spark = batch.sparkSession
    _finish(spark, others)
    commits = Commits(spark, staging)
    last = commits.last()
    if last is not None and epoch <= last:
        return
    batch = dedup_requests(batch, "id").persist()
    try:
        commits.commit(epoch, _writes(batch, path, commits.name(epoch), None if tags is None else tags(batch)))
    finally:
        batch.unpersist()


def _writes(batch: DataFrame, path: str, load: str, tags: DataFrame | None) -> list[Write]:
    spark = batch.sparkSession
    day = F.col("timestamp").cast("date")
    schema = StructType([*batch.schema, StructField("bucket_day", DateType())])
    days = sorted({*_days(batch.select(day.alias("bucket_day"))), *met_days(batch, found(spark, f"{path}.keys", KEYS))}, key=str)
    table = found(spark, path, schema)
    stored = spark.createDataFrame([], schema) if table is None else table.where(in_days(days))
    rows, ids = merged(stored.drop("bucket_day"), batch)
    rows = rows.withColumn("bucket_day", day)
    fresh = rows.join(ids.where("id = survivor").select("id"), "id", "left_semi")
    # days with new rows, and days whose rows have changed
    before = stored.select("id", F.struct(*[c for c in ("output_tokens", "cost_cents_ingested", "cost_cents_effective") if c in batch.columns]).alias("b"))
    after = rows.select("id", "bucket_day", F.struct(*before.schema["b"].dataType.names).alias("a"))
    met = ids.where("id <> survivor").select(F.col("survivor").alias("id")).distinct()
    changed = after.join(met, "id", "left_semi").join(before, "id").where(~F.col("a").eqNullSafe(F.col("b")))
    touched = _days(fresh.select("bucket_day").unionByName(changed.select("bucket_day")))
    named = lambda df: df.withColumn("load", F.lit(load))
    out = [
        Write("messages", rows.where(in_days(touched)), path, ("bucket_day",), "id"),
        Write("keys", named(keys_of(fresh)), f"{path}.keys", ("bucket", "load"), "key"),
        Write("sessions", named(session_parts(fresh.drop("bucket_day"))), f"{path}.sessions", ("load",), "id"),
    ]
    if {"cost_cents_ingested", "cost_cents_effective"} <= set(batch.columns):
        old = stored.join(changed.select("id"), "id", "left_semi")
        new = rows.join(changed.select("id"), "id", "left_semi").unionByName(fresh)
        out.append(_hours(spark, path, rollups.change_set(new, old), touched))
    if tags is not None:
        # rows of a known id bring nothing new; the others' tags stand on the survivor, in its day
        own = rekeyed(tags.join(ids, tags["message_id"] == ids["id"], "left_semi"), ids)
        placed = own.join(rows.select(F.col("id").alias("message_id"), "bucket_day"), "message_id")
        old = found(spark, f"{path}.tags", TAGS)
        if old is not None:
            placed = placed.join(old.where(in_days(days)).select("message_id", "key", "value"), ["message_id", "key", "value"], "left_anti")
        out.append(Write("tags", named(placed), f"{path}.tags", ("bucket_day", "load"), "message_id"))
    return out
