"""Structured Streaming: transcripts into the message table, live rollups, context carried across batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import dims
from ..operators.enrich import CATEGORY
from ..operators.rollups import hourly
from ..sources.transcripts import numbered, raw_lines
from .load import clear, load_batch


def transcript_files(spark: SparkSession, path: str, most_files: int = 200, most_bytes: str | None = None) -> DataFrame:
    """A stream of the lines of files that are complete when they appear; ``ingest`` numbers them batch by batch."""
    limit = ("maxBytesPerTrigger", most_bytes) if most_bytes else ("maxFilesPerTrigger", most_files)
    return raw_lines(spark.readStream.option(*limit), path)


Parse = Callable[[DataFrame], DataFrame]


def ingest(lines: DataFrame, parse: Parse, path: str, checkpoint: str, staging: str, available_now: bool = True, tags: Parse | None = None) -> StreamingQuery:
    """Lines through ``parse`` (and what it does besides) into the tables of ``path`` (``load``), with the tags that ``tags`` makes of a
    parsed batch; the same checkpoint serves live and catch-up runs."""

    def take(df: DataFrame, epoch: int) -> None:
        load_batch(parse(df if "line_no" in df.columns else numbered(df)), path, staging, epoch, tags)

    writer = lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="5 seconds").start()


def reload(lines: DataFrame, parse: Parse, path: str, checkpoint: str, staging: str, tags: Parse | None = None) -> StreamingQuery:
    """A forced reload: what was ingested is cleared, and all sources are taken again under a checkpoint that no run has used.

    ``lines`` has to be a new stream of the sources."""
    clear(lines.sparkSession, path)
    fresh = uuid.uuid4().hex
    return ingest(lines, parse, path, f"{checkpoint}/{fresh}", f"{staging}/{fresh}", tags=tags)


def live_hourly(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """A streaming hourly rollup for append-only messages: counts, tokens and cost by provider and model (update mode)."""
    f = dims.facts(messages.withWatermark("timestamp", late))
    return f.groupBy(F.window("timestamp", "1 hour"), "d_role", "d_provider", "d_model").agg(
        F.count("*").alias("message_count"), *[F.sum(m).alias(m) for m in dims.MEASURES], F.sum("cents").cast("double").alias("cost_cents")
    ).select(F.col("window.start").alias("bucket_start"), F.col("d_role").alias("role"), F.col("d_provider").alias("provider"), F.col("d_model").alias("model"), "message_count", *dims.MEASURES, "cost_cents")


def refresh_touched(messages: DataFrame, touched: DataFrame) -> DataFrame:
    """Hours of the touched days made anew: corrected rows change closed hours, which a streaming aggregate cannot."""
    days = touched.select(F.col("day").alias("__day")).distinct()
    return hourly(messages.join(days, messages["timestamp"].cast("date") == days["__day"], "left_semi"))


CONTEXT = ("git_branch", "repo_id", "cwd")
ROW = "id string, session_id string, timestamp timestamp"
#: A session is forgotten after a week without rows.
FORGOTTEN_MS = 7 * 86_400_000


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _strings(names) -> str:
    return ", ".join(f"{n} string" for n in names)


def _missing(v) -> bool:
    return v is None or v != v


class CarriedContext(StatefulProcessor):
    """A session's last known branch, project and cwd, and its last category with source and confidence as one, from batch to batch."""

    def __init__(self, category: bool):
        self.category = category

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _strings((*CONTEXT, *CATEGORY)), FORGOTTEN_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = (*CONTEXT, *CATEGORY)
        known = dict(zip(held, self.last.get())) if self.last.exists() else dict.fromkeys(held)
        batch = pd.concat(list(rows)).sort_values(["timestamp", "id"], kind="stable")
        for c in CONTEXT:
            values = []
            for v in batch[c]:
                if _missing(v):
                    v = known[c]
                elif v != "":
                    known[c] = v
                values.append(v)
            batch[c] = values
        if self.category:
            whole = []
            for own in batch[list(CATEGORY)].itertuples(index=False, name=None):
                if _missing(own[0]):
                    own = tuple(known[c] for c in CATEGORY)
                elif own[0] != "":
                    known.update((c, None if _missing(v) else v) for c, v in zip(CATEGORY, own))
                whole.append(own)
            batch[list(CATEGORY)] = pd.DataFrame(whole, columns=list(CATEGORY), index=batch.index, dtype=object)
        self.last.update(tuple(known[c] for c in held))
        yield batch[_names(ROW) + list(CONTEXT) + (list(CATEGORY) if self.category else [])]

    def close(self) -> None:
        pass


def carried_across_batches(messages: DataFrame) -> DataFrame:
    """A stream of (id, session_id, timestamp, git_branch, repo_id, cwd), and the category's three columns if they are there, with nulls filled
    from the session's past batches too.

    Needs the RocksDB state store provider; catch-up runs (availableNow) also spark.sql.streaming.noDataMicroBatches.enabled=false,
    since state with a time to live keeps asking for batches without data."""
    category = set(CATEGORY) <= set(messages.columns)
    schema = ", ".join((ROW, _strings(CONTEXT), *([_strings(CATEGORY)] if category else [])))
    rows = messages.select(*_names(schema)).where("session_id IS NOT NULL")
    return rows.groupBy("session_id").transformWithStateInPandas(CarriedContext(category), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


class FirstIdentities(StatefulProcessor):
    """Each value of a session once, on the session's first assistant row; values that come before it wait for it."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id string", FORGOTTEN_MS)
        self.seen = handle.getMapState("seen", "key string, value string", "told boolean", FORGOTTEN_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get()[0] if self.first.exists() else None
        out = []
        for batch in [pd.concat(list(rows)).sort_values(["timestamp", "id"], kind="stable")]:
            for row in batch.to_dict("records"):
                if first is None and (_missing(row["role"]) or row["role"] == "assistant"):
                    first = row["id"]
                    self.first.update((first,))
                    for (k, v), told in list(self.seen.iterator()):
                        if not told[0]:
                            out.append((first, k, v))
                            self.seen.updateValue((k, v), (True,))
                for k, c in self.columns.items():
                    v = row[c]
                    if not _missing(v) and v != "" and not self.seen.containsKey((k, v)):
                        self.seen.updateValue((k, v), (first is not None,))
                        if first is not None:
                            out.append((first, k, v))
        yield pd.DataFrame(out, columns=["message_id", "key", "value"])

    def close(self) -> None:
        pass


def identities_across_batches(messages: DataFrame, keys: dict[str, str]) -> DataFrame:
    """A stream of identity tags (``keys``: tag key to column): many batches, each session's rows in the order of time, give the tags of one.

    Needs what ``carried_across_batches`` needs."""
    session = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.col("id"))
    values = {k: f"value_{n}" for n, k in enumerate(keys)}
    rows = messages.select(session.alias("session"), "id", "role", "timestamp", *[F.col(keys[k]).cast("string").alias(c) for k, c in values.items()])
    state = FirstIdentities(values)
    return rows.groupBy("session").transformWithStateInPandas(state, outputStructType="message_id string, key string, value string", outputMode="Append", timeMode="ProcessingTime")


class ToolOutcomes(StatefulProcessor):
    """Outcomes of a session's tool uses, whose results come on later rows.

    A use is told once its own result and that of the tool's use before it are known: it is a retry after an error, else what its result says.
    Uses that wait for a result when the session's time is up are decided by what is there. Of what is told, the last use of each tool stays,
    as the one before the next."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getMapState("uses", "tool string, at bigint, id string, pos int", "use_id string, told boolean")
        self.results = handle.getMapState("results", "use_id string", "at bigint, id string, pos int, outcome string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for batch in rows:
            for at, i, pos, tool, use, outcome in batch[["at", "id", "pos", "tool", "use_id", "outcome"]].itertuples(index=False, name=None):
                latest = max(latest, at)
                if _missing(outcome):
                    if not self.uses.containsKey((tool, at, i, pos)):
                        self.uses.updateValue((tool, at, i, pos), (use, False))
                else:
                    old = self.results.getValue((use,)) if self.results.containsKey((use,)) else None
                    if old is None or (at, i, pos) < tuple(old[:3]):
                        self.results.updateValue((use,), (at, i, pos, outcome))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(latest // 1000 + self.wait_ms)
        yield self._told(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._told(key[0], True)

    def _told(self, session: str, last: bool) -> pd.DataFrame:
        by_tool: dict = {}
        for k, v in list(self.uses.iterator()):
            by_tool.setdefault(k[0], []).append((tuple(k), v[0], v[1]))
        out = []
        for tool, uses in by_tool.items():
            uses.sort(key=lambda u: u[0][1:])
            raws = [self.results.getValue((u[1],))[3] if self.results.containsKey((u[1],)) else None for u in uses]
            done = [u[2] for u in uses]
            for n, (k, use, told) in enumerate(uses):
                before = raws[n - 1] if n else None
                known = n == 0 or before is not None or done[n - 1] or last
                if told or not known or (raws[n] is None and before != "error" and not last):
                    continue
                done[n] = True
                self.uses.updateValue(k, (use, True))
                outcome = "retry" if before == "error" else raws[n]
                if outcome is not None:
                    out.append((k[2], session, tool, use, outcome, *(("heuristic", "medium") if outcome == "retry" else ("tool_result", "high"))))
            for n in range(len(uses) - 1):  # what comes before a use that is told is asked for no more
                if done[n] and done[n + 1]:
                    self.uses.removeKey(uses[n][0])
                    if self.results.containsKey((uses[n][1],)):
                        self.results.removeKey((uses[n][1],))
        return pd.DataFrame(out, columns=_names(OUTCOMES))

    def close(self) -> None:
        pass


OUTCOMES = "message_id string, session_id string, tool string, use_id string, outcome string, source string, confidence string"


def outcomes_across_batches(messages: DataFrame, late: str = "1 hour", wait_ms: int = 86_400_000) -> DataFrame:
    """A stream of the outcomes of tool uses, from messages with tool_names, tool_use_ids and tool_outcomes: many batches, a session's rows in
    the order of time, give what ``tool_outcomes`` gives for all rows. A use without a result is decided when the watermark, ``late`` behind
    the latest row of all, has passed the session's last row by ``wait_ms``. Needs the RocksDB state store provider."""
    session = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), F.col("id"))
    none = F.lit(None).cast("string")
    named = F.arrays_zip(F.col("tool_names").alias("n"), F.col("tool_use_ids").alias("u"))
    uses = F.when(F.coalesce(F.col("role"), F.lit("assistant")) == "assistant", F.transform(named, lambda x, i: F.struct(i.alias("pos"), x["n"].alias("tool"), x["u"].alias("use_id"), none.alias("outcome"))))
    results = F.transform("tool_outcomes", lambda x, i: F.struct(i.alias("pos"), none.alias("tool"), x["tool_use_id"].alias("use_id"), x["outcome"].alias("outcome")))
    empty = F.array().cast("array<struct<pos:int,tool:string,use_id:string,outcome:string>>")
    rows = messages.withWatermark("timestamp", late).select(
        session.alias("session"), "timestamp", "id", F.unix_micros("timestamp").alias("at"), F.explode(F.concat(F.coalesce(uses, empty), F.coalesce(results, empty))).alias("x")
    ).select("session", "timestamp", "id", "at", "x.*")
    return rows.groupBy("session").transformWithStateInPandas(ToolOutcomes(wait_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
