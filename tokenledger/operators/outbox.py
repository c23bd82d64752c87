"""Export runs that go on where they have failed.

A run's rows are first written to an outbox by chunk, and sealed. Chunks are then sent one after the other, each noted once it is sent; the
watermark advances when all are. A run that finds one that is not done sends the chunks it lacks, of the rows that were sealed, whatever the
tables hold by now. Only a death between a chunk's sending and its note sends it again, under the same key."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .commits import found
from .exports import CHUNK, chunked_days, chunked_sessions, daily_export, read_watermark, session_export, write_watermark

_LOG = "run bigint, phase string, chunk int, mark string, schema string"
SEALED, SENT, DONE = "sealed", "sent", "done"
#: Takes a chunk's rows and a key that no other chunk has.
Send = Callable[[DataFrame, str], None]


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        log = found(self.spark, f"{self.path}/log", _LOG)
        return self.spark.createDataFrame([], _LOG) if log is None else log

    def _note(self, *row) -> None:
        self.spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def last(self) -> tuple[int, dict[str, list]]:
        """The number of the last run and its notes by phase; 0 before the first."""
        log = self._log()
        run = log.agg(F.max("run")).first()[0] or 0
        notes: dict[str, list] = {}
        for r in log.where(F.col("run") == run).collect():  # a row a chunk
            notes.setdefault(r["phase"], []).append(r)
        return run, notes

    def mark(self) -> str | None:
        """How far the last run that is done has come."""
        return self._log().where(F.col("phase") == DONE).agg(F.max_by("mark", "run")).first()[0]

    def seal(self, rows: DataFrame, mark: str) -> None:
        """A new run of ``rows`` (with chunk_id); what a dead one has left unsealed in its place is replaced."""
        run, notes = self.last()
        if notes and DONE not in notes:
            raise ValueError(f"run {run} is not done")
        rows.repartition("chunk_id").write.mode("overwrite").partitionBy("chunk_id").parquet(f"{self.path}/run={run + 1}")
        self._note(run + 1, SEALED, None, mark, StructType([f for f in rows.schema if f.name != "chunk_id"]).json())

    def deliver(self, send: Send) -> tuple[int, str | None]:
        """Sends what the open run lacks: how many chunks those were, and the run's mark (None without an open run)."""
        import json

        run, notes = self.last()
        if not notes or DONE in notes:
            return 0, None
        told = notes[SEALED][0]
        schema = StructType([*StructType.fromJson(json.loads(told["schema"])), StructField("chunk_id", IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/run={run}")
        sent = {r["chunk"] for r in notes.get(SENT, [])}
        chunks = sorted({r[0] for r in rows.select("chunk_id").distinct().collect()} - sent)  # a row a chunk
        for c in chunks:
            send(rows.where(F.col("chunk_id") == c).drop("chunk_id"), f"{run}-{c}")
            self._note(run, SENT, c, None, None)
        return len(chunks), told["mark"]

    def done(self, mark: str) -> None:
        self._note(self.last()[0], DONE, None, mark, None)


def export_days(days: DataFrame, today: date, outbox: str, watermark: str, send: Send, least: int = CHUNK) -> int:
    """Sends the daily rollups behind the watermark, and today's, by chunks of whole days; the number of chunks sent. The watermark advances
    to the last day sent."""
    spark = days.sparkSession
    box = Outbox(spark, outbox)
    _, notes = box.last()
    if not notes or DONE in notes:
        rows = daily_export(days, read_watermark(spark, watermark), today)
        newest = rows.agg(F.max("bucket_day")).first()[0]
        if newest is None:
            return 0
        box.seal(chunked_days(rows, least), newest.isoformat())
    n, mark = box.deliver(send)
    write_watermark(spark, watermark, date.fromisoformat(mark))
    box.done(mark)
    return n


def export_sessions(messages: DataFrame, sessions: DataFrame, outbox: str, send: Send, most: int = CHUNK, open_since: datetime | None = None) -> int:
    """Sends the summaries of sessions that have changed since the last run, or are open; the number of chunks sent. The run's mark is the
    latest end of a session sent, at which the next one begins."""
    spark = sessions.sparkSession
    box = Outbox(spark, outbox)
    _, notes = box.last()
    if not notes or DONE in notes:
        since = box.mark()
        rows = session_export(messages, sessions, datetime.fromisoformat(since) if since else None, open_since)
        newest = rows.agg(F.max("ended_at").cast("timestamp_ntz")).first()[0]
        if newest is None:
            return 0
        box.seal(chunked_sessions(rows, most), max(newest.isoformat(), since or ""))
    n, mark = box.deliver(send)
    box.done(mark)
    return n
