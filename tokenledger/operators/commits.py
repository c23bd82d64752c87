"""Writes of several tables that either happen as a whole or not at all, whatever dies in between.

A commit has a number that rises. Its new partitions are first written to a staging folder, which a row in a log then seals; only then do
they replace partitions of the tables. Staged partitions are whole, so putting them in place can be repeated: a run that finds a sealed
commit puts it in place again before it reads any table, and never reads a table that a dead run has left half replaced. A commit that
was not sealed has changed nothing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEALED, APPLIED = "sealed", "applied"
_LOG = "epoch long, phase string, writes string"


@dataclass(frozen=True)
class Write:
    """Partitions of the table at ``path`` that ``rows`` replace: those that ``rows`` have, by the columns ``by``; ``spread`` deals a large one out."""

    name: str
    rows: DataFrame
    path: str
    by: tuple[str, ...]
    spread: str


def found(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def put(rows: DataFrame, path: str, by: tuple[str, ...], spread: str) -> None:
    """Replace the partitions that ``rows`` have. Ranges of partition and hashed key: a large partition is several tasks' work."""
    rows.repartitionByRange(*by, F.xxhash64(spread)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class Commits:
    """The commits of one staging folder; a stream has one to its checkpoint."""

    def __init__(self, spark: SparkSession, staging: str):
        self.spark, self.staging = spark, staging

    def name(self, epoch: int) -> str:
        """A partition value that no other commit has."""
        return f"{hashlib.sha256(self.staging.encode()).hexdigest()[:12]}-{epoch}"

    def _log(self) -> dict[int, dict[str, str]]:
        """One row for each phase of a commit; only the last commit can be open."""
        log = found(self.spark, f"{self.staging}/log", _LOG)
        if log is None:
            return {}
        last = log.agg(F.max("epoch")).first()[0]
        out: dict[int, dict[str, str]] = {}
        for r in log.where(F.col("epoch") == last).collect():
            out.setdefault(r["epoch"], {})[r["phase"]] = r["writes"]
        return out

    def _note(self, epoch: int, phase: str, writes: str = "[]") -> None:
        self.spark.createDataFrame([(epoch, phase, writes)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.staging}/log")

    def last(self) -> int | None:
        """The number of the last commit, after what was left of it is done; None before the first."""
        done = None
        for epoch, phases in self._log().items():
            if APPLIED not in phases:
                self._apply(epoch, json.loads(phases[SEALED]))
            done = epoch
        return done

    def _staged(self, epoch: int, name: str) -> str:
        return f"{self.staging}/epoch={epoch}/{name}"

    def _apply(self, epoch: int, writes: list[dict]) -> None:
        for w in writes:
            rows = self.spark.read.schema(StructType.fromJson(w["schema"])).parquet(self._staged(epoch, w["name"]))
            put(rows, w["path"], tuple(w["by"]), w["spread"])
        self._note(epoch, APPLIED)

    def commit(self, epoch: int, writes: list[Write]) -> None:
        """Stage, seal, put in place. ``last`` has to be called before the rows are made."""
        told = []
        for w in writes:
            w.rows.write.mode("overwrite").parquet(self._staged(epoch, w.name))
            told.append({"name": w.name, "path": w.path, "by": w.by, "spread": w.spread, "schema": w.rows.schema.jsonValue()})
        self._note(epoch, SEALED, json.dumps(told))
        self._apply(epoch, json.loads(json.dumps(told)))
