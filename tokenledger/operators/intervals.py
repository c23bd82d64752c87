"""Points in intervals by a sweep: each point meets one window, and no pairs are made.

Time is cut at quantiles of the points, so that a range holds about ``POINTS`` of them; a range with more (points of one moment cannot be
cut) is dealt to several parts by the points' ids. A part gets its points and the windows that reach into its range, sorted by time, and goes
through them once: windows open and are kept in a heap, latest start first, until they end. What a part holds at a time is the windows that
are open then."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workers import importable

#: Points that a part of the sweep gets, about.
POINTS = 100_000
#: Ranges of time at most.
RANGES = 10_000


def swept(events: Iterator[tuple], skew: int) -> Iterator[tuple[str, str]]:
    """(point, session) of events (part, at, point, start, end, session) sorted by part, time, windows before points, start and session; a
    window stands ``skew`` before its start. The window that holds the point, latest start first; else the nearest edge within ``skew``."""
    own = None
    for part, at, point, start, end, session in events:
        if part != own:
            own, upcoming, open_, ended = part, deque(), [], None
        if start == start:  # a window: NaN stands for the start of a point
            upcoming.append((start, session, end))
            continue
        while upcoming and upcoming[0][0] <= at:
            s, name, e = upcoming.popleft()
            heapq.heappush(open_, (-s, name, e))
        while open_ and open_[0][2] < at:
            s, name, e = heapq.heappop(open_)
            if ended is None or (-e, s, name) < ended:
                ended = (-e, s, name)
        if open_:
            yield point, open_[0][1]
            continue
        # the edge of what ended last, and of what starts next; of equal ones the later start
        gap = at + ended[0] if ended is not None else skew + 1
        if upcoming and upcoming[0][0] - at <= min(gap, skew):
            yield point, upcoming[0][1]
        elif gap <= skew:
            yield point, ended[2]


def _ranges(points: DataFrame, per: int) -> tuple[list[float], list[int]]:
    """Cuts of time and, for each range between them, into how many parts it is dealt: RANGES numbers at most."""
    n = points.count()
    k = min(RANGES, -(-n // per))
    if k <= 1:
        return [], [1]
    told = points.agg(F.percentile_approx("at_ms", [i / k for i in range(1, k)], 10 * RANGES)).first()[0]
    cuts = sorted({float(x) for x in told})
    held = {r[0]: r[1] for r in points.groupBy(_range_of(cuts)(F.col("at_ms"))).count().collect()}
    return cuts, [max(1, -(-held.get(i, 0) // per)) for i in range(len(cuts) + 1)]


def _range_of(cuts: list[float]):
    bounds = np.array(cuts)

    @F.pandas_udf("int")
    def place(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(dtype="float64"), side="right").astype("int32"))

    return place


def in_interval(points: DataFrame, windows: DataFrame, skew_ms: int = 5000, open_ms: int = 30 * 86_400_000, per: int = POINTS) -> DataFrame:
    """(id, session_id) of points (id, at_ms): the window that holds the point, nearest start first, else the nearest edge within ``skew_ms``;
    of equal ones the later start, then the smaller session.

    A window without an end is open for ``open_ms``; others end where they end, or where they start if that is later. Points without a time
    and windows without a start meet nothing."""
    importable(points.sparkSession)
    points = points.where("at_ms IS NOT NULL").select("id", F.col("at_ms").cast("double").alias("at_ms"))
    cuts, parts = _ranges(points, per)
    range_of = _range_of(cuts)
    end = F.greatest(F.coalesce("end_ms", F.col("start_ms") + open_ms), F.col("start_ms")).cast("double")
    w = windows.where("start_ms IS NOT NULL AND session_id IS NOT NULL").select("session_id", F.col("start_ms").cast("double").alias("start"), end.alias("end"))
    # parts are numbered through all ranges
    bases = np.concatenate([[0], np.cumsum(parts)]).tolist()
    first = lambda r: F.element_at(F.array(*[F.lit(int(b)) for b in bases]), r + 1)
    p = points.withColumn("r", range_of(F.col("at_ms")))
    own = first(F.col("r")) + F.pmod(F.xxhash64("id"), (first(F.col("r") + 1) - first(F.col("r"))).cast("bigint")).cast("int")
    none = F.lit(None).cast("double")
    p = p.select(own.alias("part"), F.col("at_ms").alias("at"), F.col("id").cast("string").alias("point"), none.alias("start"), none.alias("end"), F.lit(None).cast("string").alias("session"))
    reach = F.explode(F.sequence(first(F.col("lo")), first(F.col("hi") + 1) - 1))
    w = w.withColumns({"lo": range_of(F.col("start") - skew_ms), "hi": range_of(F.col("end") + skew_ms)})
    w = w.select(reach.alias("part"), (F.col("start") - skew_ms).alias("at"), F.lit(None).cast("string").alias("point"), "start", "end", F.col("session_id").cast("string").alias("session"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str]] = []
        for met in swept((row for batch in batches for row in batch.itertuples(index=False, name=None)), skew_ms):
            out.append(met)
            if len(out) >= 50_000:
                yield pd.DataFrame(out, columns=["id", "session_id"])
                out = []
        yield pd.DataFrame(out, columns=["id", "session_id"])

    kind: Column = F.col("id").cast(_type(points, "id"))
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, bases[-1])
    dealt = p.unionByName(w).repartition(min(tasks, RANGES), "part").sortWithinPartitions("part", "at", F.col("start").isNull(), "start", "session")
    return dealt.mapInPandas(sweep, "id string, session_id string").select(kind.alias("id"), "session_id")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
