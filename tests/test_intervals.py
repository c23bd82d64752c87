"""The sweep against a loop over all pairs."""

import random

import pytest

from tokenledger.operators import intervals as v


def by_hand(points, windows, skew, open_ms):
    out = {}
    for i, at in points:
        best = None
        for s, a, z in windows:
            if at is None or a is None or s is None:
                continue
            z = max(a + open_ms if z is None else z, a)
            inside = a <= at <= z
            edge = min(abs(at - a), abs(at - z))
            if inside or edge <= skew:
                rank = (not inside, at - a if inside else edge, -a, s)
                best = min(best, (rank, s)) if best else (rank, s)
        if best:
            out[i] = best[1]
    return out


def frames(spark, points, windows, parts=3):
    return spark.createDataFrame(points, "id string, at_ms long").repartition(parts), spark.createDataFrame(windows, "session_id string, start_ms long, end_ms long").repartition(parts)


@pytest.mark.parametrize("per", [7, 50, 10**6])
def test_equals_all_pairs(spark, per):
    rng = random.Random(per)
    points = [(f"p{k}", rng.choice([rng.randrange(3000), rng.randrange(100) * 30, 1500])) for k in range(400)] + [("none", None), ("far", -(10**9)), ("late", 10**12)]
    windows = [(f"s{k:03d}", a, rng.choice([a + rng.randrange(5), a + rng.randrange(40), a + rng.randrange(900), a - 3, None])) for k, a in enumerate(rng.choice([rng.randrange(3000), rng.randrange(60) * 50]) for _ in range(80))]
    windows += [("twin", *windows[0][1:]), ("nostart", None, 5), (None, 5, 900)]
    got = {r.id: r.session_id for r in v.in_interval(*frames(spark, points, windows), skew_ms=20, open_ms=200, per=per).collect()}
    assert got == by_hand(points, windows, 20, 200)


def test_a_hot_hour_is_many_tasks(spark):
    """A third of all points stand at one moment, and all windows in one hour."""
    rng = random.Random(1)
    points = [(f"h{k}", 1_000_000) for k in range(5000)] + [(f"p{k}", 1_000_000 + rng.randrange(3_600_000)) for k in range(10_000)]
    windows = [(f"s{k:05d}", 1_000_000 + rng.randrange(3_600_000), None) for k in range(300)]
    windows = [(s, a, a + rng.randrange(60_000)) for s, a, _ in windows]
    cuts, parts = v._ranges(frames(spark, points, windows)[0].selectExpr("id", "CAST(at_ms AS DOUBLE) AS at_ms"), 500)
    assert len(cuts) > 15 and max(parts) >= 10 and sum(parts) >= 30
    got = {r.id: r.session_id for r in v.in_interval(*frames(spark, points, windows), per=500).collect()}
    some = [p for p in points if hash(p) % 10 == 0]
    want = by_hand(some, windows, 5000, 1)
    assert {i: got.get(i) for i, _ in some} == {i: want.get(i) for i, _ in some}


def test_empty_tables(spark):
    points, windows = frames(spark, [("a", 1)], [("s", 0, 5)])
    assert v.in_interval(points, windows.limit(0)).count() == 0 and v.in_interval(points.limit(0), windows).count() == 0
