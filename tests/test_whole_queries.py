"""Queries that take every row: beside their SQL twins, by brute force over the smallest tables."""

import os
from datetime import datetime, timedelta

from tokenledger.operators import merge as m
from tokenledger.operators import rollups as r
from tokenledger.plans import adapters as a
from tokenledger.registry import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _ms(t):
    return int((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))


def test_sessions_by_time_meet_all_sessions(spark):
    windows = [(w.id, _ms(w.started_at), _ms(w.ended_at)) for w in r.sessions(a.messages(spark, DATA)).collect()]
    want = {}
    for p in a.raw_messages(spark, DATA).where("session_id IS NULL").collect():
        t, near = _ms(p.timestamp), []
        for s, lo, hi in windows:
            if lo <= t <= hi:
                near.append((0, t - lo, -lo, s))
            elif lo - 5000 <= t <= hi + 5000:
                near.append((1, min(abs(t - lo), abs(t - hi)), -lo, s))
        if near:
            want[p.id] = min(near)[3]
    got = {x.id: x.session_id for x in QUERIES["j03_sessions_by_time"](spark, DATA).collect()}
    assert got == want and any(not s.startswith("s1") for s in got.values())


def test_merge_takes_every_row_and_the_largest_of_several(spark):
    rows = {x.id: x for x in a.messages(spark, DATA).where("role = 'assistant'").collect()}
    number = lambda i: int(i[1:])
    stored = {(x.request_id, x.session_id): i for i, x in rows.items() if number(i) % 3 == 0 and x.session_id}
    anyone = {x.request_id: i for i, x in rows.items() if number(i) % 3 == 0}  # for rows without a session
    want, batch = {i: i for i in rows if number(i) % 3 == 0}, {}
    for i, x in rows.items():
        if number(i) % 3:
            old = stored.get((x.request_id, x.session_id)) if x.session_id else anyone.get(x.request_id)
            batch.setdefault(old, []).append(i) if old else want.setdefault(i, i)
    for old, many in batch.items():
        want[old] = min([old, *many], key=lambda i: (-rows[i].output_tokens, i != old, i))
    got = {x.id: (x.output_tokens, x.cost_cents_effective) for x in QUERIES["d02_merged"](spark, DATA).collect()}
    assert got == {i: (rows[j].output_tokens, rows[j].cost_cents_effective) for i, j in want.items()}


def test_equal_outputs_merge_by_the_smaller_id(spark):
    schema = "id string, request_id string, session_id string, output_tokens long, cost_cents_effective double"
    stored = spark.createDataFrame([("a", "r", "s", 1, 1.0)], schema)
    for rows in ([("b", "r", "s", 5, 2.0), ("c", "r", "s", 5, 3.0)], [("c", "r", "s", 5, 3.0), ("b", "r", "s", 5, 2.0)]):
        assert [tuple(x) for x in m.merged(stored, spark.createDataFrame(rows, schema).coalesce(1))[0].collect()] == [("a", "r", "s", 5, 2.0)]
