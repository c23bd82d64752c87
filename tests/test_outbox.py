"""Export runs that fail between chunks, before the watermark, and after it."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import exports as x
from tokenledger.operators import outbox as o
from tokenledger.operators import rollups as r
from tokenledger.plans import adapters as a

DATA = "/root/testdata/sf0.001"


class Down(Exception):
    pass


class Receiver:
    """Takes chunks by key; goes down at the calls named."""

    def __init__(self, *down):
        self.got, self.calls, self.down = {}, 0, set(down)

    def __call__(self, rows, key):
        self.calls += 1
        if self.calls in self.down:
            raise Down
        assert key not in self.got
        self.got[key] = [tuple(q) for q in rows.collect()]

    def rows(self):
        return sorted((q for k in self.got.values() for q in k), key=str)


@pytest.fixture(scope="module")
def days(spark):
    rows = r.daily(r.hourly(a.messages(spark, DATA))).where("bucket_day < '2024-01-07'")
    return spark.createDataFrame(rows.collect(), rows.schema)


def test_a_failure_between_chunks_sends_nothing_twice(spark, tmp_path, days):
    box, mark, today = f"{tmp_path}/box", f"{tmp_path}/mark", date(2030, 1, 1)
    to = Receiver(2, 4)
    for _ in range(2):
        with pytest.raises(Down):
            o.export_days(days, today, box, mark, to, least=1)
        assert x.read_watermark(spark, mark) is None  # not before all are sent
    # the tables have gone on meanwhile; the run sends what it has sealed
    o.export_days(days.limit(0), today, box, mark, to, least=1)
    want = sorted((tuple(q) for q in x.daily_export(days, None, today).collect()), key=str)
    assert to.rows() == want and len(to.got) > 3 and all(k.startswith("1-") for k in to.got)
    assert x.read_watermark(spark, mark) == date(2024, 1, 6)
    assert o.export_days(days, today, box, mark, to) == 0 and to.rows() == want
    more = days.where("bucket_day = '2024-01-06'").withColumn("bucket_day", F.lit(date(2024, 1, 9)))
    assert o.export_days(days.unionByName(more), today, box, mark, to) == 1
    assert [q[0] for q in to.got["2-0"]] == [date(2024, 1, 9)] * more.count() and x.read_watermark(spark, mark) == date(2024, 1, 9)


def test_deaths_around_the_watermark(spark, tmp_path, days, monkeypatch):
    box, mark, today = f"{tmp_path}/box", f"{tmp_path}/mark", date(2030, 1, 1)
    to = Receiver()
    for where in ((o, "write_watermark"), (o.Outbox, "done")):
        with monkeypatch.context() as m:
            m.setattr(*where, lambda *k: (_ for _ in ()).throw(Down))
            with pytest.raises(Down):
                o.export_days(days, today, box, mark, to)
    o.export_days(days, today, box, mark, to)
    assert to.rows() == sorted((tuple(q) for q in x.daily_export(days, None, today).collect()), key=str)
    assert o.Outbox(spark, box).mark() == "2024-01-06"


def test_sessions_by_chunks(spark, tmp_path):
    messages = a.messages(spark, DATA)
    sessions = r.sessions(messages)
    to = Receiver(3)
    with pytest.raises(Down):
        o.export_sessions(messages, sessions, f"{tmp_path}/box", to, most=100)
    o.export_sessions(messages, sessions, f"{tmp_path}/box", to, most=100)
    assert len(to.rows()) == sessions.count() and {q[0] for q in to.rows()} == {q.id for q in sessions.collect()}
    last = max(q.ended_at for q in sessions.collect())
    # the next run begins where this one has ended; open ones go again
    n = o.export_sessions(messages, sessions, f"{tmp_path}/box", to, open_since=last - timedelta(hours=1))
    assert n == 1 and all(q[3] >= last - timedelta(hours=1) for q in to.got["2-0"]) and isinstance(last, datetime)
