"""Loads of several tables: deaths at any step, requests of any age, tags and sessions of many batches and of one."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import commits as c
from tokenledger.operators import enrich as e
from tokenledger.operators import rollups as r
from tokenledger.sources import transcripts as t
from tokenledger.streaming import ingest as w
from tokenledger.streaming import load as ld


def parsed(spark, *records):
    rows = [("f", k, json.dumps(x)) for k, x in enumerate(records)]
    return t.envelope(spark.createDataFrame(rows, "file string, line_no long, value string"))


def call(k, session="s", out=1, request=None, at="2024-01-01T00:00:00Z", tool="Read", branch=None):
    content = [{"type": "tool_use", "id": f"t{k}", "name": tool, "input": {}}]
    usage = {"input_tokens": 3, "output_tokens": out}
    line = {"type": "assistant", "uuid": f"u{k}", "timestamp": at, "gitBranch": branch, "message": {"id": request or f"r{k}", "model": "m", "content": content, "usage": usage}}
    return line if session is None else {**line, "sessionId": session}


def stored(spark, path):
    return sorted((x.id, x.session_id, x.output_tokens, str(x.bucket_day)) for x in spark.read.parquet(path).collect())


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", [0, 1, 5])  # before the seal, at the messages, before the last note
def test_a_death_at_any_step_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, step):
    """The second batch's run dies: before or after the sealing, or when a partition's old folder is gone and the new one not yet there."""
    path, stage = f"{tmp_path}/t", f"{tmp_path}/s"
    first, second = parsed(spark, call(1), call(2, "z")), parsed(spark, call(3), call(4, out=9, request="r1"))
    ld.load_batch(first, path, stage, 0, e.tool_tags)
    seen = [0]

    def at(name, real):
        def run(*args, **kw):
            seen[0] += 1
            if seen[0] == step + 1:
                if name == "put" and os.path.exists(f"{path}/bucket_day=2024-01-01"):
                    shutil.rmtree(f"{path}/bucket_day=2024-01-01")
                raise Killed
            return real(*args, **kw)

        return run

    with monkeypatch.context() as m:
        m.setattr(c, "put", at("put", c.put))
        m.setattr(c.Commits, "_note", at("note", c.Commits._note))
        try:
            ld.load_batch(second, path, stage, 1, e.tool_tags)
        except Killed:
            pass
    ld.load_batch(second, path, stage, 1, e.tool_tags)
    ld.load_batch(second, path, stage, 1, e.tool_tags)
    assert stored(spark, path) == [("u1", "s", 9, "2024-01-01"), ("u2", "z", 1, "2024-01-01"), ("u3", "s", 1, "2024-01-01")]
    tags = sorted(tuple(x) for x in ld.stored_tags(spark, path).collect())
    assert tags == sorted([(f"u{k}", "tool", "Read") for k in (1, 2, 3)] + [(f"u{k}", "tool_use_id", f"t{k}") for k in (1, 2, 3)] + [("u1", "tool_use_id", "t4")])
    assert {x.id: x.surface for x in ld.stored_sessions(spark, path).collect()} == {"s": "unknown", "z": "unknown"}


def test_a_later_batch_finishes_what_a_dead_run_has_sealed(spark, tmp_path, monkeypatch):
    path, stage = f"{tmp_path}/t", f"{tmp_path}/s"
    ld.load_batch(parsed(spark, call(1), call(2)), path, stage, 0)
    with monkeypatch.context() as m:
        m.setattr(c, "put", lambda *a, **k: (shutil.rmtree(f"{path}/bucket_day=2024-01-01"), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            ld.load_batch(parsed(spark, call(3)), path, stage, 1)
    assert not os.path.exists(f"{path}/bucket_day=2024-01-01")
    ld.load_batch(parsed(spark, call(4)), path, stage, 2)
    assert [x[0] for x in stored(spark, path)] == ["u1", "u2", "u3", "u4"]


def test_a_request_is_met_at_any_age(spark, tmp_path):
    path, stage = f"{tmp_path}/t", f"{tmp_path}/s"
    days = ["2024-01-01", "2024-01-04", "2024-03-31"]
    ld.load_batch(parsed(spark, call(1, out=5, request="q", at=f"{days[0]}T00:00:00Z"), call(2, at="2024-02-01T00:00:00Z"), call(7, at=f"{days[2]}T05:00:00Z")), path, stage, 0)
    other = os.listdir(f"{path}/bucket_day=2024-02-01")
    ld.load_batch(parsed(spark, call(3, out=50, request="q", at=f"{days[1]}T00:00:00Z")), path, stage, 1)
    ld.load_batch(parsed(spark, call(4, out=7, request="q", at=f"{days[2]}T00:00:00Z"), call(1, at=f"{days[2]}T00:00:00Z")), path, stage, 2)
    ld.load_batch(parsed(spark, call(5, None, out=60, request="q", at=f"{days[2]}T00:00:00Z"), call(6, "other", request="x", at=f"{days[2]}T00:00:00Z")), path, stage, 3)
    assert stored(spark, path) == [("u1", "s", 60, "2024-01-01"), ("u2", "s", 1, "2024-02-01"), ("u6", "other", 1, "2024-03-31"), ("u7", "s", 1, "2024-03-31")]
    assert os.listdir(f"{path}/bucket_day=2024-02-01") == other  # a day that nothing meets is neither read nor written


def test_only_met_days_are_read(spark, tmp_path):
    path, stage = f"{tmp_path}/t", f"{tmp_path}/s"
    ld.load_batch(parsed(spark, *[call(k, at=f"2024-01-{1 + k:02d}T00:00:00Z") for k in range(9)]), path, stage, 0)
    batch = parsed(spark, call(20, request="r3", at="2024-02-01T00:00:00Z"))
    days = ld.met_days(batch, c.found(spark, f"{path}.keys", ld.KEYS))
    assert [str(d) for d in days] == ["2024-01-04"]
    plan = spark.read.parquet(path).where(ld.in_days(days))
    assert [f.split("bucket_day=")[1][:10] for f in plan.inputFiles()] != [] and {str(x.bucket_day) for x in plan.collect()} == {"2024-01-04"}


@pytest.mark.parametrize("size", [15])
def test_many_batches_equal_one_run_over_the_table(spark, tmp_path, size):
    rng = random.Random(size)
    calls = [call(k, f"s{rng.randrange(6)}", rng.randrange(1, 9), f"r{rng.randrange(30)}", f"2024-01-{rng.randrange(1, 6):02d}T{rng.randrange(24):02d}:00:00Z", rng.choice(["Read", "Edit"]), rng.choice([None, "", "b1", "b2"])) for k in range(40)]
    path, stage = f"{tmp_path}/t", f"{tmp_path}/s"
    for epoch, at in enumerate(range(0, 40, size)):
        batch = parsed(spark, *calls[at : at + size]).withColumn("surface", F.element_at(F.array(*map(F.lit, ("vscode", "cursor", "unknown"))), (F.pmod(F.xxhash64("id"), F.lit(3)) + 1).cast("int")))
        ld.load_batch(batch, path, stage, epoch, e.tool_tags)
    table = spark.read.parquet(path)
    names = ["id", "provider", "started_at", "ended_at", "repo_id", "git_branch", "surface", "duration_ms"]
    rows = lambda df, names: sorted(tuple(map(str, x)) for x in df.select(*names).collect())
    assert rows(ld.stored_sessions(spark, path), names) == rows(r.sessions(table), names)
    # each tag of each batch row that its batch kept stands once, on the row that has the request
    owner = {(x.request_id, x.session_id): x.id for x in table.collect()}
    want = set()
    for at in range(0, 40, size):
        kept = {}
        for k, x in enumerate(calls[at : at + size]):
            q = x["message"]["id"]
            if q not in kept or (-x["message"]["usage"]["output_tokens"], x["uuid"]) < kept[q][0]:
                kept[q] = ((-x["message"]["usage"]["output_tokens"], x["uuid"]), x)
        for _, x in kept.values():
            to = owner[x["message"]["id"], x["sessionId"]]
            use = x["message"]["content"][0]
            want |= {(to, "tool", use["name"]), (to, "tool_use_id", use["id"])}
    got = [tuple(x) for x in ld.stored_tags(spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # keep-largest over all batches
    best = {}
    for x in (x for at in range(0, 40, size) for x in calls[at : at + size]):
        k = (x["message"]["id"], x["sessionId"])
        best[k] = max(best.get(k, 0), x["message"]["usage"]["output_tokens"])
    assert all(best[x.request_id, x.session_id] >= x.output_tokens for x in table.collect())


def test_a_stream_with_tags_and_a_reload(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for k in range(3):
        with open(f"{tmp_path}/in/{k}.jsonl", "w") as f:
            f.write("\n".join(json.dumps(call(10 * k + j, f"s{j}", at=f"2024-01-0{1 + k}T00:00:00Z")) for j in range(4)) + "\n")
        w.ingest(w.transcript_files(spark, f"{tmp_path}/in"), t.envelope, f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/s", tags=e.tool_tags).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 12 and ld.stored_tags(spark, f"{tmp_path}/t").count() == 24 and ld.stored_sessions(spark, f"{tmp_path}/t").count() == 4
    before = stored(spark, f"{tmp_path}/t")
    w.reload(w.transcript_files(spark, f"{tmp_path}/in"), t.envelope, f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/s", tags=e.tool_tags).awaitTermination(120)
    assert stored(spark, f"{tmp_path}/t") == before and ld.stored_tags(spark, f"{tmp_path}/t").count() == 24
