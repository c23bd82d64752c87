"""Rollups kept by signed rows, and rewrites of stored costs."""

import os
import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tokenledger.operators import commits as c
from tokenledger.operators import pricing as p
from tokenledger.operators import rollups as r
from tokenledger.streaming import load as ld

ROW = (
    "id string, session_id string, role string, timestamp timestamp, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, repo_id string, provider string, "
    "git_branch string, surface string, request_id string, cost_cents_ingested double, cost_cents_effective double, pricing_source string, cost_confidence string"
)
NOW = datetime(2024, 2, 1)


def rows(spark, rng, ids, days=4):
    def one(k):
        cents = rng.randrange(1, 400) / 8
        return (f"m{k}", f"s{k % 3}", rng.choice(["assistant", "assistant", "user", None]), datetime(2024, 1, 1 + rng.randrange(days), rng.randrange(3)), rng.choice(["m", "x", None, "<s>"]), rng.randrange(99), rng.randrange(9), 1, 2,
                rng.choice(["r", "", None]), rng.choice(["codex", None]), rng.choice(["b", "refs/heads/b"]), "cursor", f"q{rng.randrange(40)}", cents, cents, "manifest:v1", "estimated")

    return spark.createDataFrame([one(k) for k in ids], ROW)


def told(hours):
    return sorted(tuple(map(str, x)) for x in hours.select("bucket_start", *r.DIMS, *r.SUMS).collect())


def test_random_inserts_deletes_and_updates_equal_recomputation(spark):
    rng = random.Random(3)
    table = rows(spark, rng, range(60)).collect()
    hours = r.hourly(spark.createDataFrame(table, ROW))
    for turn in range(3):
        gone = rng.sample(table, 20)
        stay = [x for x in table if x not in gone]
        new = rows(spark, rng, [int(x.id[1:]) for x in gone[:12]]).collect() + rows(spark, rng, range(100 * (turn + 1), 100 * (turn + 1) + 9)).collect()
        changes = r.change_set(spark.createDataFrame(new, ROW), spark.createDataFrame(gone, ROW))
        hours = spark.createDataFrame(r.maintained(hours, changes).collect(), hours.schema)
        table = stay + new
        assert told(hours) == told(r.hourly(spark.createDataFrame(table, ROW)))
    assert r.maintained(hours, r.change_set(None, spark.createDataFrame(table, ROW))).count() == 0
    assert r.change_set(spark.createDataFrame(table, ROW), spark.createDataFrame(table, ROW)).count() == 0


def test_loads_keep_the_rollups(spark, tmp_path):
    path, stage, rng = f"{tmp_path}/t", f"{tmp_path}/s", random.Random(5)
    for epoch in range(3):
        ld.load_batch(rows(spark, rng, range(25 * epoch, 25 * epoch + 30)), path, stage, epoch)
        assert told(ld.stored_hours(spark, path)) == told(r.hourly(spark.read.parquet(path)))


def files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith("parquet")) for d in os.listdir(path) if d.startswith("bucket_day")}


@pytest.fixture
def loaded(spark, tmp_path):
    path = f"{tmp_path}/t"
    ld.load_batch(rows(spark, random.Random(8), range(50)), path, f"{tmp_path}/s", 0)
    return path


def test_a_rewrite_touches_changed_days_alone(spark, tmp_path, loaded):
    before, was = files(loaded), {x.id: x for x in spark.read.parquet(loaded).collect()}
    half = lambda t: t.withColumn("cost_cents_effective", F.when(F.dayofmonth("timestamp") == 2, F.col("cost_cents_ingested") / 2).when(F.dayofmonth("timestamp") == 3, F.col("cost_cents_effective") + 1e-12).otherwise(F.col("cost_cents_effective")))
    did = ld.rewrite(spark, loaded, f"{tmp_path}/r", 1, half, "test", NOW)
    after, now = files(loaded), {x.id: x for x in spark.read.parquet(loaded).collect()}
    assert [d for d in before if before[d] != after[d]] == ["bucket_day=2024-01-02"]
    assert {i for i in was if was[i].cost_cents_effective != now[i].cost_cents_effective} == {i for i in was if was[i].timestamp.day == 2}
    assert did["processed"] == len(was) and did["changed"] == sum(x.timestamp.day == 2 for x in was.values())
    assert float(did["after_cents"]) == sum(x.cost_cents_effective for x in now.values())
    assert told(ld.stored_hours(spark, loaded)) == told(r.hourly(spark.read.parquet(loaded)))
    run = spark.read.schema(ld.RUNS).parquet(f"{loaded}.runs").collect()
    assert [(x.kind, x.at, x.processed, x.changed) for x in run] == [("test", NOW, len(was), did["changed"])]
    assert ld.rewrite(spark, loaded, f"{tmp_path}/r", 1, half, "test", NOW) is None  # a replay
    nothing = ld.rewrite(spark, loaded, f"{tmp_path}/r", 2, half, "test", NOW)
    assert nothing["changed"] == 0 and files(loaded) == after and spark.read.schema(ld.RUNS).parquet(f"{loaded}.runs").count() == 2


def test_a_killed_rewrite_is_finished_by_the_next_load(spark, tmp_path, loaded, monkeypatch):
    rates = spark.createDataFrame([(1, "m", "g", t, 3e6) for t in p.TOKEN_TYPES], "row_no int, model_pattern string, region string, token_type string, sale_usd_per_mtok double")
    seen, ids = [], {x.id for x in spark.read.parquet(loaded).collect()}

    def dies(rows, path, by, spread):
        seen.append(path)
        if len(seen) == 2:
            shutil.rmtree(f"{loaded}/bucket_day=2024-01-02")
            raise KeyboardInterrupt
        return real(rows, path, by, spread)

    real = c.put
    with monkeypatch.context() as m:
        m.setattr(c, "put", dies)
        with pytest.raises(KeyboardInterrupt):
            ld.rewrite(spark, loaded, f"{tmp_path}/r", 1, lambda t: p.repriced(t, rates, "g"), "team", NOW, others=[f"{tmp_path}/s"])
    ld.load_batch(rows(spark, random.Random(9), range(200, 210)), loaded, f"{tmp_path}/s", 1, others=[f"{tmp_path}/r"])
    table = spark.read.parquet(loaded)
    assert {x.id for x in table.collect()} >= ids
    old = {x.id: x for x in table.collect() if int(x.id[1:]) < 200}
    assert all(x.cost_cents_effective == (x.input_tokens + x.output_tokens + 3) * 300 for x in old.values() if x.model == "m" and x.role == "assistant")
    assert told(ld.stored_hours(spark, loaded)) == told(r.hourly(table))


def test_bills_and_backfills_are_rewrites(spark, tmp_path, loaded):
    from datetime import date

    bill = spark.createDataFrame([(date(2024, 1, d), "m", 1000.0) for d in range(1, 5)], "date date, model string, amount_in_cents double")
    did = ld.rewrite(spark, loaded, f"{tmp_path}/r", 1, lambda t: p.reconciled(t, bill), "bill", NOW)
    table = spark.read.parquet(loaded)
    own = table.where("model = 'm'").collect()
    assert own and did["changed"] == len(own) and abs(sum(x.cost_cents_effective for x in own) - 1000 * len({x.bucket_day for x in own})) < 1e-6 and {x.cost_confidence for x in own} == {"exact"}
    prices = spark.createDataFrame([("x", 1e-6, 1e-6, None, None)], "model string, input_cost_per_token double, output_cost_per_token double, cache_creation_input_token_cost double, cache_read_input_token_cost double")
    none = spark.createDataFrame([], "alias string, canonical string")
    unknown = lambda t: t.withColumn("pricing_source", F.when(F.col("model") == "x", "unknown").otherwise(F.col("pricing_source")))
    ld.rewrite(spark, loaded, f"{tmp_path}/r", 2, unknown, "test", NOW)
    did = ld.rewrite(spark, loaded, f"{tmp_path}/r", 3, lambda t: p.backfilled(t, prices, none, 9), "backfill", NOW)
    got = spark.read.parquet(loaded).where("model = 'x'").collect()
    assert did["changed"] == len(got) and {(x.pricing_source, x.cost_confidence) for x in got} == {("backfilled:v9", "estimated")}
    assert told(ld.stored_hours(spark, loaded)) == told(r.hourly(spark.read.parquet(loaded)))
