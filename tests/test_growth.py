"""Steps whose work or memory grew faster than their input: results by brute force, and the shape of the plans."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tokenledger.functions.text import _folded
from tokenledger.operators import enrich as e
from tokenledger.operators import health as h
from tokenledger.operators import sessions as s
from tokenledger.plans import adapters as a
from tokenledger.sources import transcripts as t

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_commits_of_busy_branches_are_counted_without_pairs(spark):
    rng = random.Random(12)
    at = lambda: T0 + timedelta(minutes=rng.randrange(9000), microseconds=rng.randrange(3))
    keys = [("r1", "b1"), ("r1", "b2"), ("r2", "b1"), ("r3", None), (None, "b1")]
    sessions = []
    for i in range(150):
        lo = None if i % 29 == 0 else at()
        sessions.append((f"s{i}", *rng.choice(keys), lo, lo and lo + timedelta(minutes=rng.choice([-3000, 0, 30, 4000]))))
    commits = [(*rng.choice(keys), None if i % 31 == 0 else f"c{rng.randrange(250)}", None if i % 37 == 0 else at(), rng.random() < 0.2) for i in range(300)]
    commits += [(*sessions[1][1:3], "edge", sessions[1][3], False), (*sessions[1][1:3], "edge2", sessions[1][4] + timedelta(hours=24), False)]
    s = spark.createDataFrame(sessions, "id string, repo_id string, git_branch string, started_at timestamp, ended_at timestamp")
    c = spark.createDataFrame(commits, "repo_id string, branch string, sha string, ts timestamp, on_integration boolean")
    b = spark.createDataFrame([("r1", "b1", False, False), ("r1", "b2", True, False)], "repo_id string, branch string, merged boolean, same_tip boolean")
    out = h.work_outcomes(s, c, b)
    inside = lambda x, y: x[1] == y[0] is not None and x[2] == y[1] is not None and x[3] and y[3] and x[3] <= y[3] <= x[4] + timedelta(hours=24)
    want = {x[0]: len({y[2] for y in commits if y[2] and not y[4] and inside(x, y)}) for x in sessions}
    assert {r.session_id: r.commits for r in out.collect()} == want and max(want.values()) > 5
    joins = [x for x in plan(out).splitlines() if "Join" in x and re.search(r"[<>]=", x)]
    assert all("day" in x for x in joins)  # no session meets all commits of its branch


def test_paths_are_folded_as_part_by_part_and_in_one_pass(spark):
    def folded(p):
        out = []
        for x in p.split("/"):
            if x == "..":
                out = out[:-1]
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out)

    rng = random.Random(4)
    paths = ["/".join(rng.choice(["", ".", "..", "...", "a", "b.c", ".d", "e\n", "w", "r", " "]) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    paths += ["/w/r/" + p for p in paths] + ["a//b", "/w/r/", "/w/r/a/\n", "\n", "", "w\\r", "http://x/y", "C:/w"]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, p string")
    got = {r.id: r.v for r in df.select("id", _folded(F.col("p")).alias("v")).collect()}
    assert got == {k: folded(p) for k, p in enumerate(paths)}
    rows = spark.createDataFrame([("m", "assistant", "/w/r", ["x.py", "/w/r/y.py", "../z", "x.py"]), ("n", "assistant", "/w", None), ("o", None, "/w", [f"f{i}" for i in range(20)])], "id string, role string, cwd string, tool_files array<string>")
    tags = e.file_tags(rows)
    out = sorted((r.message_id, r.key, r.value) for r in tags.collect() if r.message_id == "m" or r.key != "file_path")
    assert out == [("m", "file_path", "x.py"), ("m", "file_path", "y.py"), ("m", "file_path_confidence", "high"), ("m", "file_path_source", "tool_arg"), ("o", "file_path_confidence", "medium"), ("o", "file_path_source", "cwd_relative")]
    assert tags.where("message_id = 'o' AND key = 'file_path'").count() == 16
    told = plan(e.file_tags(rows))
    assert told.count("Scan ") == 1 and told.count("Exchange ") == 1


def test_lines_and_documents_are_parsed_once(spark):
    lines = spark.createDataFrame([("f", 1, '{"type":"user","uuid":"u","timestamp":"2024-01-01T00:00:00Z","message":{"content":"hi"}}')], "file string, line_no long, value string")
    assert [r.text for r in t.envelope(lines).collect()] == ["hi"]
    assert plan(t.envelope(lines)).count("from_json") == 1
    docs = ['[{"requestId":"a","timestamp":5,"promptTokens":1,"completionTokens":2,"message":{"text":"x"}}, null, 7, "{\\"requestId\\":\\"b\\"}", "no"]', '{"sessionId":"s","requests":[{"requestId":"c"}]}', '{"requests":{}}', "3", "none"]
    made = t.chat_documents(spark.createDataFrame([(f"f{k}", d) for k, d in enumerate(docs)], "file string, value string"))
    got = sorted((r.file, r.idx, r.session_id, r.id) for r in made.select("file", "idx", "session_id", t.get("$.requestId").alias("id")).collect())
    assert [g[:2] for g in got] == [("f0", k) for k in range(5)] + [("f1", 0)]
    assert [g[3] for g in got] == ["a", None, None, "b", None, "c"] and got[5][2] == "s"
    nulls = {r.idx for r in made.where("v IS NULL").collect()}
    assert nulls == {1, 4}
    asked = t.chat_requests(made)
    assert sorted((r.id, r.text, r.output_tokens) for r in asked.collect()) == [("a", None, 2), ("a-user", "x", 0)]
    told = plan(t.chat_requests(made))
    assert len(re.findall(r"parse_?json", told, re.I)) == 2, told  # of a document, and of a text in it


def test_tasks_of_health_and_tags_hold_few_rows_and_few_sorts(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows, events, tags = a.messages(spark, d), a.tool_events(spark, d), a.tags(spark, d)
    whole = sorted(map(str, h.session_health(rows, events).collect())), sorted(map(str, s.session_tags(rows, tags).collect()))
    monkeypatch.setattr(h, "PART_ROWS", 100)
    monkeypatch.setattr(s, "PART_ROWS", 100)
    health, own = h.session_health(rows, events), s.session_tags(rows, tags)
    assert plan(health).count("REPARTITION_BY_COL") == 5  # sessions, and each vital in a stage of its own
    assert len(re.findall(r"hashpartitioning\(session_id#\d+, 10\), REPARTITION_BY_NUM", plan(health))) > 4
    assert len(re.findall(r", \d+\), REPARTITION_BY_NUM", plan(own))) == 2
    assert (sorted(map(str, health.collect())), sorted(map(str, own.collect()))) == whole
