"""Parsers on literal lines; one batch and many give the same tables."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from tokenledger.operators.rollups import hourly
from tokenledger.sources import transcripts as t
from tokenledger.streaming import ingest as w


def frame(spark, *records, file="f"):
    rows = [(file, k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "file string, line_no long, value string")


def test_lines_leave_an_incomplete_last_one(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"b":2}\n{"c"')
    assert [(r.line_no, r.value) for r in t.lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, '{"a":1}'), (2, '{"b":2}')]


def test_envelopes(spark):
    user = {"type": "user", "uuid": "u", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello there"}}
    odd = [{"type": "summary"}, "not json", "[1]", {"type": "assistant"}, {"type": "user", "uuid": 5, "timestamp": "never"}]
    got = t.envelope(frame(spark, user, *odd)).collect()
    assert [(r.id, r.role, r.text, r.input_tokens, r.provider) for r in got] == [("u", "user", "hello there", 0, "claude_code")]
    assert set(got[0].asDict()) == set(t.STAGING)


def test_chat_documents_models_and_rows(spark):
    ask = {"requestId": "q", "timestamp": 1704067200000, "message": {"text": "hi"}, "modelId": "copilot/auto", "agent": {"id": "ag"}, "result": {"metadata": {"promptTokens": 3, "outputTokens": 4, "resolvedModel": "m-1"}}}
    second = dict(ask, requestId="z", result={"usage": {"promptTokens": 1, "completionTokens": 2}})
    files = spark.createDataFrame([("a", json.dumps({"sessionId": "s", "requests": [ask, second]})), ("b", json.dumps([ask])), ("c", "{")], "file string, value string")
    prices = spark.createDataFrame([("m-1",)], "model string")
    agents = spark.createDataFrame([("ag", "m-2")], "agent_id string, model string")
    docs = t.request_model(prices, agents, t.chat_documents(files))
    rows = t.chat_requests(docs).where("file = 'a'").orderBy("id").collect()
    assert [(r.id, r.role, r.model, r.input_tokens, r.output_tokens, r.parent_uuid, r.text) for r in rows] == [
        ("q", "assistant", "m-1", 3, 4, "q-user", None), ("q-user", "user", None, 0, 0, None, "hi"), ("z", "assistant", "m-2", 1, 2, "z-user", None), ("z-user", "user", None, 0, 0, None, "hi"),
    ]
    shapes = [{"usage": {"prompt_tokens": 1, "completion_tokens": 2}}, {"promptTokens": 5, "completionTokens": 0}, {"completionTokens": 7}, {"promptTokens": 0, "completionTokens": 8}]
    got = t._parsed(frame(spark, *shapes)).select(t.request_tokens().alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [(1, 2), None, (0, 7), (0, 8)]


def test_mutation_log(spark):
    log = [
        {"kind": 0, "v": {"sessionId": "s", "requests": [{"requestId": "a", "timestamp": 1}]}}, {"kind": 2, "k": ["requests"], "v": [{"requestId": "b"}, {"requestId": "c", "modelId": "5"}]},
        {"kind": 1, "k": ["requests", 1, "completionTokens"], "v": 5}, {"kind": 1, "k": ["requests", 1, "completionTokens"], "v": 9}, {"kind": 1, "k": ["requests", 0, "message"], "v": {"text": 'say "x"'}}, {"kind": 1, "k": ["other"], "v": 1},
    ]
    got = {r.idx: (r.session_id, r.i, r.n, r.t) for r in t.folded_requests(frame(spark, *log)).select("idx", "session_id", t.get("$.requestId").alias("i"), t.get("$.completionTokens", "int").alias("n"), t.get("$.message.text").alias("t")).collect()}
    assert got == {0: ("s", "a", None, 'say "x"'), 1: ("s", "b", 9, None), 2: ("s", "c", None, None)}


def test_stores_lines_lists(spark):
    conv, mid = "c" * 36, "m" * 36
    kv = spark.createDataFrame([(f"bubbleId:{conv}:{mid}", json.dumps({"type": 2, "tokenCount": {"inputTokens": 3, "outputTokens": 4}, "modelInfo": {"modelName": "default"}})), ("bubbleId:short", "{}")], "key string, value string")
    heads = spark.createDataFrame([(conv, 1704067200000)], "conversation_id string, created_ms long")
    r = t.conversation_store(kv, heads).first()
    assert (r.id, r.session_id, r.model, r.input_tokens, r.timestamp) == (mid, conv, "auto", 3, datetime(2024, 1, 1))
    assert t.conversation_store(kv, heads, newest_ms=1704067200000).count() == 0
    plain = t.role_lines(frame(spark, {"role": "user", "content": "x", "timestamp": "1704067200000"}, {"role": "system"})).collect()
    assert len(plain) == 1 and len(plain[0].id) == 36
    bills = spark.createDataFrame([(json.dumps({"usageItems": [{"date": "2024-01-01", "model": "m", "netAmount": 0.25}, {"date": "2024-01-02T00:00:00Z", "sku": "k", "creditsUsed": 10, "pricePerCredit": 0.04}, {"model": "x"}]}),)], "value string")
    assert [(r.model, round(r.amount_in_cents, 6)) for r in t.bills(bills).orderBy("date").collect()] == [("m", 25.0), ("k", 40.0)]
    rules = spark.createDataFrame([(json.dumps({"rules": [{"key": "a", "value": "b", "match_repo": "*/x"}, {"key": "", "value": "z"}]}),)], "value string")
    assert [tuple(r) for r in t.tag_rules(rules).collect()] == [("a", "b", "*/x")]


def line(k, session="s", out=1, request=None, at="2024-01-01T00:00:00Z"):
    return json.dumps({"type": "assistant", "uuid": f"u{k}", "sessionId": session, "timestamp": at, "message": {"id": request or f"r{k}", "model": "m", "content": [], "usage": {"input_tokens": k, "output_tokens": out}}})


def ingest(spark, tmp, files):
    os.makedirs(f"{tmp}/in")
    for k, lines in enumerate(files):
        with open(f"{tmp}/in/{k}.jsonl", "w") as f:
            f.write("\n".join(lines) + "\n")
        for _ in range(2):  # the second run finds nothing new
            q = w.ingest(w.transcript_files(spark, f"{tmp}/in"), t.envelope, f"{tmp}/table", f"{tmp}/check", f"{tmp}/stage")
            q.awaitTermination(120)
    return sorted((r.id, r.output_tokens, str(r.timestamp)) for r in spark.read.parquet(f"{tmp}/table").collect())


def test_one_batch_and_many_give_the_same_table(spark, tmp_path):
    lines = [line(k, f"s{k % 3}", at=f"2024-01-0{1 + k % 4}T0{k % 9}:00:00Z") for k in range(20)]
    lines += [line(50, "s1", 7, "r1", "2024-01-02T01:00:00Z"), line(3, "s0", at="2024-01-04T03:00:00Z")]  # a larger output of a known request; a known id
    one, many = ingest(spark, tmp_path / "one", [lines]), ingest(spark, tmp_path / "many", [lines[k : k + 5] for k in range(0, len(lines), 5)])
    assert [r[0] for r in one] and {r[1] for r in many if r[0] == "u1"} == {7}
    assert len(many) == 20 and sum(r[1] for r in one) == sum(r[1] for r in many)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = t.envelope(frame(spark, line(1), line(2)))
    for epoch in (0, 0, 1):
        w.load_batch(rows, f"{tmp_path}/t", f"{tmp_path}/s", epoch)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_live_rollup_equals_batch(spark, tmp_path):
    rows = t.envelope(frame(spark, *[line(k, at=f"2024-01-01T0{k % 5}:30:00Z") for k in range(12)])).withColumn("cost_cents_effective", F.lit(1.5))
    schema = rows.schema
    for k in range(3):
        rows.where(f"line_no % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = w.live_hourly(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {(str(r.bucket_start), r.message_count, r.input_tokens, r.cost_cents) for r in spark.table("live").collect()}
    batch = hourly(rows.withColumn("cost_cents_ingested", F.lit(0.0)))
    assert live == {(str(r.bucket_start), r.message_count, r.input_tokens, float(r.cents_effective)) for r in batch.collect()}


def test_context_is_carried_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # state with a time to live asks for batches without data, for ever
    schema = "id string, session_id string, timestamp timestamp, git_branch string, repo_id string, cwd string"
    batches = [[("a", "s", datetime(2024, 1, 1), "b1", None, "/w")], [("b", "s", datetime(2024, 1, 2), None, "r", ""), ("c", "t", datetime(2024, 1, 2), None, None, None)], [("d", "s", datetime(2024, 1, 3), None, None, None)]]
    got = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = w.carried_across_batches(stream).writeStream.foreachBatch(lambda df, _: got.update({r.id: (r.git_branch, r.repo_id, r.cwd) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got == {"a": ("b1", None, "/w"), "b": ("b1", "r", ""), "c": (None, None, None), "d": ("b1", "r", "/w")}


def test_mutations_at_any_depth(spark):
    def requests(*log):
        return [(r.session_id, json.loads(r.j)) for r in t.folded_requests(frame(spark, *log)).orderBy("idx").select("session_id", F.to_json("v").alias("j")).collect()]

    first = {"requestId": "a", "usage": {"n": 10, "m": [1]}}
    log = [{"kind": 0, "v": {"sessionId": "s", "requests": [first]}}, {"kind": 2, "v": [{"requestId": "b"}]}, {"kind": 2, "k": [], "v": [{"requestId": "c"}]}]
    assert requests(*log) == [("s", first), ("s", {"requestId": "b"}), ("s", {"requestId": "c"})]
    # a count inside an older object; a place that is not there yet; an append inside a request; a second snapshot keeps what it does not name
    more = [
        {"kind": 1, "k": ["requests", 0, "usage", "n"], "v": 99}, {"kind": 1, "k": ["requests", 4, "result", "metadata"], "v": {"promptTokens": 3}}, {"kind": 2, "k": ["requests", 0, "usage", "m"], "v": [2]},
        {"kind": 2, "k": ["requests", 0, "requestId"], "v": ["no list"]}, {"kind": 0, "v": {"sessionId": "later"}}, {"kind": 1, "k": ["requests", -1, "x"], "v": 1}, {"kind": 7, "v": 1}, {"kind": 1, "k": ["requests", 1], "v": {"requestId": "B"}},
    ]
    got = requests(*log, *more)
    assert got == [("later", {"requestId": "a", "usage": {"n": 99, "m": [1, 2]}}), ("later", {"requestId": "B"}), ("later", {"requestId": "c"}), ("later", {"result": {"metadata": {"promptTokens": 3}}})]
    assert requests({"kind": 0, "v": {"requests": [first]}}, {"kind": 0, "v": {"requests": []}}) == []
    assert requests({"kind": 1, "k": ["requests", 1, "completionTokens"], "v": 5}) == [(None, {"completionTokens": 5})]


def test_a_forced_reload_replaces_the_table(spark, tmp_path):
    lines = [line(k, at=f"2024-01-0{1 + k % 3}T00:00:00Z") for k in range(6)]
    first = ingest(spark, tmp_path, [lines])
    spark.createDataFrame([("gone", "2023-12-01")], "id string, d string")
    stray = t.envelope(frame(spark, line(77, at="2023-12-01T00:00:00Z")))
    w.load_batch(stray, f"{tmp_path}/table", f"{tmp_path}/stage", 99)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 7
    w.reload(w.transcript_files(spark, f"{tmp_path}/in"), t.envelope, f"{tmp_path}/table", f"{tmp_path}/check", f"{tmp_path}/stage").awaitTermination(120)
    assert sorted((r.id, r.output_tokens, str(r.timestamp)) for r in spark.read.parquet(f"{tmp_path}/table").collect()) == first


def test_hours_of_touched_days(spark):
    rows = t.envelope(frame(spark, *[line(k, at=f"2024-01-0{1 + k % 3}T00:00:00Z") for k in range(6)])).withColumns({"cost_cents_effective": F.lit(1.0), "cost_cents_ingested": F.lit(1.0)})
    touched = spark.createDataFrame([(datetime(2024, 1, 2).date(),), (datetime(2024, 1, 2).date(),)], "day date")
    assert [(str(r.bucket_start), r.message_count) for r in w.refresh_touched(rows, touched).collect()] == [("2024-01-02 00:00:00", 2)]


def test_lines_of_any_file(spark, tmp_path):
    import gzip

    row = line(1).encode()
    (tmp_path / "crlf.jsonl").write_bytes(row + b"\r\n" + row.replace(b"u1", b"u2") + b"\r\n" + row.replace(b"u1", b"open"))
    (tmp_path / "packed.jsonl.gz").write_bytes(gzip.compress(b"\n".join(row.replace(b"u1", b"z%d" % k) for k in range(50)) + b"\n"))
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "broken.jsonl").write_bytes(b"\xff\xfe{\n" + row.replace(b"u1", b"u3") + b"\n[1]\nnull\n")
    got = t.envelope(t.lines(spark, str(tmp_path)))
    assert {r.id for r in got.collect()} == {"u1", "u2", "u3", *(f"z{k}" for k in range(50))}
    assert [r.line_no for r in got.where("id LIKE 'z%'").orderBy("line_no").collect()] == list(range(50))


def test_contents_of_any_kind(spark):
    said = {"type": "user", "uuid": "a", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z"}
    rows = [
        {**said, "message": {"content": "plain"}}, {**said, "message": {"content": "[1, 2]"}}, {**said, "message": {"content": [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}}, {**said, "content": "flat"}, {**said, "message": 5},
        {**said, "type": "assistant", "message": {"model": "m", "usage": {"input_tokens": "7", "output_tokens": 2.0, "cache_read_input_tokens": None, "cache_creation_input_tokens": -3}}},
    ]
    got = t.envelope(frame(spark, *rows)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["plain", "[1, 2]", "one\ntwo", "flat", None, None]
    assert (got[5].input_tokens, got[5].output_tokens, got[5].cache_read_tokens, got[5].cache_creation_tokens) == (7, 2, 0, 0)


def test_lists_of_anything_and_texts_that_look_like_lists(spark):
    said = {"uuid": "a", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z"}
    use = {"type": "tool_use", "id": " t1 ", "name": "Read", "input": {"file_path": "a.py"}}
    result = lambda **k: {"type": "tool_result", "tool_use_id": "t1", **k}
    answers = [["hi", use], [use, 5, None, [use], {"no": "type"}], [{"type": "text", "text": "x"}, use], "[]", {"type": "tool_use"}, [], [{**use, "input": "none"}, {**use, "id": None, "name": None, "input": None}]]
    got = t.envelope(frame(spark, *[{**said, "type": "assistant", "message": {"model": "m", "content": c}} for c in answers])).orderBy("line_no").collect()
    assert [(r.tool_names, r.tool_use_ids, r.tool_files) for r in got] == [
        (["Read"], ["t1"], ["a.py"]), (["Read"], ["t1"], ["a.py"]), (["Read"], ["t1"], ["a.py"]), ([], [], []), ([], [], []), ([], [], []), (["Read", None], ["t1", None], []),
    ]
    asked = [
        '[{"type": "text", "text": "typed by the user"}]', '{"type": "text"}', ["plain", {"type": "text", "text": "block"}], ["only", "words"], 7, {"a": 1}, '["hi"',
        [result(is_error=True, content="x"), 3, result(tool_use_id=" ", content="x"), result(content=[{"type": "text", "text": "user"}, "rejected", 4, {"text": 5}])], [result(is_error="yes", content={"text": "user rejected"})],
    ]
    got = t.envelope(frame(spark, *[{**said, "type": "user", "message": {"content": c}} for c in asked])).orderBy("line_no").collect()
    assert [r.text for r in got] == [asked[0], asked[1], "block", None, None, None, asked[6], None, None]
    assert [[tuple(o) for o in r.tool_outcomes] for r in got[7:]] == [[("t1", "error"), ("t1", "denied")], [("t1", "success")]]


def test_a_file_of_many_splits_is_many_tasks(spark, tmp_path, monkeypatch):
    import random

    rng, want = random.Random(8), []
    for name in ("a", "b", "c"):
        rows = [rng.choice(["", " ", "x" * rng.randrange(1, 90), "é" * rng.randrange(1, 40), "tail\r"]) for _ in range(400)]
        end = rng.choice(["", "\n"]) if name != "c" else ""
        (tmp_path / f"{name}.jsonl").write_bytes(("\n".join([*rows, "last"]) + end).encode())
        want += [(f"{name}.jsonl", k, v) for k, v in enumerate([*rows, *(["last"] if end else [])]) if v.strip(" ")]
    got = {}
    for size in (500, 3000, 10**7):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for most in (t.SMALL_ROWS, 0):
            monkeypatch.setattr(t, "SMALL_ROWS", most)
            lines = t.lines(spark, str(tmp_path))
            got[size, most] = sorted((os.path.basename(r.file), r.line_no, r.value) for r in lines.collect())
            if most:
                # reading and numbering is narrow: as many tasks as there are splits, and no exchange of lines
                plan = lines._jdf.queryExecution().executedPlan().toString()
                assert "Exchange hashpartitioning" not in plan and (size > 500 or lines.rdd.getNumPartitions() > 40)
        monkeypatch.undo()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(x == sorted(want) for x in got.values())


def streamed(spark, tmp, schema, batches, op):
    """The rows of ``op`` over a stream that gets one batch a run."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
        op(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp}/c").trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return sorted(got, key=str)


def test_categories_and_identities_of_many_batches_equal_those_of_one(spark, tmp_path):
    import random

    from tokenledger.operators import enrich as e

    rng = random.Random(6)
    schema = "id string, session_id string, role string, timestamp timestamp, git_branch string, repo_id string, cwd string, prompt_category string, prompt_category_source string, prompt_category_confidence string, machine string, person string"
    rows = [
        (f"m{k:02d}", f"s{rng.randrange(3)}", rng.choice(["user", "user", "assistant"]), datetime(2024, 1, 1, 0, k), rng.choice([None, None, "", f"b{k}"]), None, rng.choice([None, "/w"]),
         *rng.choice([(None, None, None), (None, "lost", "x"), ("", "", ""), ("bugfix", "rule", "high"), ("ops", None, "low")]), rng.choice([None, "", "m1", "m2"]), rng.choice([None, "p1"]))
        for k in range(40)
    ]
    batches = [rows[at : at + 14] for at in range(0, 40, 14)]
    whole = spark.createDataFrame(rows, schema)
    names = ["id", "session_id", "timestamp", *w.CONTEXT, *e.CATEGORY]
    assert streamed(spark, tmp_path / "a", schema, batches, w.carried_across_batches) == sorted((tuple(x) for x in e.carried_context(whole).select(*names).collect()), key=str)
    keys = {"machine": "machine", "user": "person"}
    assert streamed(spark, tmp_path / "b", schema, batches, lambda rows: w.identities_across_batches(rows, keys)) == sorted((tuple(x) for x in e.identity_tags(whole, keys).collect()), key=str)


def test_tool_outcomes_of_many_batches_equal_those_of_one(spark, tmp_path):
    import random
    from datetime import timedelta

    from tokenledger.operators import enrich as e

    rng, rows, open_, t0 = random.Random(12), [], [], datetime(2024, 1, 1)
    schema = "id string, session_id string, role string, timestamp timestamp, tool_names array<string>, tool_use_ids array<string>, tool_outcomes array<struct<tool_use_id:string,outcome:string>>"
    for k in range(60):
        session, at = f"s{k % 2}", t0 + timedelta(seconds=k)
        if rng.random() < 0.5:
            uses = [f"t{k}-{j}" for j in range(rng.randrange(1, 3))]
            open_ += [(session, u) for u in uses if rng.random() < 0.8]  # others never get a result
            rows.append((f"m{k:02d}", session, rng.choice(["assistant", None]), at, [rng.choice(["Edit", "Bash"]) for _ in uses], uses, None))
        else:
            mine = [x for x in open_ if x[0] == session][: rng.randrange(3)]
            open_ = [x for x in open_ if x not in mine or rng.random() < 0.2]  # some results come twice
            rows.append((f"m{k:02d}", session, "user", at, None, None, [(u, rng.choice(["error", "error", "success", "denied"])) for _, u in mine]))
    far = [(f"z{k}", f"z{k}", "user", t0 + timedelta(days=9 + k), None, None, [("none", "success")]) for k in range(2)]  # moves the watermark on
    batches = [*[rows[at : at + 15] for at in range(0, 60, 15)], far[:1], far[1:]]
    got = streamed(spark, tmp_path, schema, batches, w.outcomes_across_batches)
    want = sorted((tuple(x) for x in e.tool_outcomes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == want and len({x[4] for x in want}) == 4


def random_log(rng, n):
    names, keys = ["requests", "other"], ["x", "y", "list"]

    def path():
        out = [rng.choice(names)]
        for _ in range(rng.randrange(4)):
            out.append(rng.choice([0, 1, 2, 4, *keys]))
        return out

    def value(depth=2):
        kind = rng.randrange(6)
        if kind == 0 and depth:
            return {k: value(depth - 1) for k in rng.sample(keys, 2)}
        if kind == 1 and depth:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return rng.choice([None, 1, "t", {"requestId": "q"}])

    out = []
    for _ in range(n):
        kind = rng.choice([0, 1, 1, 1, 1, 1, 2, 2, 3])
        if kind == 0:
            out.append({"kind": 0, "v": rng.choice([{"requests": [value()]}, {"sessionId": rng.choice("abc")}, {"other": value()}, 5])})
        elif kind == 1:
            out.append({"kind": 1, "k": rng.choice([path(), path(), [], ["sessionId"], ["requests", -1], ["requests", True], None]), "v": value()})
        elif kind == 2:
            out.append({"kind": 2, "k": rng.choice([["requests"], None, path(), []]), "v": rng.choice([[value()], [value(), value()], "no list"])})
        else:
            out.append(rng.choice([{"kind": 9, "v": 1}, {"kind": 1, "k": ["requests", 0]}, {"kind": True, "v": {"requests": []}}]))
    return out


def test_compacted_logs_leave_the_same_state():
    import copy
    import random

    def state(lines, start):
        own = [copy.deepcopy(start)]
        for line in lines:
            if t._is_mutation(line):
                t._mutated(own, copy.deepcopy(line))
        return own[0]

    rng, shorter = random.Random(7), 0
    for k in range(3000):
        log = random_log(rng, rng.randrange(1, 14))
        cut = rng.randrange(len(log) + 1)  # cut anywhere, each part by itself
        short = [x for part in (log[:cut], log[cut:]) for _, x in t._compacted(list(enumerate(part)))]
        start = rng.choice([{}, {"requests": [{"x": [1]}, [2], None], "other": {"y": {}}}, {"requests": 5, "other": []}])
        assert state(short, start) == state(log, start), log
        shorter += len(short) < len(log)
    assert shorter > 300
    many = [{"kind": 1, "k": ["requests", 0, "text"], "v": k} for k in range(1000)] + [{"kind": 2, "k": ["requests", 0, "parts"], "v": [k]} for k in range(1000)]
    assert len(t._compacted(list(enumerate(many)))) == 2


def test_logs_by_stretches_flat_lines_and_sessions_of_paths(spark, monkeypatch):
    import random

    rng = random.Random(2)
    logs = {f"/x/{'chatSessions' if k % 2 else 'logs'}/f{k}.v1.jsonl": random_log(rng, 40) for k in range(4)}
    flat = {"requestId": "flat", "completionTokens": 3}
    logs["/y/ChatSessions/s9.jsonl"] = [flat, {"kind": 1, "k": ["sessionId"], "v": "told"}, [flat, flat, 5], {"requests": [flat]}, {"kind": 2, "v": [{"requestId": "in"}]}, {"v": [flat]}]
    lines = spark.createDataFrame([(f, k, json.dumps(x)) for f, log in logs.items() for k, x in enumerate(log)], "file string, line_no long, value string").repartition(5)
    told = lambda: sorted((r.file, r.idx, r.session_id or "", r.j) for r in t.folded_requests(lines).select("file", "idx", "session_id", F.to_json("v").alias("j")).collect())
    whole = told()
    monkeypatch.setattr(t, "CHUNK_LINES", 3)
    assert told() == whole
    own = [(i, s, json.loads(j)["requestId"]) for f, i, s, j in whole if f.startswith("/y/")]
    assert own == [(0, "told", "in"), (1_000_001, "s9", "flat"), (3_000_001, "told", "flat"), (3_000_002, "told", "flat"), (4_000_001, "told", "flat"), (6_000_001, "told", "flat")]
