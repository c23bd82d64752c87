"""Tailing of growing files: appends, partial lines, shrinking, the cap, restarts."""

import json
import os

from tokenledger.sources import transcripts as t
from tokenledger.streaming import ingest as w
from tokenledger.streaming import tail as tl


def reader(path, **kw):
    return tl.TailReader(str(path), ".jsonl", kw.get("cap", tl.CAP), kw.get("progress"))


def values(r, start, end):
    out = []
    for p in sorted(r.partitions(start, end), key=lambda p: p.file):
        for b in r.read(p):
            out += [(os.path.basename(f), n, v) for f, n, v in zip(*(c.to_pylist() for c in b.columns))]
    return out


def test_appends_partial_lines_and_shrinking(tmp_path):
    a, r = tmp_path / "a.jsonl", reader(tmp_path)
    a.write_bytes(b"one\n\n two \npart")
    (tmp_path / "b.txt").write_bytes(b"no\n")
    first = r.latestOffset()
    assert values(r, {}, first) == [("a.jsonl", 0, "one"), ("a.jsonl", 5, " two ")]
    assert r.latestOffset() == first and values(r, first, first) == []  # the partial line waits
    with open(a, "ab") as f:
        f.write("ial é\nx".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jsonl").write_bytes(b"\xff{\n")
    second = r.latestOffset()
    assert values(r, first, second) == [("a.jsonl", 11, "partial é"), ("c.jsonl", 0, "�{")]
    a.write_bytes(b"new\n")  # shorter than what was taken: from the beginning
    third = r.latestOffset()
    assert values(r, second, third) == [("a.jsonl", 0, "new")]
    a.write_bytes(b"n")  # shorter again, and no whole line
    fourth = r.latestOffset()
    assert values(r, third, fourth) == []
    with open(a, "ab") as f:
        f.write(b"ow\n")
    assert values(r, fourth, r.latestOffset()) == [("a.jsonl", 0, "now")]
    os.remove(a)
    assert values(r, r.done, r.latestOffset()) == []
    assert reader(tmp_path / "nowhere").latestOffset() == {}


def test_the_cap_and_a_restart(tmp_path, monkeypatch):
    monkeypatch.setattr(tl, "LOOK", 3)
    a, note = tmp_path / "a.jsonl", str(tmp_path / "note")
    a.write_bytes(b"".join(b"line%d\n" % k for k in range(10)))
    r, at, seen = reader(tmp_path, cap=13, progress=note), {}, []
    for _ in range(3):
        to = r.latestOffset()
        seen += values(r, at, to)
        at = to
    assert [v for _, _, v in seen] == ["line0", "line1", "line2", "line3", "line4", "line5"][: len(seen)] and len(seen) == 6
    r.commit(at)
    later = reader(tmp_path, cap=13, progress=note)  # knows what was noted
    to = later.latestOffset()
    assert [v for _, _, v in values(later, at, to)] == ["line6", "line7"]
    # a note that lags behind the checkpoint takes nothing twice
    behind = reader(tmp_path, cap=13, progress=note)
    again = behind.latestOffset()
    assert again == to and values(behind, to, again) == []
    assert [v for _, _, v in values(behind, to, behind.latestOffset())] == ["line8", "line9"]
    assert len(values(reader(tmp_path, cap=13), {}, reader(tmp_path, cap=13).latestOffset())) == 10  # nothing known: all at once
    a.write_bytes(b"longer than the cap, without an end")
    assert values(later, to, later.latestOffset()) == []


def call(k):
    return json.dumps({"type": "assistant", "uuid": f"u{k}", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": f"r{k}", "model": "m", "content": [], "usage": {"input_tokens": k, "output_tokens": 1}}})


def test_a_stream_of_growing_files_into_the_tables(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")

    def run():
        lines = tl.growing_files(spark, f"{tmp_path}/in", progress=f"{tmp_path}/note")
        w.ingest(lines, t.envelope, f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/s").awaitTermination(120)
        return sorted(x.id for x in spark.read.parquet(f"{tmp_path}/t").collect())

    with open(f"{tmp_path}/in/a.jsonl", "w") as f:
        f.write(call(1) + "\n" + call(2) + "\n" + call(3)[:20])
    assert run() == ["u1", "u2"]
    with open(f"{tmp_path}/in/a.jsonl", "a") as f:
        f.write(call(3)[20:] + "\n")
    with open(f"{tmp_path}/in/b.jsonl", "w") as f:
        f.write(call(4) + "\n")
    assert run() == ["u1", "u2", "u3", "u4"]
    assert run() == ["u1", "u2", "u3", "u4"]
    with open(f"{tmp_path}/in/a.jsonl", "w") as f:  # a new file in the place of a longer one
        f.write(call(5) + "\n")
    assert run() == ["u1", "u2", "u3", "u4", "u5"]
