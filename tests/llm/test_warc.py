import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tokenledger.llm import warc
from tokenledger.llm.warc import archived, read_records, write_archives

PAGES = "page_id long, url string, html string, digest string"


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}\r\n", f"<p>{rng.randrange(40)} é 😀\r\n\r\nWARC/1.1\r\n</p>" * (i % 5), "d") for i in range(200)]
    return rows + [(500, None, None, None), (501, "", "", None), (502, "u", "x" * 200_000, None), (None, "n", "only", None), (7, rows[7][1], rows[7][2], "d")]


def test_round_trip(spark):
    rows = pages(spark)
    for least in (0, 60):
        got = archived(spark.createDataFrame(rows, PAGES), min_bytes=least).collect()
        assert len(got) == len(rows)
        best = {}
        for i, _, h, _ in rows:
            best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
        want = []
        for i, _, h, _ in rows:
            data = (h or "").encode()
            other = len(data) >= least and (-1 if i is None else i) != best[h or ""]
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", best[h or ""] if other else None))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_payloads_come_back_and_ranges_are_coalesced(spark):
    rows = pages(spark)
    index = write_archives(spark.createDataFrame(rows, PAGES))
    some = index.where(F.col("page_id").cast("long") % 3 == 0)
    by_id = {i: h for i, _, h, _ in rows}
    for gap, most in ((0, 1 << 10), (1 << 20, 1 << 30)):
        back = read_records(some, gap, most).collect()
        assert len(back) == some.count()
        assert all(r.payload == (by_id[int(r.page_id)] or "") for r in back if r.record_type == "response")


def test_damage_is_seen_and_fails_the_job(spark, monkeypatch):
    raw, digest = warc.record("7", "http://x", b"payload of seven", None)
    good, bad = warc.parse(raw), warc.parse(raw.replace(b"of seven", b"of eight"))
    assert (good["intact"], good["payload_digest"], good["payload_bytes"]) == (True, digest, 16) and not bad["intact"] and bad["payload_digest"] != digest
    damaged = warc.write_archives(spark.createDataFrame([(1, "u", "x", None)], PAGES))
    monkeypatch.setattr(warc, "read_records", lambda index, own=warc.read_records: own(index).withColumn("intact", F.lit(False)))
    with pytest.raises(Exception, match="damaged record of page 1"):
        archived(spark.createDataFrame([(1, "u", "x", None)], PAGES)).collect()
    assert damaged.count() == 1


def test_reading_is_dealt_by_bytes_of_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 1 << 10)
    index = write_archives(spark.createDataFrame(pages(spark), PAGES))
    back = read_records(index, 0, 1 << 10)
    assert back.rdd.getNumPartitions() >= index.agg(F.sum("length")).first()[0] // (1 << 10) > 4


def test_hot_payload_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    rows = [(i, "u", "hot" if i % 3 else f"p{i}", None) for i in range(300)]
    got = archived(spark.createDataFrame(rows, PAGES)).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 101, "revisit": 199}
    assert archived(spark.createDataFrame([], PAGES)).count() == 0


def test_ids_of_any_characters(spark):
    ids = ["a\r\nb", "None", None, "", "<urn:page:x>", "é 😀%20", "a: b", "\x00\x85", "plain"]
    rows = [(i, f"u{k}", f"payload {k // 2}", "d") for k, i in enumerate(ids)]
    got = archived(spark.createDataFrame(rows, PAGES.replace("page_id long", "page_id string"))).collect()
    assert sorted((r.page_id for r in got), key=str) == sorted(ids, key=str)
    best = {}
    for i, _, h, _ in rows:
        best[h] = max(best.get(h, (False, "")), (i is not None, i or ""))
    for i, _, h, _ in rows:
        r = next(x for x in got if x.page_id == i)
        assert r.refers_to == (None if best[h] == (i is not None, i or "") else best[h][1])
