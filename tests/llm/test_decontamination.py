import hashlib
import random
import re

from helpers import ODD, frame, sentence
from pyspark.sql import functions as F

from tokenledger.llm.decontamination import benchmark_hits, decontaminated, hits_digest

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text, items):
    w = [m for m in WORD.findall((text or "").translate(LOWER))]
    hit, ids = set(), set()
    for item_id, t in items:
        b = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if b else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(item_id)
    return len(w), len(hit), sorted(ids)


def test_hits_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([3, 9, 10, 11, 25]), 60)) for i in range(30)] + [(40, "É, Ünter—den"), (41, None), (42, ""), (43, "?!"), (5, sentence(rng, 12, 60))]
    texts = [sentence(rng, 80, 60) + " " + rng.choice(items)[1].__str__().upper() + ". " + sentence(rng, 5, 60) for _ in range(40)]
    texts += ODD + ["x É... ÜNTER—DEN y", "é ünter—den"]
    docs = frame(spark, list(enumerate(texts))).withColumnRenamed("lang", "spans")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (24 << 20, 300):  # one block, and many
        got = {r.doc_id: r for r in benchmark_hits(docs, bench, block_bytes=block).collect()}
        digest = {r.doc_id: r for r in hits_digest(benchmark_hits(docs, bench, block_bytes=block, with_spans=False)).collect()}
        for i, t in enumerate(texts):
            n, hit, ids = brute(t, items)
            r, d = got[i], digest[i]
            assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (n, hit, ids, hit > 0), t
            assert d.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest() and d.n_items == len(ids)
            words = sum(len(WORD.findall(t[s.start : s.end].translate(LOWER))) for s in r.spans) if r.spans else 0
            assert (words == hit) if block > 300 else True


def test_stage_keeps_rows_and_columns(spark):
    docs = frame(spark, [(1, "one two three four five six seven eight nine ten eleven"), (2, "clean"), (3, None), (2, "clean")]).withColumnRenamed("lang", "n_hit")
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    out = decontaminated(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 2, 3]
    assert decontaminated(docs, bench.where("false")).count() == 4
    assert decontaminated(docs.where("false"), bench).count() == 0
    assert out.where(F.col("n_hit") == "en").count() == 3


def test_items_of_text_ids_in_scans_of_their_own(spark):
    docs = frame(spark, [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (2, "q r s"), (3, None)]).withColumnRenamed("source", "hit_words").withColumnRenamed("lang", "item_ids")
    bench = spark.createDataFrame([("x-2", "b c d e f g h i j k"), ("x-10", "q r s"), ("none", None), (None, "a b c d e f g h i j")], "item_id string, text string")
    for block in (24 << 20, 100):
        out = benchmark_hits(docs, bench, block_bytes=block)
        assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in out.collect()) == [(1, 11, 11, ("x-2",)), (1, 11, 11, ("x-2",)), (2, 3, 3, ("x-10",)), (3, 0, 0, ())]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0  # the scans are written before
    very_long = "x " * 300_000 + "b c d e f g h i j k"
    assert [(r.n_words, r.n_hit) for r in benchmark_hits(frame(spark, [(1, very_long)]), bench).collect()] == [(300_010, 10)]
