import math
import random

import numpy as np

from tokenledger.llm import neighbours as n
from tokenledger.llm.neighbours import nearest

VECTORS = "vec_id long, embedding array<float>, part int"


def brute(rows, ask, count=5):
    good = {}
    for i, v, _ in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[(i, tuple(v))] = np.array(v, np.float32).astype(float)
    out = set()
    for (i, v), q in good.items():
        if ask(i):
            near = sorted((-float((q * c).sum() / math.sqrt((q * q).sum()) / math.sqrt((c * c).sum())), j) for (j, w), c in good.items() if j != i)
            out |= {(i, k + 1, j) for k, (_, j) in enumerate(near[:count])}
    return out


def data(seed, size, clusters):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(clusters)]
    return [(i, [x + rng.gauss(0, 0.25) for x in centres[rng.randrange(clusters)]], 0) for i in range(size)]


def test_exact_with_one_part_and_odd_rows(spark):
    rows = data(1, 150, 5)
    rows += [(1000 + i, rows[10][1], 1) for i in range(40)] + [(10, rows[10][1], 0)]  # ties, a repeated row
    rows += [(2000, None, 0), (2050, [0.0] * 8, 0), (2100, [float("nan")] + [1.0] * 7, 0), (2150, [None] + [1.0] * 7, 0), (2200, [1.0] * 3, 0), (None, [1.0] * 8, 0), (2250, [float("inf")] * 8, 0), (2300, [], 0)]
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 10 == 0).collect()}
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_few_and_no_rows(spark):
    rows = data(2, 3, 1)
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 2 == 0).collect()}
    assert got == brute(rows, lambda i: i % 2 == 0) and len(got) == 4
    assert nearest(spark.createDataFrame([], VECTORS), lambda i: i % 2 == 0).count() == 0
    assert nearest(spark.createDataFrame(rows[:1], VECTORS), lambda i: i % 2 == 0).count() == 0


def test_recall_over_many_parts_with_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(n, "PART_ROWS", 100)
    monkeypatch.setattr(n, "BLOCK_ROWS", 64)
    monkeypatch.setattr(n, "BLOCK_QUERIES", 8)
    rows = data(3, 1200, 24) + [(5000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 0) for i in range(600)]
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 50 == 0).collect()}
    want = brute(rows, lambda i: i % 50 == 0)
    hit = len({(a, c) for a, _, c in got} & {(a, c) for a, _, c in want}) / len(want)
    assert hit >= 0.9, hit


def test_recall_of_rows_that_no_fit_has_seen(spark, monkeypatch):
    monkeypatch.setattr(n, "PART_ROWS", 150)
    monkeypatch.setattr(n, "FIT_ROWS", 600)
    asked = []
    monkeypatch.setattr(n, "fit", lambda sample, rows, own=n.fit: asked.append(own(sample, rows)) or asked[-1])
    rows = data(5, 3000, 40)
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0).collect()}
    want = brute(rows, lambda i: i % 20 == 0)
    hit = len({(a, c) for a, _, c in got} & {(a, c) for a, _, c in want}) / len(want)
    _, parts, probes = asked[0]
    assert parts == 20 and probes <= parts // 2 and hit >= 0.95, (parts, probes, hit)


def test_parts_below_parts(spark, monkeypatch):
    for name, value in (("PART_ROWS", 60), ("MOST_PARTS", 6), ("FIT_ROWS", 600), ("BELOW_ROWS", 400), ("BLOCK_ROWS", 50)):
        monkeypatch.setattr(n, name, value)
    trees = []
    monkeypatch.setattr(n, "fit_below", lambda rows, top, total, own=n.fit_below: trees.append(own(rows, top, total)) or trees[-1])
    rows = data(6, 1500, 30) + [(5000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 0) for i in range(700)]
    got = {(r.query_id, r.rank, r.vec_id) for r in nearest(spark.createDataFrame(rows, VECTORS), lambda i: i % 20 == 0).collect()}
    want = brute(rows, lambda i: i % 20 == 0)
    hit = len({(a, c) for a, _, c in got} & {(a, c) for a, _, c in want}) / len(want)
    assert hit >= 0.9 and len(trees[0].below) >= 3, (hit, trees[0].below.keys())
    x = n.unit(np.array([v for _, v, _ in rows]))
    assert len(np.unique(trees[0].place(x))) > 6 and all(p in a for p, a in zip(trees[0].place(x)[:200], trees[0].asked(x[:200])))


def test_parts_are_balanced():
    x = n.unit(np.random.default_rng(0).normal(size=(600, 8)))
    own = n.balanced_parts(x, n.graph(x, 10), 6)
    assert np.bincount(own, minlength=6).max() <= math.ceil(n.SLACK * 100)
