import random

import numpy as np
import pytest
from helpers import ODD, frame, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenledger.llm import near_dedup as nd
from tokenledger.llm.near_dedup import components, near_duplicates, one_of_each

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size):
    w = (text or "").encode().translate(nd.LOWER).split()
    if not w:
        return set()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(spark, size):
    rng = random.Random(size)
    base = [sentence(rng, rng.randrange(20, 200)) for _ in range(12)]
    texts = [edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.02, 0.04, 0.08])) for _ in range(220)] + ODD + ["A b", "a B", "solo", "SOLO"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = frame(spark, rows).withColumnRenamed("lang", "cls").withColumnRenamed("source", "sig")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, size=size).collect()}
    assert got == brute(rows, size)


def test_a_large_group_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 16)
    rng = random.Random(9)
    text = sentence(rng, 120)
    rows = [(i, edited(rng, text, 0.012)) for i in range(300)] + [(1000 + i, text) for i in range(200)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), size=2).collect()}
    assert got == brute(rows, 2)


def test_odd_rows(spark):
    docs = frame(spark, [(None, "a b c"), (5, "a b c"), (2**60 + 1, "a b c"), (5, "a b c"), (7, None), (8, "")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, size=2).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (2**60 + 1, 2, 5, False), (7, 0, 7, True), (8, 0, 8, True)], key=str)
    out = one_of_each(docs)
    assert out.columns == docs.columns and out.count() == 5
    assert near_duplicates(docs.where("false")).count() == 0


def test_rows_of_one_id_with_other_texts_are_documents_of_their_own(spark):
    twin, other = "one two three four five six seven", "a text that nobody else has at all"
    docs = frame(spark, [(3, twin), (7, other), (7, twin), (8, "w " * 20), (8, None)])
    assert sorted((r.doc_id, r.text) for r in one_of_each(docs).where("text IS NOT NULL").collect()) == [(3, twin), (7, other), (8, "w " * 20)]
    assert one_of_each(docs).count() == 4


def test_ids_of_text(spark):
    docs = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]).withColumn("doc_id", F.concat(F.lit("d-"), "doc_id"))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()) == [("d-1", "d-1", True), ("d-2", "d-1", False), ("d-3", "d-3", True)]
    assert one_of_each(docs).count() == 2


def test_many_different_near_copies_write_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_CLASSES", 128)
    rows_written = {}

    def counted(df, name, own=nd.written):
        out = own(df, name)
        rows_written[name] = max(rows_written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(nd, "written", counted)
    rng = random.Random(12)
    text = sentence(rng, 300).split()
    rows = [(i, " ".join([*text[: i % 300], f"e{i}", *text[i % 300 + 1 :]])) for i in range(1500)]
    got = near_duplicates(frame(spark, rows), size=2).collect()
    assert {r.component_id for r in got} == {0}
    # a job passes on each of its classes once, and fewer links than classes; all pairs would be 1.1 million
    assert rows_written["links"] <= rows_written["likely"] <= 1500 * nd.BANDS * 2


def test_a_very_long_text_and_an_empty_table(spark):
    rng = random.Random(3)
    long = sentence(rng, 200_000, 50_000)
    out = near_duplicates(frame(spark, [(1, long), (2, long + " end"), (3, "short one")]))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    assert one_of_each(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_estimates_follow_similarity(a, b):
    a, b = (np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 1) for x in (a, b))
    m = nd.minima([np.unique(a), np.unique(b)])
    sig = nd.packed(m)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(nd.estimate(sig[0], sig[1]) - true) < 0.25


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(51)) and all(got.get(100 + i, 100) == 100 for i in range(30))
