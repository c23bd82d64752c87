"""Quality and language-model scores: held-out accuracy, and base scores by brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import ODD, frame, sentence

from tokenledger.llm import lm_scoring as lm
from tokenledger.llm import quality as qu
from tokenledger.llm.lm_scoring import lm_scores
from tokenledger.llm.quality import fit_quality, good_quality, held_out, quality_scores
from tokenledger.llm.shared import written
from tokenledger.llm.tokens import units, vocabulary_path

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = sentence(rng, rng.randrange(20, 120), 300)
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "*** "), " | ".join(t.split()), " ".join([t.split()[0]] * 60)])
        rows.append((i, t))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(random.Random(1), 900)
    docs = frame(spark, [*rows, *[(5000 + k, t) for k, t in enumerate(ODD)], (None, "text of no one")]).withColumnRenamed("lang", "score")
    marks = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (3, labels[3][1], 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, marks)
    got = {r.doc_id: r for r in quality_scores(docs.drop("score"), model).withColumn("held", held_out()).collect()}
    assert all(r.held == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    apart = [(got[i].predicted, y) for i, y, _ in labels if got[i].held]
    assert len(apart) > 100 and sum(p == y for p, y in apart) / len(apart) > 0.97
    out = good_quality(docs, marks)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, r in got.items() if r.predicted}
    assert good_quality(docs.where("false"), marks).count() == 0


def test_no_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit_quality(docs, none) is None
    assert [(r.score, r.predicted) for r in quality_scores(docs, None).collect()] == [(0.5, 1)] * 2


def base(rows):
    words = {k: (t or "").encode().translate(LOWER).split() + [None] for k, (_, t) in enumerate(rows)}
    train = {k for k, (i, _) in enumerate(rows) if zlib.crc32(b"" if i is None else str(i).encode()) % 10}
    c = Counter(w for k in train for w in words[k])
    n, v = sum(c.values()), len(c)
    den = math.log10(n + 0.1 * (v + 1))
    return [
        (i, k not in train, len(words[k]), sum(c[w] > 0 for w in words[k]), n, round(sum(math.log10(c[w] + 0.1) for w in words[k]) - len(words[k]) * den, 6))
        for k, (i, _) in enumerate(rows)
    ]


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(1, 200), 500)) for i in range(200)] + [(900 + k, t) for k, t in enumerate(ODD)] + [(None, "Nobody's w1"), (5, "again w1")]
    docs = frame(spark, rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "n")
    out = lm_scores(docs).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got, key=str) == sorted(base(rows), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_rare_words_meet_their_counts_by_a_join(spark, monkeypatch):
    from tokenledger.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "FREQUENT", 40)
    rng = random.Random(3)
    rows = [(i, sentence(rng, 60, 300) + " the the the") for i in range(120)]
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scores(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(base(rows))


def counted(texts, size, mark):
    """Counts as the one scan gathers them: ids beside hashed neighbours, pairs and their counts."""
    near, pairs = np.zeros((size, 2 * lm.BESIDE)), Counter()
    place = lambda i: (i * 40503 >> 4) % lm.BESIDE
    for t in texts:
        for x, y in zip([mark, *t], [*t, mark]):
            near[y, place(x)] += 1
            near[x, lm.BESIDE + place(y)] += 1
            pairs[x << 16 | y] += 1
    keys = np.array(sorted(pairs), np.int64)
    return near, keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def naive_log10(model, counts, text, mark):
    """Log10 probability of one text by plain loops: full attention inside each window, the pair model by its definition."""
    near, keys, n = counts
    of = dict(zip(keys.tolist(), n.tolist()))
    size = len(near)
    seen = near[:, : lm.BESIDE].sum(axis=1)
    one = (seen + 0.1) / (seen.sum() + 0.1 * size)
    kinds, total = Counter(k >> 16 for k in of), Counter()
    for k, v in of.items():
        total[k >> 16] += v
    p, e = {k: v.astype(np.float64) for k, v in model.p.items()}, model.e.astype(np.float64)
    inputs, out = [mark, *text], 0.0
    for i, y in enumerate([*text, mark]):
        begin = max(0, i // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        x = inputs[i]
        weights = [math.exp(e[x] @ p["q"] @ (e[inputs[j]] @ p["k"]) / lm.DIM**0.5 + p["near"][i - j]) for j in range(begin, i + 1)]
        h = sum(w * (e[inputs[j]] @ p["v"]) for w, j in zip(weights, range(begin, i + 1))) / sum(weights)
        pair = np.array([(of.get(x << 16 | z, 0) + (kinds[x] + 1) * one[z]) / (total[x] + kinds[x] + 1) for z in range(size)])
        by_class = np.bincount(model.cls, weights=pair, minlength=lm.CLASSES)
        logits = np.log(np.maximum(by_class, 1e-30)) + h @ p["w"]
        out += logits[model.cls[y]] - np.log(np.exp(logits).sum()) + math.log(pair[y]) - math.log(by_class[model.cls[y]])
    return out / math.log(10)


def test_scores_equal_full_attention_window_by_window():
    rng = np.random.default_rng(1)
    size, mark = 301, 300
    texts = [np.repeat(rng.integers(0, 150, n), 2) * 2 + np.tile([0, 1], n) for n in (0, 1, 3, 11, 12, 13, 23, 24, 25, 36, 40, 60, 5, 7, 9, 30, 31, 32, 33, 50)]  # even ids, each followed by its odd one
    counts = counted(texts[2:], size, mark)
    model = lm.Model(*counts)
    learner = lm.Learner(model)
    for _ in range(30):
        learner.add(*lm.chunks(texts, mark)[:3])
    before = lm.Scorer(model).log10(*lm.chunks(texts, mark)[:3]).sum()
    flat = learner.done()
    assert flat[-1] == 30 * len(lm.chunks(texts, mark)[1])
    model.p = learner.p
    w, g, f, per = lm.chunks(texts, mark)
    got = np.add.reduceat(lm.Scorer(model).log10(w, g, f), np.cumsum(per) - per)
    assert got.sum() > before
    want = [naive_log10(model, counts, t.tolist(), mark) for t in texts]
    assert np.allclose(got, want, rtol=2e-4, atol=2e-4)
    # probabilities of all next ids sum to one
    w, g, f, _ = lm.chunks([np.array([5, 7, 11])], mark)
    total, s = 0.0, lm.Scorer(model)
    for i in range(size):
        goal = np.full_like(g, -1)
        goal[0, 2] = i
        total += 10 ** s.log10(w, goal, f)[0]
    assert abs(total - 1) < 1e-4


def test_pairs_are_found_whatever_collides():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 32, 50_000))
    table = lm.Pairs(keys, np.arange(1, len(keys) + 1))
    assert (table.get(keys) == np.arange(1, len(keys) + 1)).all()
    other = np.setdiff1d(rng.integers(0, 1 << 32, 50_000), keys)
    assert (table.get(other) == 0).all() and not len(lm.Pairs(keys[:0], keys[:0]).get(keys[:0]))


def test_a_very_long_text(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 30, 200)) for i in range(30)] + [(100, sentence(rng, 150_000, 5000)), (101, "中" * 50_000), (100, "again")]
    out = lm_scores(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == sorted((*x[:5], round(x[5], 4)) for x in base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_empty_corpus(spark):
    assert lm_scores(frame(spark, [])).count() == 0
    one = lm_scores(frame(spark, [(1, None)])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in one] == [(1, 1, 1)]


def test_training_takes_every_window_once_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 6000)
    rng = random.Random(4)
    docs = frame(spark, [(i, sentence(rng, rng.randrange(1, 150))) for i in range(120)])
    size = units(vocabulary_path(lm.VOCABULARY)).tok.get_vocab_size()
    tables = [written(lm.gathered(docs.repartition(n), "doc_id", "text", lm.VOCABULARY), "gathered") for n in (1, 5)]
    one, other = (lm.fit(t, size) for t in tables)
    assert all((one.p[k] == other.p[k]).all() for k in one.p) and (one.prior == other.prior).all()
    train = [r for r in tables[0].where("kind = 0 AND train").collect()]
    texts = [np.frombuffer(r.ids, np.uint16) for r in train]
    counts = counted([t.tolist() for t in texts], size, size - 1)
    want, shards = lm.Model(*counts), -(-sum(map(len, texts)) // 6000)
    assert shards > 2 and (want.prior == one.prior).all()
    dealt = tables[0].where("kind = 0 AND train").selectExpr("ids", f"pmod(xxhash64(doc_id, ids), {shards}L) AS shard", "xxhash64(1, doc_id, ids) AS at").collect()
    total = 0
    for k in range(shards):
        learner = lm.Learner(want)
        learner.add(*lm.chunks([np.frombuffer(r.ids, np.uint16) for r in sorted((r for r in dealt if r.shard == k), key=lambda r: r.at)], size - 1)[:3])
        total = total + learner.done()
    assert total[-1] == sum(-(-(len(t) + 1) // lm.STRIDE) for t in texts)
    flat = np.concatenate([one.p[k].ravel() for k in sorted(one.p)])
    assert np.allclose(flat, total[:-1] / total[-1], atol=1e-5)
    a, b = ({r.doc_id: r.score for r in lm.lm_scores(docs.repartition(n)).collect()} for n in (1, 5))
    assert a == b


def test_quality_by_plain_loops(spark, monkeypatch):
    """Word vectors, features and the network's answer recomputed without numpy's tricks."""
    rows, labels = corpus(random.Random(9), 60)
    docs = frame(spark, rows + [(900, None), (901, "One one two"), (902, "x " * 70_000)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    vectors, network = qu.fit_quality(docs, marks)
    index, words = qu.index_vectors().astype(np.float64), qu.Words()
    own = np.zeros((qu.CORES + qu.SHAPES, qu.DIM))
    for r in docs.collect():
        cores, shapes, _ = words.ids(r.text)
        for at in range(0, len(cores), qu.SLICE):
            c, s = cores[at : at + qu.SLICE].tolist(), shapes[at : at + qu.SLICE].tolist()
            both = [index[i] + index[j] for i, j in zip(c, s)]
            for i in range(len(c)):
                near = sum((both[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(c)), np.zeros(qu.DIM))
                own[c[i]] += near
                own[s[i]] += near
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-6)
    assert np.allclose(own, vectors, atol=1e-4)
    w, b, u, c = network.p
    for r in qu.quality_scores(docs, (vectors, network)).collect():
        cores, shapes, pooled = words.ids(r.text)
        mean = [sum((own[i] for i in ids.tolist()), np.zeros(qu.DIM)) / max(1, len(ids)) for ids in (cores, shapes)]
        x = (np.concatenate([*mean, pooled]) - network.mean) / network.scale
        logit = sum(math.tanh(sum(x[i] * w[i][j] for i in range(len(x))) + b[j]) * u[j] for j in range(qu.HIDDEN)) + c[0]
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, logit / network.temperature))))) < 2e-3
