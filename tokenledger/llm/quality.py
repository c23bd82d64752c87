"""Operator 8: quality classifier on random-indexing word vectors.

A word has two tokens: its lower-cased core and its shape (case, digits, closing signs, whether it
repeats the word before), each hashed to a fixed number of ids. Every id has a fixed sparse random
index vector; a token's word vector is the normalised sum of the index vectors of its neighbours
over all texts. A document is the mean of its cores' vectors, the mean of its shapes'
vectors and a few pooled counts of its words. A two-layer network in numpy gives the logit; a
temperature, fitted on training rows set apart, calibrates it.

Word vectors take no labels and cover all documents. Labels are learned from at most ``MOST_ROWS``
labelled rows (the bound of the fit; the rows of the smallest hash of their id), none of them held
out. Vectors, features and scores are made by tasks;
the driver sees the bounded feature rows and fits the small network. Scores cover every whole text.

Defined results: an empty or null text has the features of no words and so the same score as any
other; without a labelled row every score is 0.5; a label row of several for one id counts by its
least quality; rows of null quality are no labels; extra columns are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, crc32_mod, give_back, packed_sums, tree_summed

#: Labelled rows that the classifier is fitted on at most.
MOST_ROWS = 12_000
CORES, SHAPES, DIM = 1 << 14, 1 << 10, 48
NEIGHBOURS = (1, 2)
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
SOFT = 0.002
THRESHOLD = 0.3
HELD_OUT_OF = 5
MEMO_WORDS = 100_000
#: Words whose vectors are gathered at a time.
SLICE = 1 << 14

_COUNTS, _BLOCKS = 6, 16
_SIGNS = b".,;:!?*#$%&|=+-_/\\()[]{}<>\"'"


def index_vectors() -> np.ndarray:
    """The fixed index vector of each id: four entries of +1 or -1."""
    rng = np.random.default_rng(7)
    out = np.zeros((CORES + SHAPES, DIM), np.float32)
    rows = np.arange(CORES + SHAPES)
    for _ in range(4):
        out[rows, rng.integers(0, DIM, len(rows))] += rng.choice(np.float32([-1, 1]), len(rows))
    return out


class Words:
    """Ids of words, remembered per worker."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Core ids, shape ids and the pooled counts of one text."""
        import zlib

        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(_COUNTS, np.float32)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            low = w.translate(LOWER)
            core = low.strip(_SIGNS)
            signs = low[len(low.rstrip(_SIGNS)) :][:4]
            case = 0 if w == low else 1 if w[1:] == low[1:] else 2 if w.upper() == w else 3
            shape = b"%d %d %d %s" % (case, any(48 <= c < 58 for c in w), min(len(core), 24) // 4, signs)
            memo[w] = (zlib.crc32(core) % CORES) * SHAPES + zlib.crc32(shape) % SHAPES
        packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        cores, shapes = np.divmod(packed, SHAPES)
        again = np.zeros(len(words), bool)
        again[1:] = packed[1:] == packed[:-1]
        shapes[again] = SHAPES - 1
        distinct = len(np.unique(packed))
        n, size = len(words), len(text.encode("utf-8", "replace"))
        counts = [np.log1p(n), distinct / n, np.log1p(distinct), size / n / 8, again.mean(), text.count("\n") / n]
        return cores, shapes + CORES, np.asarray(counts, np.float32)


_WORDS = Words()


def _worker_words() -> Words:
    return _WORDS


def context_vectors(texts: DataFrame, text: str) -> np.ndarray:
    """Word vectors of all ids: index vectors of their neighbours over all ``texts``, summed by tasks and added level by level."""
    rows = -(-(CORES + SHAPES) // _BLOCKS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        index, words = index_vectors(), _worker_words()
        out = np.zeros((_BLOCKS * rows, DIM), np.float32)
        for batch in batches:
            for t in batch[text]:
                cores, shapes, _ = words.ids(t)
                for at in range(0, len(cores), SLICE):
                    c, s = cores[at : at + SLICE], shapes[at : at + SLICE]
                    both = index[c] + index[s]
                    near = np.zeros_like(both)
                    for d in NEIGHBOURS:
                        near[d:] += both[:-d]
                        near[:-d] += both[d:]
                    for ids in (c, s):
                        order = np.argsort(ids, kind="stable")
                        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
                        out[ids[order][first]] += np.add.reduceat(near[order], first, axis=0)
        words.memo.clear()  # an idle worker holds no more than it has to
        if out.any():
            yield packed_sums(out, _BLOCKS)

    out = np.zeros((_BLOCKS * rows, DIM), np.float32)
    for block, x in tree_summed(texts.select(text).mapInPandas(sums, "block int, part int, sums binary"), np.float32).items():
        out[block * rows : (block + 1) * rows] = x.reshape(rows, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def features(words: Words, vectors: np.ndarray, text: str | None) -> np.ndarray:
    cores, shapes, counts = words.ids(text)
    pooled = np.zeros((2, DIM), np.float32)
    for k, ids in enumerate((cores, shapes)):
        for at in range(0, len(ids), SLICE):
            pooled[k] += vectors[ids[at : at + SLICE]].sum(axis=0)
    return np.concatenate([pooled.ravel() / max(1, len(cores)), counts])


class Network:
    """Two layers, standardised inputs, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        fit = ~apart if (~apart).any() else np.ones(len(y), bool)
        z, t = ((x - self.mean) / self.scale)[fit], y[fit]
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 256):
                b = order[at : at + 256]
                h = np.tanh(z[b] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[b]) / len(b)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[b].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], g.sum(keepdims=True)]
                step += 1
                for a, d, f, s in zip(p, grads, m, v):
                    f += 0.1 * (d - f)
                    s += 0.001 * (d * d - s)
                    a -= RATE * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        rest = apart if apart.any() else fit
        logits = self.logit(x[rest])
        soft = SOFT + (1 - 2 * SOFT) * y[rest]  # rows apart may be told apart without an error: no score of 0 or 1 even then
        loss = lambda t: (np.logaddexp(0, logits / t) - soft * logits / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 16, 85), key=loss))

    def logit(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.tanh((x - self.mean) / self.scale @ w + b) @ u + c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS):
    """(word vectors, network), or None without labels. Labels of held-out rows are never looked at."""
    known = (
        labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y"))
        .where("__id IS NOT NULL AND __y IS NOT NULL")
        .where(crc32_mod(F.col("__id"), HELD_OUT_OF) != 0)
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most_rows)  # the bound of the fit
    )
    # at most most_rows short rows are broadcast; ids of several rows still give at most that many here
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(known), "__id")
    vectors = context_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _worker_words()
        for b in batches:
            x = [features(words, shared.value, t).tobytes() for t in b["__t"]]
            yield pd.DataFrame({"id": b["__id"], "y": b["__y"], "x": x})

    sample = sample.withColumn("__id", F.col("__id").cast("string"))  # ids of any type
    made = sample.mapInPandas(rows, "id string, y double, x binary").orderBy(F.xxhash64("id"), "id", "x").limit(most_rows).collect()
    if not made:
        return None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in made]).astype(np.float64)
    y = np.array([float(r["y"] > 0) for r in made])
    apart = np.arange(len(y)) % 5 == 4
    return vectors, Network(x, y, apart)


def quality_scores(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (score >= THRESHOLD)."""
    if model is None:
        scored = docs.withColumn("score", F.lit(0.5))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            give_back()
            words = _worker_words()
            vectors, network = shared.value
            for texts in batches:
                x = [features(words, vectors, t) for t in texts]
                yield pd.Series(network.score(np.stack(x)) if x else [], dtype="float64")
            words.memo.clear()

        scored = docs.withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id"):
    return crc32_mod(F.col(doc_id), HELD_OUT_OF) == 0


def good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; the columns stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")  # no column of a document meets one of a score
    return quality_scores(rows, fit_quality(docs, labels)).where(F.col("predicted") == 1).select("__row.*")
