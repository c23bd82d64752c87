"""Operator 9: language-model scores of whole texts.

Base: a unigram model over words. Counts come from all training texts; words that make up a
two-millionth of the training tokens or more (so at most two million of them) are broadcast, the others
meet their counts by a join, in which no word is frequent.

Model: causal self-attention over subword ids, in numpy. A step attends over the last ``CONTEXT``
inputs at least and ``CONTEXT + STRIDE`` at most; windows overlap by ``CONTEXT``, each id is scored
once, in the window where it is among the last ``STRIDE``. What follows an id is known from pair
counts of all training texts (pairs that make up a ``PAIRS``-th of them or more are broadcast, the others
meet their counts by a join), and attention tells the next id's class from the context:

    p(y | x, context) = softmax over classes (log P(class | x) + attention)[class of y] * P(y | x) / P(class of y | x)

so without attention the model is the pair model. Classes and embeddings of ids are made of the
counts of ids beside hashed neighbours. The attention's weights are trained by gradient steps on
every window of the training texts: texts are dealt to shards of about ``SHARD`` ids and ordered
inside them by hashes of id and text, each shard is gone through ``ROUNDS`` times, and the weights
are averaged, so scores do not depend on how rows are partitioned.

A text's ids are framed by a begin and an end mark (the end is predicted too), so the score is the
log10 probability of the whole text.

Defined results: a null text is empty: one base token, the end; repeated rows each get their own
row; with no training rows counts are 0 and the model is the uniform one; a null id is training
text or not by the crc32 of the empty string (0: held out); an empty table gives an empty result;
extra columns do not pass.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, LOWER, byte_runs, crc32_mod, give_back, sizes, tree_summed, written
from .tokens import units, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
HELD_OUT_OF = 10
SMOOTH = 0.1
#: Words of at least this share of the training tokens are broadcast.
FREQUENT = 2_000_000
#: Pairs of ids of at least this share of all training pairs are broadcast with their counts.
PAIRS = 1 << 22
STRIDE, CONTEXT, DIM, CLASSES, BESIDE = 24, 8, 16, 128, 32
ROUNDS, BATCH, RATE, SHARD = 2, 64, 4e-3, 1 << 22
#: Windows that a step of the work takes at a time; windows whose classes are worked out at a time, so that they stay in a core's cache.
SCORE_CHUNKS, LEARNED, BLOCK = 256, 1 << 14, 16
#: Shards have a task each, up to this number of tasks.
TASKS = 2000
#: Distinct words, and pairs, that a task counts before it passes them on.
COUNTED, PAIRED = 800_000, 4_000_000

GATHERED = "kind int, doc_id string, train boolean, ids binary, word string, pair long, n long"
SCORED = "doc_id string, train boolean, n_tokens long, known long, base double, score double, rare string"


class Decoder:
    """Ids back to their bytes, by one table."""

    def __init__(self, path: str):
        tok = units(path)
        parts = []
        for i in range(tok.tok.get_vocab_size()):
            try:
                parts.append(tok.plain.decode_single_token_bytes(i))
            except KeyError:  # a special string
                parts.append(tok.tok.id_to_token(i).encode())
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts])
        self.start = np.cumsum(self.size) - self.size

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(self._part(ids[i : i + (1 << 18)]) for i in range(0, len(ids), 1 << 18))

    def _part(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.cumsum(size)
        return self.table[np.arange(int(at[-1])) + np.repeat(self.start[ids] - (at - size), size)].tobytes()


@functools.lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def gathered(docs: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    """One scan: rows of ids (kind 0), of word counts (kind 1) and of counts of pairs of ids, first << 16 | second (kind 2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = units(vocabulary_path(vocabulary))
        mark = np.array([tok.tok.get_vocab_size() - 1], np.uint16)
        counts: Counter = Counter()
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        names = [c.split()[0] for c in GATHERED.split(", ")]

        def part(**kind) -> pd.DataFrame:
            return pd.DataFrame({n: kind.get(n) for n in names}, index=range(len(next(iter(kind.values())))))

        def flush_words() -> Iterator[pd.DataFrame]:
            while counts:
                some = [counts.popitem() for _ in range(min(len(counts), 100_000))]
                yield part(kind=[1] * len(some), word=[w.decode("utf-8", "replace") for w, _ in some], n=[n for _, n in some])

        def flush_pairs() -> Iterator[pd.DataFrame]:
            if pairs:
                k, n = _summed(*(np.concatenate(x) for x in zip(*pairs)))
                pairs.clear()
                for at in range(0, len(k), 200_000):
                    yield part(kind=[2] * len(k[at : at + 200_000]), pair=k[at : at + 200_000], n=n[at : at + 200_000])

        for batch in batches:
            texts = [t or "" for t in batch["__t"]]
            for lo, hi in byte_runs(sizes(texts), CHUNK_BYTES):
                found = [np.frombuffer(x, "<u4").astype(np.uint16) for x in tok.ids(texts[lo:hi])]
                train = batch["__train"].iloc[lo:hi].to_numpy()
                yield part(kind=[0] * (hi - lo), doc_id=list(batch["__id"].iloc[lo:hi]), train=list(train), ids=[x.tobytes() for x in found])
                use = [np.concatenate([mark, x, mark]) for x, t in zip(found, train) if t]
                if use:
                    flat = np.concatenate(use).astype(np.int64)
                    inner = np.ones(len(flat), bool)  # no pair across two texts
                    inner[np.cumsum([len(x) for x in use]) - 1] = False
                    pairs.append(np.unique((flat[:-1] << 16 | flat[1:])[inner[:-1]], return_counts=True))
                for t, own in zip(texts[lo:hi], train):
                    if own:
                        counts.update(_words(t.encode("utf-8", "replace")))
                if len(counts) > COUNTED:
                    yield from flush_words()
                if sum(len(k) for k, _ in pairs) > PAIRED:
                    yield from flush_pairs()
        yield from flush_words()
        yield from flush_pairs()

    rows = docs.select(
        F.col(doc_id).cast("string").alias("__id"), F.col(text).alias("__t"), (crc32_mod(F.col(doc_id), HELD_OUT_OF) != 0).alias("__train")
    )
    return rows.mapInPandas(run, GATHERED)


class Pairs:
    """Numbers by key, in open addressing: a few looks each, whatever the number of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.float32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = np.flatnonzero(self.keys[at] < 0)
            _, own = np.unique(at[free], return_index=True)
            taken = free[own]
            self.keys[at[taken]], self.values[at[taken]] = keys[left[taken]], values[left[taken]]
            left, step = np.delete(left, taken), step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)).astype(np.int64) + step) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; 0 if it is not there."""
        out, left, step = np.zeros(len(keys), np.float32), np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], step)
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, step = left[~hit & (held >= 0)], step + 1
        return out


def _pair_counts(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame | None]:
    """(counts of ids beside hashed neighbours, before and behind; frequent pairs; their counts; the other pairs, if any), over all training texts."""
    pairs = written(table.where("kind = 2").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    first, second = F.shiftright("pair", 16), F.col("pair").bitwiseAND(F.lit(0xFFFF))
    place = lambda c: F.pmod(F.shiftright(c * 40503, 4), F.lit(BESIDE))
    cells = F.array(second * (2 * BESIDE) + place(first), first * (2 * BESIDE) + BESIDE + place(second))
    beside = pairs.select(F.explode(cells).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # size * 2 * BESIDE rows at most
    near = np.zeros(size * 2 * BESIDE)
    near[beside["cell"].to_numpy()] = beside["n"].to_numpy()
    total = near.reshape(size, -1)[:, :BESIDE].sum()
    kept = pairs.where(F.col("n") * PAIRS >= int(total)).orderBy("pair").toArrow()  # PAIRS rows at most
    rare = pairs.where(F.col("n") * PAIRS < int(total))
    return near.reshape(size, -1), kept["pair"].to_numpy(), kept["n"].to_numpy(), None if rare.isEmpty() else rare


def _rare_sums(rare: DataFrame, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds by first id; pairs by first id; pairs by first id and class of the second) of pairs that are not broadcast."""
    size, spark = len(cls), rare.sparkSession
    classes = spark.createDataFrame(pd.DataFrame({"second": np.arange(size), "cls": cls}), "second long, cls long")
    met = rare.select(F.shiftright("pair", 16).alias("first"), F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("second"), "n").join(F.broadcast(classes), "second")  # an id each
    sums = met.groupBy((F.col("first") * CLASSES + F.col("cls")).alias("cell")).agg(F.count("*").cast("int").alias("kinds"), F.sum("n").alias("n")).toArrow()  # size * CLASSES rows at most
    cell, kinds, n = (sums[c].to_numpy() for c in ("cell", "kinds", "n"))
    by_class = np.bincount(cell, weights=n, minlength=size * CLASSES).reshape(size, CLASSES)
    return np.bincount(cell // CLASSES, weights=kinds, minlength=size), by_class.sum(axis=1), by_class


class Model:
    """The pair model, and attention over the embeddings of ids for the next id's class."""

    def __init__(self, near: np.ndarray, pairs: np.ndarray, counts: np.ndarray, rare: DataFrame | None = None):
        rng = np.random.default_rng(9)
        size, seen = len(near), near[:, :BESIDE].sum(axis=1)
        x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
        x -= x[seen > 0].mean(axis=0) if (seen > 0).any() else 0
        x[seen == 0] = 0
        _, axes = np.linalg.eigh(x.T @ (x * np.sqrt(seen)[:, None]))
        e = x @ axes[:, -DIM:]
        self.e = (e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-3)).astype(np.float32)
        self.cls = self._classes(x[:, :BESIDE], seen)
        # P(second | first): kept pairs by their counts, beside as many and one more of the second's own
        self.one = (seen + SMOOTH) / (seen.sum() + SMOOTH * size)
        first, second = pairs >> 16, pairs & 0xFFFF
        kinds, total = np.bincount(first, minlength=size), np.bincount(first, weights=counts, minlength=size)
        by_class = np.bincount(first * CLASSES + self.cls[second], weights=counts, minlength=size * CLASSES).reshape(size, CLASSES)
        if rare is not None:
            kinds, total, by_class = (a + b for a, b in zip((kinds, total, by_class), _rare_sums(rare, self.cls)))
        self.whole = total + kinds + 1
        self.spare = (kinds + 1) / (total + kinds + 1)
        self.pairs = Pairs(pairs, counts / (total + kinds + 1)[first])
        share = by_class / (total + kinds + 1)[:, None] + self.spare[:, None] * np.bincount(self.cls, weights=self.one, minlength=CLASSES)
        self.prior = np.log(np.maximum(share, 1e-30)).astype(np.float32)
        self.one, self.spare = self.one.astype(np.float32), self.spare.astype(np.float32)
        self.p = {
            "q": rng.normal(0, 0.3, (DIM, DIM)),
            "k": rng.normal(0, 0.3, (DIM, DIM)),
            "v": rng.normal(0, 0.3, (DIM, DIM)),
            "near": -0.1 * np.arange(STRIDE + CONTEXT),
            "w": np.zeros((DIM, CLASSES)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _classes(y: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Ids after like neighbours, by weighted k-means."""
        known, weight = np.flatnonzero(seen > 0), np.sqrt(seen)
        if len(known) <= CLASSES:
            return np.zeros(len(y), np.int64)
        c = y[known[np.argsort(-seen[known], kind="stable")[:CLASSES]]].copy()
        for _ in range(12):
            own = np.concatenate([np.argmin((c * c).sum(1) - 2 * y[i : i + 8192] @ c.T, axis=1) for i in range(0, len(y), 8192)])
            total = np.bincount(own, weights=weight, minlength=CLASSES)
            sums = np.stack([np.bincount(own, weights=y[:, j] * weight, minlength=CLASSES) for j in range(y.shape[1])], axis=1)
            c = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-30)[:, None], c)
        return own

    def gain(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What the count of a pair that is not broadcast adds to log10 P(second | first)."""
        first, second = pairs >> 16, pairs & 0xFFFF
        return np.log1p(counts / self.whole[first] / (self.spare[first].astype(np.float64) * self.one[second])) / math.log(10)

    def mask(self) -> np.ndarray:
        """What position adds to the attention; far below zero for what lies ahead."""
        return _mask(self.p["near"])


#: How far behind a window's scored input each of its inputs is; the same with 0 for what lies ahead.
AWAY = np.arange(STRIDE)[:, None] + CONTEXT - np.arange(STRIDE + CONTEXT)[None, :]
BACK = np.maximum(AWAY, 0)
ONES = np.ones(max(CLASSES, STRIDE + CONTEXT, BATCH), np.float32)


def _mask(near: np.ndarray) -> np.ndarray:
    return np.where(AWAY >= 0, near[BACK], np.float32(-60))


def chunks(texts: list[np.ndarray], mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of inputs (CONTEXT + STRIDE ids), their targets (-1: none), whether one starts its text, and each text's number of windows."""
    per = np.array([-(-(len(t) + 1) // STRIDE) for t in texts])
    flat = np.full(CONTEXT + STRIDE * per.sum(), mark, np.int32)
    goal = np.full(STRIDE * per.sum(), -1, np.int32)
    at = 0
    for t, n in zip(texts, per):
        flat[CONTEXT + at + 1 : CONTEXT + at + 1 + len(t)] = t
        goal[at : at + len(t)] = t
        goal[at + len(t)] = mark
        at += STRIDE * n
    first = np.zeros(per.sum(), bool)
    first[np.cumsum(per) - per] = True
    windows = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT + STRIDE)[::STRIDE]
    return windows, goal.reshape(-1, STRIDE), first, per


class Classes:
    """The classes' logits of ``BLOCK`` windows at a time, in two tables that are used again and again."""

    def __init__(self, model: Model):
        self.prior = model.prior
        self.own, self.other = (np.empty((BLOCK * STRIDE, CLASSES), np.float32) for _ in range(2))

    def of(self, h: np.ndarray, w: np.ndarray, last: np.ndarray, cls: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, the attention's part of the logit of each row's ``cls``, exp of all classes' logits, its sums) by block."""
        for at in range(0, len(h), BLOCK * STRIDE):
            rows = slice(at, min(len(h), at + BLOCK * STRIDE))
            n = rows.stop - at
            g = np.matmul(h[rows], w, out=self.own[:n])
            chosen = g[np.arange(n), cls[rows]]
            g += np.take(self.prior, last[rows], axis=0, out=self.other[:n], mode="clip")
            np.exp(g, out=g)
            yield rows, chosen, g, g @ ONES[:CLASSES]


class Scorer:
    """A model made ready: projections of all ids tabled."""

    def __init__(self, model: Model):
        p, e = model.p, model.e
        self.q = e @ p["q"] / np.float32(DIM**0.5)
        self.kv = np.concatenate([e @ p["k"], e @ p["v"]], axis=1)
        self.w = p["w"]
        self.model, self.mask, self.classes = model, np.exp(model.mask()), Classes(model)
        self.a = np.empty((SCORE_CHUNKS, STRIDE, STRIDE + CONTEXT), np.float32)

    def log10(self, windows: np.ndarray, goal: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log10 probability of each window's targets, summed."""
        return self.told(windows, goal, first)[0]

    def told(self, windows: np.ndarray, goal: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Also the pairs that the model does not hold, in order, and how many each window has."""
        m, out, lacking, lack = self.model, np.empty(len(windows)), [np.zeros(0, np.int64)], np.zeros(len(windows), np.int64)
        for at in range(0, len(windows), SCORE_CHUNKS):
            x, y = windows[at : at + SCORE_CHUNKS], goal[at : at + SCORE_CHUNKS]
            last, want, there = np.ascontiguousarray(x[:, CONTEXT:]), np.maximum(y.ravel(), 0), y >= 0
            kv = self.kv[x]
            a = np.matmul(self.q[last], kv[:, :, :DIM].transpose(0, 2, 1), out=self.a[: len(x)])
            last = last.ravel()
            np.exp(a, out=a)
            a *= self.mask
            a[first[at : at + SCORE_CHUNKS], :, :CONTEXT] = 0
            h = (a @ kv[:, :, DIM:]).reshape(-1, DIM)
            h /= (a.reshape(-1, STRIDE + CONTEXT) @ ONES[: STRIDE + CONTEXT])[:, None]
            # log P(class | x) is part of the class's logit and of log P(y | x) - log P(class | x), and falls out
            lp = np.empty(len(h), np.float32)
            for rows, chosen, _, total in self.classes.of(h, self.w, last, m.cls[want]):
                lp[rows] = chosen - np.log(total)
            keys = last.astype(np.int64) << 16 | want
            held = m.pairs.get(keys)
            lp += np.log(held + m.spare[last] * m.one[want])
            out[at : at + SCORE_CHUNKS] = np.where(there, lp.reshape(y.shape).astype(np.float64), 0).sum(axis=1)
            without = (held == 0).reshape(y.shape) & there
            lack[at : at + SCORE_CHUNKS] = without.sum(axis=1)
            lacking.append(keys[without.ravel()])
        return out / math.log(10), np.concatenate(lacking), lack


class Learner:
    """Gradient steps (Adam) on the attention's weights, ``BATCH`` windows each, in the order given, ``ROUNDS`` times over."""

    def __init__(self, model: Model):
        self.model, self.step, self.windows, self.classes = model, 0, 0, Classes(model)
        self.flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)])
        self.grad, self.m1, self.m2 = (np.zeros_like(self.flat) for _ in range(3))
        self.p, self.d = self._parts(self.flat), self._parts(self.grad)
        self.held: list[list[np.ndarray]] = [[], [], []]
        self.seen: list[list[np.ndarray]] = []  # a shard's windows, for the next round
        self.a, self.da = (np.empty((BATCH, STRIDE, STRIDE + CONTEXT), np.float32) for _ in range(2))
        self.qkv, self.back = (np.zeros((BATCH, STRIDE + CONTEXT, 3 * DIM), np.float32) for _ in range(2))

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k in sorted(self.model.p):
            out[k] = flat[at : at + self.model.p[k].size].reshape(self.model.p[k].shape)
            at += self.model.p[k].size
        return out

    def add(self, windows: np.ndarray, goal: np.ndarray, first: np.ndarray) -> None:
        for k, a in zip(self.held, (windows, goal, first)):
            k.append(a)
        if sum(map(len, self.held[2])) >= LEARNED:
            self._learn(whole=False)

    def done(self) -> np.ndarray:
        """The weights times the number of windows, and that number."""
        self._learn(whole=True)
        for _ in range(ROUNDS - 1):
            for part in self.seen:
                self._steps(*part)
        self.seen = []
        return np.concatenate([self.flat.astype(np.float64) * self.windows, [self.windows]])

    def _learn(self, whole: bool) -> None:
        if not self.held[2]:
            return
        held = [np.concatenate(k) for k in self.held]
        end = len(held[2]) if whole else len(held[2]) // BATCH * BATCH  # steps do not depend on how windows arrive
        self.seen.append([k[:end] for k in held])
        self._steps(*self.seen[-1])
        self.held = [[k[end:].copy()] for k in held]
        self.windows += end

    def _steps(self, w: np.ndarray, g: np.ndarray, f: np.ndarray) -> None:
        for at in range(0, len(w), BATCH):
            self._take(w[at : at + BATCH], g[at : at + BATCH], f[at : at + BATCH])

    def _take(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> None:
        p, d, m, b, scale = self.p, self.d, self.model, len(x), np.float32(DIM**-0.5)
        span, last, t = STRIDE + CONTEXT, x[:, CONTEXT:].ravel(), y.ravel()
        every = np.take(m.e, x.ravel(), axis=0, mode="clip")
        qkv = np.matmul(every, np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1), out=self.qkv[:b].reshape(-1, 3 * DIM)).reshape(b, span, -1)
        q, k, v = qkv[:, CONTEXT:, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
        a = np.matmul(q, k.transpose(0, 2, 1), out=self.a[:b])
        a += _mask(p["near"])
        a[first, :, :CONTEXT] = -60
        np.exp(a, out=a)
        norm = 1 / (a.reshape(-1, span) @ ONES[:span])
        h = (a @ v).reshape(-1, DIM)
        h *= norm[:, None]
        there = t >= 0
        part = np.where(there, np.float32(1 / max(1, np.count_nonzero(there))), np.float32(0))
        dh, goal, w = np.empty_like(h), m.cls[t], np.ascontiguousarray(p["w"].T)
        down = np.zeros((CLASSES, DIM), np.float32)
        for rows, _, g, total in self.classes.of(h, p["w"], last, goal):
            g[np.arange(len(g)), goal[rows]] -= total
            each = (part[rows] / total)[:, None]
            np.matmul(g, w, out=dh[rows])
            dh[rows] *= each
            down += g.T @ (h[rows] * each)
        d["w"][:] = down.T
        less = np.einsum("ij,ij->i", dh, h) * norm
        dh *= norm[:, None]
        dh = dh.reshape(b, STRIDE, DIM)
        da = np.matmul(dh, v.transpose(0, 2, 1), out=self.da[:b])
        da -= less.reshape(b, STRIDE, 1)
        da *= a
        back = self.back[:b]
        np.matmul(da, k, out=back[:, CONTEXT:, :DIM])
        np.matmul(da.transpose(0, 2, 1), q, out=back[:, :, DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), dh, out=back[:, :, 2 * DIM :])
        parts = math.gcd(b, 8)  # short sums of products are faster than one over all rows
        all_three = (every.reshape(parts, -1, DIM).transpose(0, 2, 1) @ back.reshape(parts, -1, 3 * DIM)).sum(axis=0)
        np.multiply(all_three[:, :DIM], scale, out=d["q"])
        d["k"][:], d["v"][:] = all_three[:, DIM : 2 * DIM], all_three[:, 2 * DIM :]
        behind = np.where(AWAY >= 0, (ONES[:b] @ da.reshape(b, -1)).reshape(STRIDE, span), 0)
        d["near"][:] = np.bincount(BACK.ravel(), weights=behind.ravel(), minlength=span)
        self.step += 1
        self.m1 += 0.1 * (self.grad - self.m1)
        self.m2 += 0.01 * (self.grad * self.grad - self.m2)
        self.flat -= RATE * (self.m1 / (1 - 0.9**self.step)) / (np.sqrt(self.m2 / (1 - 0.99**self.step)) + 1e-9)


def fit(table: DataFrame, size: int) -> Model:
    return _fitted(table, size)[0]


def _fitted(table: DataFrame, size: int) -> tuple[Model, DataFrame | None]:
    """The model, and the pairs (pair, n) that it does not hold, if any."""
    counts = _pair_counts(table, size)
    return _trained(Model(*counts), table, size), counts[3]


def _trained(model: Model, table: DataFrame, size: int) -> Model:
    spark = table.sparkSession
    train = table.where("kind = 0 AND train").select("doc_id", "ids")
    total = train.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 2
    shards = -(-total // SHARD)
    if not shards:
        return model
    dealt = train.select("ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(F.lit(1), "doc_id", "ids").alias("at"))
    dealt = dealt.repartitionById(min(shards, TASKS), "shard").sortWithinPartitions("shard", "at", "ids")
    shared = spark.sparkContext.broadcast(model)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(shard: int, learner: Learner) -> pd.DataFrame:
            return pd.DataFrame({"block": [0], "part": [shard], "sums": [zlib.compress(learner.done().tobytes(), 1)]})

        give_back()
        shard, learner = None, None
        for batch in batches:
            for own, part in batch.groupby("shard", sort=False):
                if own != shard:
                    if learner is not None:
                        yield told(shard, learner)
                    shard, learner = own, Learner(shared.value)
                every = [np.frombuffer(x, np.uint16) for x in part["ids"]]
                for lo, hi in byte_runs([len(x) for x in every], 1 << 19):
                    learner.add(*chunks(every[lo:hi], size - 1)[:3])
        if learner is not None:
            yield told(shard, learner)

    flat = tree_summed(dealt.mapInPandas(steps, "block int, part int, sums binary"), np.float64)[0]
    at = 0
    for k in sorted(model.p):
        model.p[k] = (flat[at : at + model.p[k].size] / flat[-1]).reshape(model.p[k].shape).astype(np.float32)
        at += model.p[k].size
    return model


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    tok = units(vocabulary_path(vocabulary))
    size = tok.tok.get_vocab_size()
    if tok.plain is None or size > 1 << 16:
        raise ValueError("a byte-level vocabulary of at most 65536 ids is needed")
    table = written(gathered(docs, doc_id, text, vocabulary), "gathered")
    words = written(table.where("kind = 1").groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = table.where("kind = 0 AND train").count()
    told = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = told["n"] + ends, told["v"] + (ends > 0)
    most = {r["word"].encode(): r["c"] for r in words.where(F.col("c") * FREQUENT >= n).collect()} if n else {}  # FREQUENT at most
    model, rare_pairs = _fitted(table, size)
    shared, joined = spark.sparkContext.broadcast((most, model)), rare_pairs is not None
    below = math.log10(n + SMOOTH * (v + 1))

    schema = SCORED + (", pairs array<bigint>" if joined else "")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        most, model = shared.value
        scorer, decoder, unknown = Scorer(model), _decoder(vocabulary_path(vocabulary)), itertools.repeat(math.nan)
        part_of = {w: math.log10(c + SMOOTH) for w, c in most.items()}
        for batch in batches:
            every = [np.frombuffer(x, np.uint16) for x in batch["ids"]]
            for lo, hi in byte_runs([len(x) for x in every], 1 << 19):
                ids = every[lo:hi]
                windows, goal, first, per = chunks(ids, size - 1)
                told, pairs, lack = scorer.told(windows, goal, first)
                scores, ends = np.add.reduceat(told, np.cumsum(per) - per), np.r_[0, np.cumsum(lack)][np.cumsum(per)]
                rows, begin = [], 0
                for i, own, x, s, end in zip(batch["doc_id"].iloc[lo:hi], batch["train"].iloc[lo:hi], ids, scores, ends):
                    found = _words(decoder.text(x))
                    parts = np.fromiter(map(part_of.get, found, unknown), np.float64, len(found))
                    gaps = np.flatnonzero(np.isnan(parts))
                    base, known = float(np.nansum(parts)), len(found) - len(gaps)
                    # words hold no blanks
                    less = b" ".join(map(found.__getitem__, gaps.tolist())).decode("utf-8", "replace") if len(gaps) else None
                    row = (i, own, len(found) + 1, known, base, float(s), less)
                    if joined:
                        row += (pairs[begin:end],)
                        begin = end
                    rows.append(row)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"pair": batch["pair"], "gain": shared.value[1].gain(batch["pair"].to_numpy(), batch["n"].to_numpy())})

    scored = written(
        table.where("kind = 0").select("doc_id", "train", "ids").mapInPandas(score, schema).withColumn("rid", F.monotonically_increasing_id()), "scored"
    )
    rare = scored.where("rare IS NOT NULL").select("rid", F.explode(F.split("rare", " ")).alias("word"))
    counted = (
        rare.join(words, "word", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("rid")
        .agg(F.sum(F.log10(F.col("c") + SMOOTH)).alias("rare_base"), F.count_if(F.col("c") > 0).alias("rare_known"))
    )
    score_of = F.col("score")
    if joined:
        own = scored.select("rid", F.explode("pairs").alias("pair")).join(rare_pairs.mapInPandas(gains, "pair bigint, gain double"), "pair")
        # decimals, so that sums do not depend on the order
        added = own.groupBy("rid").agg(F.sum(F.col("gain").cast("decimal(20,10)")).cast("double").alias("gained"))
        scored, score_of = scored.join(added, "rid", "left"), F.col("score") + F.coalesce("gained", F.lit(0.0))
    end = math.log10(ends + SMOOTH)
    none = F.lit(0).cast("long")
    return scored.join(counted, "rid", "left").select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType).alias(doc_id),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", none) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        score_of.alias("score"),
    )
