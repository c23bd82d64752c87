"""Operator 3: approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: the k-nearest-neighbour graph of the sample is cut into balanced parts
(spherical k-means as a start, then moves to the part where most graph neighbours are, under a
capacity), and a small network learns a vector's part from the vector. The number of parts follows
the number of rows: beyond ``MOST_PARTS`` parts, each part is cut again in the same way, by a sample
of its own rows, in tasks. How many parts a query is routed to is the least that reaches ``RECALL`` on
rows kept out of the network's training, plus one.

Index: every row goes to its most probable part. Search: a query goes to its most probable parts
and is reranked there by exact cosine in double precision. A part is dealt to blocks of about
``BLOCK_ROWS`` rows and ``BLOCK_QUERIES`` queries, so a part may hold any share of all rows. Equal
vectors of a block are compared once; the smallest ids among them are the ones that can be nearest.

Defined results: vectors that are null, zero, hold null or non-finite components or have another
length than most rows take no part, nor do rows without an id; rows that repeat an id and its
vector count once; ties go to the smaller id; with fewer candidates all found are returned; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .near_dedup import _groups

#: Rows that the partition is fitted on at most: those of the smallest hash of their id.
FIT_ROWS = 8192
#: Rows that a part of the first level is cut by.
BELOW_ROWS = 4096
PART_ROWS, MOST_PARTS = 2000, 256
GRAPH, SLACK, RECALL = 10, 1.1, 0.97
HIDDEN, EPOCHS, RATE = 96, 25, 2e-3
#: One in so many rows of the sample is kept out of the router's training.
APART = 8
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
NEAREST = 5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row of unit vectors, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[at : at + 512]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, none of more than SLACK times its share, with few graph edges between parts."""
    rng = np.random.default_rng(3)
    most = int(np.ceil(SLACK * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(10):
        own = np.argmax(x @ centres.T, axis=1)
        for p in range(parts):
            if (own == p).any():
                centres[p] = x[own == p].mean(axis=0)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    # the rows surest of their part choose first; who finds it full takes the next best
    score = x @ centres.T
    own, load = np.empty(len(x), np.int64), np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(axis=1)):
        for p in np.argsort(-score[i]):
            if load[p] < most:
                own[i], load[p] = p, load[p] + 1
                break
    for _ in range(8):
        votes = np.zeros((len(x), parts), np.int32)
        for j in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), own[near[:, j]]), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), own]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            p = int(votes[i].argmax())
            if load[p] < most:
                load[own[i]] -= 1
                own[i], load[p] = p, load[p] + 1
                moved += 1
        if not moved:
            break
    return own


class Router:
    """Most probable parts of vectors: a network of one hidden layer."""

    def __init__(self, x: np.ndarray, own: np.ndarray, parts: int):
        rng = np.random.default_rng(4)
        d = x.shape[1]
        self.scale = np.sqrt(d)
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                b = order[at : at + 256]
                z = x[b] * self.scale
                h = np.maximum(z @ p[0] + p[1], 0)
                g = h @ p[2] + p[3]
                g = np.exp(g - g.max(axis=1, keepdims=True))
                g /= g.sum(axis=1, keepdims=True)
                g[np.arange(len(b)), own[b]] -= 1
                g /= len(b)
                back = (g @ p[2].T) * (h > 0)
                step += 1
                for a, e, f, s in zip(p, [z.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0)], m, v):
                    f += 0.1 * (e - f)
                    s += 0.001 * (e * e - s)
                    a -= RATE * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.p = p

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        w, b, u, c = self.p
        s = np.maximum(x * self.scale @ w + b, 0) @ u + c
        return np.argsort(-s, axis=1, kind="stable")[:, :n]


class Tree:
    """Parts in two levels: a router, and for each of its parts that many rows fall into, one of its own."""

    def __init__(self, top: tuple[Router, int, int], below: dict[int, tuple[Router, int, int]]):
        self.top, self.below = top, below

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each unit vector."""
        own = self.top[0].best(x, 1)[:, 0]
        return own * MOST_PARTS + self._inside(x, own, 1)[:, 0]

    def asked(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts that each unit vector's search goes to."""
        router, _, probes = self.top
        best = router.best(x, probes)
        found: list[list[np.ndarray]] = [[] for _ in x]
        for j in range(best.shape[1]):
            for p in np.unique(best[:, j]):
                at = np.flatnonzero(best[:, j] == p)
                inside = self.below[p][0].best(x[at], self.below[p][2]) if p in self.below else np.zeros((len(at), 1), np.int64)
                for i, parts in zip(at.tolist(), p * MOST_PARTS + inside):
                    found[i].append(parts)
        return [np.concatenate(f).astype(np.int32) for f in found]

    def _inside(self, x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(x), n), np.int64)
        for p in np.unique(own):
            if p in self.below:
                at = np.flatnonzero(own == p)
                out[at] = self.below[p][0].best(x[at], n)
        return out


def fit_below(rows: DataFrame, top: tuple[Router, int, int], total: int) -> Tree:
    """The tree under ``top``: a part of far more than PART_ROWS rows is cut again, by a bounded sample of its own, one task a part."""
    if total <= MOST_PARTS * PART_ROWS:
        return Tree(top, {})
    shared = rows.sparkSession.sparkContext.broadcast(top[0])

    @F.pandas_udf("int")
    def part_of(vectors: pd.Series) -> pd.Series:
        return pd.Series(shared.value.best(unit(np.stack(vectors.to_list()).astype(np.float64)), 1)[:, 0] if len(vectors) else [], dtype="int32")

    placed = rows.withColumn("part", part_of("vec"))
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # MOST_PARTS rows at most
    first = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("id"), "id"))
    sample = placed.withColumn("k", first).where(F.col("k") <= BELOW_ROWS)

    part_rows = PART_ROWS

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        part = int(own["part"].iloc[0])
        x = np.stack(own.sort_values("k")["vec"].to_list())
        return pd.DataFrame({"part": [part], "router": [pickle.dumps(fit(x, sizes[part], part_rows))]})

    made = sample.select("part", "k", "vec").groupBy("part").applyInPandas(lambda own: fitted(own), "part int, router binary")
    return Tree(top, {r["part"]: pickle.loads(bytes(r["router"])) for r in made.collect() if sizes[r["part"]] > 2 * PART_ROWS})  # MOST_PARTS small networks


def fit(sample: np.ndarray, rows: int, part_rows: int | None = None) -> tuple[Router, int, int]:
    """(router, parts, parts per query) from a bounded sample of ``rows`` vectors."""
    x = unit(sample.astype(np.float64))
    parts = int(np.clip(rows // (part_rows or PART_ROWS), 1, min(MOST_PARTS, max(1, len(x) // 16))))
    near = graph(x, GRAPH)
    own = balanced_parts(x, near, parts)
    # rows set apart from the router's training tell how many parts have to be asked
    apart = np.arange(len(x)) % APART == APART - 1 if len(x) >= 2 * APART else np.zeros(len(x), bool)
    router = Router(x[~apart], own[~apart], parts)
    ranked = router.best(x, parts)
    where = np.empty_like(ranked)
    np.put_along_axis(where, ranked, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    routed = ranked[:, 0]
    ask = np.flatnonzero(apart) if apart.any() else np.arange(len(x))
    at = np.concatenate([where[i, routed[near[i, :NEAREST]]] for i in ask]) if near.shape[1] else np.zeros(1, np.int64)
    probes = next((m for m in range(1, parts + 1) if (at < m).mean() >= RECALL), parts)
    return router, parts, min(parts, probes + 1)


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    e = F.col(embedding).cast("array<double>")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), e.alias("vec"))
    rows = rows.where(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0))


def _rerank(nearest: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _groups(batches, ["part", "rows", "asks"]):
            key = b[["part", "rows", "asks"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for s, e in zip(cuts, cuts[1:]):
                block = b.iloc[s:e]
                asks = block["ask"].to_numpy()
                if asks.all() or not asks.any():
                    continue
                x = np.frombuffer(b"".join(block["vec"]), np.float64).reshape(len(block), -1)
                ids = block["id"].to_numpy()
                yield _nearest_of(ids[asks], x[asks], ids[~asks], x[~asks], nearest)

    return run


def _nearest_of(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, nearest: int) -> pd.DataFrame:
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], np.ascontiguousarray(c[order])
    # equal vectors once: their smallest ids are the only ones that can be among the nearest
    _, first, inverse = np.unique(c.view(np.dtype((np.void, c.itemsize * c.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    by = by[np.r_[True, (np.diff(inverse[by]) != 0) | (np.diff(cid[by]) != 0)]]  # repeated rows once
    starts = np.searchsorted(inverse[by], np.arange(len(first)))
    rank = np.arange(len(by)) - starts[inverse[by]]
    few = by[rank <= nearest]  # one more, as the query itself may be one
    u, un = c[first], np.sqrt((c[first] * c[first]).sum(axis=1))
    members = np.split(few[np.argsort(inverse[few], kind="stable")], np.cumsum(np.bincount(inverse[few], minlength=len(first)))[:-1])
    s = (unit(q) @ (u / un[:, None]).T)
    keep = min(nearest + 1, s.shape[1])
    floor = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep] - 1e-9
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(s[i] >= floor[i])
        exact = (u[near] * q[i]).sum(axis=1) / (un[near] * np.sqrt((q[i] * q[i]).sum()))
        found = sorted((-x, int(cid[j])) for x, g in zip(exact.tolist(), near) for j in members[g] if cid[j] != qid[i])
        last = None
        for x, j in found:
            if last != j and (n := len([1 for r in out[-nearest:] if r[0] == qid[i]])) < nearest:
                out.append((int(qid[i]), j, -x))
                last = j
            elif last != j:
                break
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, asked, vec_id: str = "vec_id", embedding: str = "embedding", count: int = NEAREST) -> DataFrame:
    """The ``count`` nearest found of every row that the condition ``asked`` (on ``id``) selects: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = valid(vectors, vec_id, embedding)
    total = rows.count()
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").collect()]
    if len(sample) < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_below(rows, fit(np.array(sample), total), total)
    shared = spark.sparkContext.broadcast(tree)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_list()).astype(np.float64)
                best: list[np.ndarray | None] = [None] * len(b)
                asks = np.flatnonzero(b["ask"].to_numpy())
                for i, parts in zip(asks.tolist(), shared.value.asked(unit(x[asks])) if len(asks) else []):
                    best[i] = parts
                yield pd.DataFrame({"id": b["id"], "vec": [v.tobytes() for v in x], "own": shared.value.place(unit(x)), "ask": b["ask"], "best": best})

    from .shared import written

    placed = written(rows.withColumn("ask", asked(F.col("id"))).mapInPandas(routed, "id long, vec binary, own int, ask boolean, best array<int>"), "routed")
    asks = placed.where("ask").select("id", "vec", F.explode("best").alias("part"))
    # a row per part: how many blocks of rows and of queries each has
    sizes = placed.groupBy(F.col("own").alias("part")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("row_blocks"))
    calls = asks.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("ask_blocks"))
    blocks = F.broadcast(sizes.join(calls, "part"))  # MOST_PARTS * MOST_PARTS short rows at most
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.withColumnRenamed("own", "part").join(blocks, "part").select("part", block("row_blocks").alias("rows"), each("ask_blocks").alias("asks"), "id", "vec", F.lit(False).alias("ask"))
    sent = asks.join(blocks, "part").select("part", each("row_blocks").alias("rows"), block("ask_blocks").alias("asks"), "id", "vec", F.lit(True).alias("ask"))
    keys = ["part", "rows", "asks"]
    found = (
        held.unionByName(sent)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(_rerank(count), "query_id long, vec_id long, score double")
        .distinct()
    )
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
