"""Operator 7: MinHash near-dedup with b-bit signatures.

A document's set is its distinct word shingles, as 64-bit hashes. Documents of equal sets (told by a
128-bit digest of the full set) form a class; only classes go on. Each class has ``BANDS * ROWS``
minima; a band's minima, hashed, are a bucket, and the low ``BITS`` bits of all minima, packed, are
the signature. At a similarity of 0.8 two classes share no bucket with a probability of 3e-6.

Candidates are the pairs inside a bucket. They are never written as pairs: a bucket is dealt to
blocks, a task compares two blocks by signature (equal groups of bits counted, corrected for the
2^-BITS chance of equal bits) and passes on the classes that have a likely partner, once each. Then
the full sets of these classes meet in the same blocks, the likely pairs are found again, and their
similarity is confirmed exactly; pairs that confirmed links have already joined inside the task are
skipped, and a task passes on a star for each group it has joined, so n near copies give about n links. A pair is taken up only in the first band
it shares. Components come from alternating large-star and small-star steps over the links.

Keys that many rows have (a bucket, a class of copies, the hub of a star) meet their one row by
broadcast, see ``join_hot``.

Defined results: rows are documents; a row without words has no class, links with nothing and is
its own component; a null id belongs to no component (component_id null, kept true); repeated rows
of an id have equal results, and all are kept if one is; rows of one id with other texts are
documents of their own, whose component_id is the smallest id of their own group; ids of any type
that has an order and reads back from its text; an empty table gives an empty result.
``near_duplicates`` returns results alone, ``one_of_each`` all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, LOWER, byte_runs, few, give_back, join_hot, sizes, written

ROWS, BANDS, BITS = 6, 42, 2
MINIMA = 256
SIMILARITY = 0.8
#: How far below the limit an estimate may lie: over five standard deviations.
SLACK = 0.16
#: Classes, and shingles, that a block of a bucket holds on average at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 20
MEMO_WORDS = 150_000

_MEMBER = "doc_id string, key long, n long, cls binary, sig binary, bands array<long>"
_JOB = ["bucket", "lo", "hi"]


class Shingles:
    """Distinct shingle hashes of texts, word hashes remembered per worker."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, text: str | None, size: int) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(size, len(h))
        with np.errstate(over="ignore"):
            s = h[: len(h) - size + 1] + np.uint64(size)
            for j in range(1, size):
                s = _mixed(s) + h[j : len(h) - size + 1 + j]
            return np.unique(_mixed(s))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_SHINGLES = Shingles()


def _worker_shingles() -> Shingles:
    return _SHINGLES


def set_class(s: np.ndarray) -> bytes:
    """One digest for equal sets."""
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each set (none of them empty) under the fixed hash functions."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
    out = np.full((len(sets), MINIMA), 2**32 - 1, np.uint32)
    for lo, hi in byte_runs([len(s) for s in sets], 1 << 16):
        flat = np.concatenate([(s >> np.uint64(32)).astype(np.uint32) for s in sets[lo:hi]])
        starts = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        for k in range(MINIMA):
            x = flat * a[k] + b[k]
            x ^= x >> np.uint32(16)
            out[lo:hi, k] = np.minimum.reduceat(x, starts)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """The low bits of the minima: MINIMA * BITS / 64 words a row."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), MINIMA // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def buckets(m: np.ndarray) -> np.ndarray:
    """A bucket for each row and band; the band is part of the hash."""
    with np.errstate(over="ignore"):
        h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), 1))
        rows = m[:, : BANDS * ROWS].reshape(len(m), BANDS, ROWS).astype(np.uint64)
        for r in range(ROWS):
            h = _mixed(h) + rows[:, :, r]
        return _mixed(h)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures, corrected for equal bits by chance."""
    diff = a ^ b
    fold = diff.copy()
    for k in range(1, BITS):
        fold |= diff >> np.uint64(k)
    ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    equal = 1 - np.bitwise_count(fold & ones).sum(axis=-1) / MINIMA
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of the text), n, and for documents with words cls, sig, bands."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        shingles = _worker_shingles()
        for batch in batches:
            texts = list(batch["__t"])
            for lo, hi in byte_runs(sizes(texts), CHUNK_BYTES):
                sets = [shingles.of(t, size) for t in texts[lo:hi]]
                some = [s for s in sets if len(s)]
                m = minima(some)
                sig, bands = packed(m), buckets(m)
                rows, k = [], 0
                for i, key, s in zip(batch["__id"].iloc[lo:hi], batch["__k"].iloc[lo:hi], sets):
                    if len(s):
                        rows.append((i, key, len(s), set_class(s), sig[k].tobytes(), bands[k].view(np.int64)))
                        k += 1
                    else:
                        rows.append((i, key, 0, None, None, None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBER.split(", ")])

    # ids travel as text: pandas would make floats of whole numbers with nulls
    rows = docs.select(F.col(doc_id).cast("string").alias("__id"), F.xxhash64(text).alias("__k"), F.col(text).alias("__t"))
    return rows.mapInPandas(made, _MEMBER).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches that end where a group of the sorted ``keys`` ends."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        last = np.flatnonzero((k != k[-1]).any(axis=1))
        if len(last):
            cut = last[-1] + 1
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _pairs(b: pd.DataFrame, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of likely similar classes of each job, ``b`` being sorted by job; a pair only in the first band it shares."""
    key = b[_JOB].to_numpy()
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    sig = np.frombuffer(b"".join(b["sig"]), np.uint64).reshape(len(b), -1)
    marks = np.stack(b["marks"].to_list())
    band, block = b["band"].to_numpy(), b["block"].to_numpy()
    across = key[:, 1] != key[:, 2]
    end = np.searchsorted(group, group, side="right")
    at = np.arange(len(b))
    d, live = 1, at[at + 1 < end]
    while len(live):
        u, v = live, live + d
        ok = ~across[u] | (block[u] != block[v])
        u, v = u[ok], v[ok]
        for lo in range(0, len(u), 1 << 16):
            x, y = u[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]
            near = estimate(sig[x], sig[y]) >= floor
            x, y = x[near], y[near]
            first = (marks[x] == marks[y]).argmax(axis=1) == band[x]
            if first.any():
                yield x[first], y[first]
        d += 1
        live = live[live + d < end[live]]


def _likely(floor: float):
    """Per job, the classes that are likely similar to another one of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for b in _groups(batches, _JOB):
            some = np.zeros(len(b), bool)
            for x, y in _pairs(b, floor):
                some[x] = some[y] = True
            if some.any():
                yield b.loc[some, [*_JOB, "block", "band", "cls"]]

    return run


def _confirmed(similarity: float, floor: float):
    """Classes of a job that links on the full sets join, each linked to the first of those it is joined to; pairs already joined are skipped."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for b in _groups(batches, _JOB):
            sets = [np.frombuffer(x, np.uint64) for x in b["shingles"]]
            size = np.array([len(s) for s in sets])
            root = np.arange(len(b))
            for x, y in _pairs(b, floor):
                short, long = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                open_ = (root[x] != root[y]) & (100 * short >= percent * long)
                for u, v in zip(x[open_].tolist(), y[open_].tolist()):
                    if root[u] == root[v]:
                        continue
                    both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                    if 100 * both >= percent * (len(sets[u]) + len(sets[v]) - both):
                        root[root == root[u]] = root[v]
            if (root != np.arange(len(b))).any():
                # stars around the least id, as its text tells it, need the fewest steps to a component
                rep, cls = b["rep"].to_numpy(), b["cls"].to_numpy()
                order = sorted(range(len(b)), key=lambda i: (root[i], len(rep[i]), rep[i]))
                u, centre = np.array(order), root[order]
                v = u[np.searchsorted(centre, centre)]
                u, v = u[u != v], v[u != v]
                yield pd.DataFrame({"ur": rep[u], "u": cls[u], "vr": rep[v], "v": cls[v]})

    return run


def confirmed_links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, size: int, similarity: float) -> DataFrame:
    """(u, v) of classes, each as (smallest id, class): links on full sets that join the same classes as all links do."""
    each = classes.select("cls", "n", F.posexplode("bands").alias("band", "bucket"))
    several = written(
        each.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles")).where("classes > 1"), "buckets"
    )
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.least(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.col("classes"))).cast("int")
    placed = (
        join_hot(each.select("cls", "band", "bucket"), several, ["bucket"], "classes", BANDS * classes.count())
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", "cls", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    # 31 bits of each bucket tell the bands that two classes share
    marks = F.transform("bands", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("marks")
    floor = similarity - SLACK
    likely = written(
        placed.join(classes.select("cls", "sig", marks), "cls")
        .repartition(*_JOB)
        .sortWithinPartitions(*_JOB, "cls")
        .mapInPandas(_likely(floor), "bucket long, lo int, hi int, block int, band int, cls binary"),
        "likely",
    )
    # the full sets of the classes in question, from one document each
    asked = written(likely.select("cls").distinct().join(classes.select("cls", "rep"), "cls"), "asked")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        shingles = _worker_shingles()
        for batch in batches:
            for lo, hi in byte_runs(sizes(batch["__t"]), CHUNK_BYTES):
                part = batch.iloc[lo:hi]
                sets = [shingles.of(t, size) for t in part["__t"]]
                same = [len(s) > 0 and set_class(s) == bytes(c) for s, c in zip(sets, part["cls"])]
                out = part.loc[same, ["cls", "rep"]]
                out["shingles"] = [s.tobytes() for s, ok in zip(sets, same) if ok]
                yield out

    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t"))
    sets = (
        texts.join(few(asked), texts["__id"] == asked["rep"])
        .select("cls", F.col("rep").cast("string").alias("rep"), "__t")
        .mapInPandas(full, "cls binary, rep string, shingles binary")
        .dropDuplicates(["cls"])  # an id of several rows
        .join(classes.select("cls", "sig", marks), "cls")
    )
    found = (
        likely.join(sets, "cls")
        .repartition(*_JOB)
        .sortWithinPartitions(*_JOB, "cls")
        .mapInPandas(_confirmed(similarity, floor), "ur string, u binary, vr string, v binary")
    )
    node = lambda r, c: F.struct(F.col(r).cast(docs.schema[doc_id].dataType).alias("rep"), F.col(c).alias("cls"))
    return written(found.select(node("ur", "u").alias("u"), node("vr", "v").alias("v")), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (u, v): the least node reachable."""

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        """Written, with the number of edges and a sum of their hashes, taken in the same pass."""
        seen = Observation()
        told = df.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"))
        out = written(told, name)
        return out, (seen.get["n"], seen.get["h"])

    edges, state = kept(links.where("u != v").distinct(), "edges")
    while state[0]:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree")), "stars")
        large = join_hot(both, least, ["u"], "degree", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its neighbours below go to the least of them
        large, told = kept(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "stars")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = join_hot(large, low, ["u"], "degree", told[0]).select(F.explode(pairs).alias("e")).select("e.*").where("u != v").distinct()
        edges, now = kept(small, "edges")
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (xxhash64 of the text), n_shingles, cls, component_id, kept."""
    members = written(signatures(docs, doc_id, text, size), "members")
    grouped = F.col("cls").isNotNull() & F.col("doc_id").isNotNull()
    classes = written(
        members.where(grouped)
        .groupBy("cls")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    joined = components(confirmed_links(docs, classes, doc_id, text, size, similarity))
    roots = joined.select(F.col("node.cls").alias("cls"), F.col("root.rep").alias("root"))
    named = written(
        classes.select("cls", "rep", "members").join(roots, "cls", "left").select("cls", "members", F.coalesce("root", "rep").alias("component_id")), "named"
    )
    rows = members.select("doc_id", "key", F.col("n").alias("n_shingles"), "cls")
    met = join_hot(rows.where(grouped), named, ["cls"], "members", rows.count()).drop("members")
    out = met.unionByName(rows.where(~grouped).withColumn("component_id", F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, by five-word shingles; rows go by id and text."""
    found = near_duplicates(docs)
    gone = written(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct(), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"))
    return rows.join(few(gone), (rows["__id"] == gone["__gone"]) & (rows["__key"] == gone["__gone_key"]), "left_anti").select("__row.*")


def oracle(size: int = 2) -> str:
    """DuckDB SQL by brute force: all pairs that share a shingle, links on full sets, reachability."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least({size}, len(w)) AS k, unnest(range(1, greatest(len(w) - {size}, 0) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
r AS (SELECT DISTINCT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m.y, d.doc_id) AS component_id, coalesce(m.y, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""
