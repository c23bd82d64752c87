"""Operator 5: best-fit packing by exact-complement hashing.

Every document is tokenized once; only documents longer than ``size`` are cut, the first piece
being the shorter one. What decides a plan is how many pieces there are of each length, a table of
at most ``size`` rows whatever the corpus; only that table reaches the driver. The plan says how
often which lengths share a sequence:

1. pieces of the full size stand alone;
2. exact complements: sums of single, pair and triple lengths are indexed by hash, and the longest
   open length takes a combination that fills its gap exactly, as often as the counts allow;
3. what is left goes by best fit: the longest piece opens a sequence, and the longest that still
   fits follows, until none fits.

The plan's slots then meet the pieces by (length, rank among the pieces of that length), a join.
Ranks come from salted groups with offsets, as many as a length has pieces for, so one length may
hold any share of all pieces.

Defined results: a null text is an empty document and still has its closing id; repeated rows are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import byte_runs, give_back, sizes, written
from .tokens import units, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
SIZE = 2048
END_ID = 0
#: Pieces of one length that are ranked together, about.
RANKED = 1 << 20

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def _pieces(ids: bytes, size: int) -> list[dict]:
    n = len(ids) // 4
    first = (n - 1) % size + 1
    cuts = [0, *range(first, n + 1, size)]
    return [
        {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def token_pieces(docs: DataFrame, text: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """``docs`` with a row for each piece: piece, start, length, ids_crc32."""

    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        tok = units(vocabulary_path(vocabulary))
        end = end_id.to_bytes(4, "little")
        kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out = []
            for lo, hi in byte_runs(sizes(texts)):
                out += [_pieces(ids + end, size) for ids in tok.ids(texts[lo:hi])]
            yield pa.array(out, kind)

    return docs.withColumn("__p", F.explode(cut(F.col(text)))).select(
        *[c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32")], "__p.*"
    )


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, how many such sequences), using up ``counts`` exactly."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for n in combo:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((combo, times))

    def held(combo: tuple[int, ...]) -> bool:
        return all(left.get(n, 0) >= combo.count(n) for n in combo)

    if size in left:
        take((size,))
    # sums of pairs, hashed once; a combination that has run out is skipped when met
    lengths = sorted(left)
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, a in enumerate(lengths):
        for b in lengths[i:]:
            if a + b >= size:
                break
            pairs[a + b].append((a, b))

    def pair(gap: int, longest: int) -> tuple[int, int] | None:
        found = pairs.get(gap, [])
        while found:
            if (p := found[-1])[0] in left and p[1] in left and (p[0] != p[1] or left[p[0]] > 1):
                if longest in p and not held((longest, *p)):
                    return next((q for q in reversed(found) if held((longest, *q))), None)
                return p
            found.pop()  # counts only fall: it never comes back
        return None

    for longest in sorted(left, reverse=True):
        while longest in left:
            gap = size - longest
            if held((longest, gap)):
                take((longest, gap))
            elif p := pair(gap, longest):
                take((longest, *p))
            else:
                triple = None
                for c in sorted((n for n in left if n < gap), reverse=True):
                    if (p := pair(gap - c, longest)) and held((longest, c, *p)):
                        triple = (longest, c, *p)
                        break
                if not triple:
                    break
                take(triple)
    # best fit of the residual lengths, many equal sequences at a time
    import bisect

    rest = sorted(left)
    while rest:
        combo, gap = [], size
        spare = dict.fromkeys(rest, 0)
        while (k := bisect.bisect_right(rest, gap)) > 0:
            while k and left[rest[k - 1]] <= spare[rest[k - 1]]:
                k -= 1
            if not k:
                break
            combo.append(rest[k - 1])
            spare[rest[k - 1]] += 1
            gap -= rest[k - 1]
        take(tuple(combo))
        rest = [n for n in rest if n in left]
    return out


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    size: int = SIZE,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", vocabulary, size, end_id), "pieces")
    # a piece of the full size is a sequence of its own and needs no rank
    full = pieces.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    pieces = pieces.where(F.col("length") < size)
    salts = pieces.groupBy("length").agg(F.ceil(F.count("*") / RANKED).cast("int").alias("salts"))  # a row per length
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    groups = salted.groupBy("length", "salt").count().collect()  # a row per length and RANKED pieces
    counts: dict[int, int] = defaultdict(int)
    bases = []
    for r in sorted(groups):
        bases.append((r["length"], r["salt"], counts[r["length"]]))
        counts[r["length"]] += r["count"]
    base = spark.createDataFrame(bases, "length long, salt int, base long")
    slots, sequences = [], 0
    used: dict[int, int] = defaultdict(int)
    for combo, times in plan(dict(counts), size):
        at = 0
        for n in combo:
            slots.append((n, used[n], used[n] + times, sequences - used[n], at))
            used[n] += times
            at += n
        sequences += times
    # slots of a length by ascending rank; a piece's slot is the last one that starts at or below its rank
    table: dict[int, list] = defaultdict(list)
    for n, lo, _, shift, at in slots:
        table[n].append((lo, shift, at))
    slot = spark.createDataFrame(
        [(n, lo, shift, at) for n, rows in table.items() for lo, shift, at in rows], "length long, rank long, shift long, offset long"
    )
    ranked = (
        salted.withColumn("in_salt", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
        .join(F.broadcast(base), ["length", "salt"])  # as many rows as groups
        .withColumn("rank", F.col("base") + F.col("in_salt"))
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed(ranked, slot).select(*columns).unionByName(full.select(*columns))


def placed(ranked: DataFrame, slot: DataFrame) -> DataFrame:
    """Each piece's slot: the plan as one row per length, searched by the piece's rank.

    Every step of the plan leaves of some length less than it takes at once, so there are a few thousand kinds of sequences, and the
    table is bounded by the plan and not by the corpus.
    """
    by_length = slot.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "shift", "offset"))).alias("slots"))
    found = ranked.join(F.broadcast(by_length), "length")
    # how many slots start at or below the rank: a binary search over the sorted array
    steps = F.sequence(F.lit(1), F.lit(24))
    pair = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("lo"), F.size("slots").alias("hi")),
        lambda s, _: F.when(s["hi"] - s["lo"] <= 1, s).otherwise(
            F.when(
                F.get(F.col("slots"), F.floor((s["lo"] + s["hi"]) / 2).cast("int"))["rank"] <= F.col("rank"),
                F.struct(F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("lo"), s["hi"].alias("hi")),
            ).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
        ),
    )
    return (
        found.withColumn("__slot", F.get(F.col("slots"), pair["lo"]))
        .withColumn("sequence_id", F.col("rank") + F.col("__slot.shift"))
        .withColumn("offset", F.col("__slot.offset"))
    )
