"""Operator 12: alignment of the tokens of two vocabularies over the same texts.

Both vocabularies encode a text behind one added blank; a token covers a range of the bytes. Documents are aligned batch by batch with
``pandas.merge_asof``, keyed by document: the start of each token of one side finds the covering token of the other side, the last that
starts at or before it. Both directions together are all pairs of tokens whose ranges overlap, since of two such tokens one starts inside
the other. Where tokens of both sides end at one byte, a group ends.

What comes out of a batch is the groups as text and, per document, each distinct pair of linked ids with its count. Counts of pairs over all
documents are summed by Spark, with partial sums before the shuffle; the table of pairs meets the documents' pairs by broadcast if it has at
most ``BROADCAST_ROWS`` rows, else by a shuffle in which pairs of very many documents are met by broadcast.

Defined results: a text that is null or empty, or that either vocabulary does not give back byte by byte (a normalizing model, U+2581, an
unknown character), has no tokens: zeros and an empty text of groups. Repeated rows are rows each; extra columns are ignored; an empty
table gives an empty result. A task holds about ``CHUNK_BYTES`` of text at a time with its tokens; a longer text is encoded whole and
aligned in parts that end where tokens of both sides end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, byte_runs, join_hot, session_ready, sizes, written
from .tokens import piece_units, units, vocabulary_path

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at a time.
CHUNK_BYTES = 1 << 20
#: A pair of ids is one number: the first id times this, and the second.
PAIR = 1 << 32
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<int>"


class Aligner:
    """Both vocabularies of a Python worker, with the bytes and the written forms of their ids."""

    def __init__(self, first: str, second: str):
        self.a, self.b = units(first, plain_specials=True), piece_units(second)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # by id: what follows a token inside its group's side, and at the end of it
        self.text_a = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
        self.text_b = [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, or None for texts that one side does not give back."""
        out = []
        for text, x, y in zip(texts, self.a.ids([" " + t if t else "" for t in texts]), self.b.ids(texts)):
            ids = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            whole = (" " + text).encode("utf-8", "replace")
            same = all(b"".join(map(table.__getitem__, i.tolist())) == whole for i, table in zip(ids, (self.bytes_a, self.bytes_b)))
            out.append(ids if text and same else None)
        return out

    def parts(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, ids, ids): whole texts, long ones cut at common ends."""
        for k, ids in enumerate(self.encoded(texts)):
            if ids is None:
                continue
            a, b = ids
            ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
            if ends_a[-1] <= 2 * CHUNK_BYTES:
                yield k, a, b
                continue
            common = np.intersect1d(ends_a, ends_b, assume_unique=True)
            wanted = np.searchsorted(common, np.arange(CHUNK_BYTES, ends_a[-1], CHUNK_BYTES))
            cuts = np.unique([0, *common[wanted], ends_a[-1]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield k, a[np.searchsorted(ends_a, lo, "right") : np.searchsorted(ends_a, hi, "right")], b[np.searchsorted(ends_b, lo, "right") : np.searchsorted(ends_b, hi, "right")]

    def aligned(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        """(text, n_a, n_b, n_groups, n_links, groups, pairs, pair_links) of each part."""
        doc_a, doc_b = (np.repeat(np.arange(len(parts)), [len(p[k]) for p in parts]) for k in (1, 2))
        a, b = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
        ends_a, ends_b = self.len_a[a].cumsum(), self.len_b[b].cumsum()
        side_a = pd.DataFrame({"start": ends_a - self.len_a[a], "doc": doc_a, "a": np.arange(len(a))})
        side_b = pd.DataFrame({"start": ends_b - self.len_b[b], "doc": doc_b, "b": np.arange(len(b))})
        # the starts of one side and the tokens of the other that cover them; equal starts are met in both directions
        by_a = pd.merge_asof(side_a, side_b, on="start", by="doc")
        by_b = pd.merge_asof(side_b, side_a, on="start", by="doc")
        by_b = by_b[side_a["start"].to_numpy()[by_b["a"].to_numpy()] != by_b["start"].to_numpy()]
        link_a, link_b = (np.concatenate([by_a[c].to_numpy(), by_b[c].to_numpy()]) for c in "ab")
        # distinct pairs of a document
        n_ids = len(self.bytes_b)
        code = (doc_a[link_a] * len(self.bytes_a) + a[link_a]) * n_ids + b[link_b]
        code, links = np.unique(code, return_counts=True)
        pair_doc, pair_a, pair_b = code // n_ids // len(self.bytes_a), code // n_ids % len(self.bytes_a), code % n_ids
        bounds = np.searchsorted(pair_doc, np.arange(len(parts) + 1))
        n_links = np.bincount(doc_a[link_a], minlength=len(parts))
        # groups: tokens of both sides up to a common end
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written_a = list(map(self.text_a.__getitem__, (2 * a + last_a).tolist()))
        written_b = list(map(self.text_b.__getitem__, (2 * b + last_b).tolist()))
        told = np.array(written_a + written_b, dtype=object)[order]
        n_groups = np.bincount(doc_a[last_a], minlength=len(parts))
        at = 0
        for k, (text, ids_a, ids_b) in enumerate(parts):
            n = len(ids_a) + len(ids_b)
            mine = slice(bounds[k], bounds[k + 1])
            yield text, len(ids_a), len(ids_b), int(n_groups[k]), int(n_links[k]), "".join(told[at : at + n])[:-1], pair_a[mine] * PAIR + pair_b[mine], links[mine]
            at += n

    def __call__(self, texts: list[str]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups, pairs, pair_links of each text."""
        found: dict[int, list[tuple]] = {}
        parts, held = [], 0

        def flush() -> None:
            for k, *rest in self.aligned(parts) if parts else ():
                found.setdefault(k, []).append(rest)
            parts.clear()

        for part in self.parts(texts):
            parts.append(part)
            held += len(part[1]) + len(part[2])
            if held > CHUNK_BYTES:
                flush()
                held = 0
        flush()
        out = []
        for k in range(len(texts)):
            own = found.get(k, [])
            pairs = [np.concatenate([x[c] for x in own]) if own else np.zeros(0, np.int64) for c in (5, 6)]
            out.append((*[sum(x[c] for x in own) for c in range(4)], ";".join(x[4] for x in own), *pairs))
        return out


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """The key and ``ALIGNED`` of each row: token counts, groups ``a1,a2|b1;a3|b2,b3`` by ids, links, and distinct linked pairs with counts."""
    session_ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary_path(first), vocabulary_path(second))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in byte_runs(sizes(texts), CHUNK_BYTES):
                got = list(zip(*aligner(texts[lo:hi])))
                numbers = [pa.array(x, pa.int64()) for x in got[:4]]
                ends = pa.array(np.cumsum([0, *map(len, got[5])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((got[5], pa.int64()), (got[6], pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *numbers, pa.array(got[4], pa.string()), *lists], ["key", *(c.split()[0] for c in ALIGNED.split(", "))])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {ALIGNED}").withColumnRenamed("key", key)


def with_pair_counts(rows: DataFrame) -> DataFrame:
    """Rows of ``aligned`` with n_best (links whose pair has its second id's highest count over all rows, ties included) and count_sum (of the
    counts of all links' pairs). ``rows`` are written once; ``pairs`` and ``pair_links`` go."""
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    each = rows.select("__row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("__row", F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("k"))
    totals = written(each.groupBy("pair").agg(F.sum("k").alias("links"), F.count("*").alias("holders")), "pairs")
    second = F.col("pair") % PAIR
    tops = totals.groupBy(second.alias("b")).agg(F.max("links").alias("top"))
    table = written(totals.join(tops, second == F.col("b")).select("pair", "links", "holders", (F.col("links") == F.col("top")).alias("best")), "pair-table")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = each.join(F.broadcast(table), "pair")
    else:
        met = join_hot(each, table, ["pair"], "holders", table.agg(F.sum("holders")).first()[0])
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("links")).alias("count_sum"))
    out = rows.drop("pairs", "pair_links").join(sums, "__row", "left").drop("__row")
    return out.na.fill(0, ["n_best", "count_sum"])


def alignment_digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = with_pair_counts(rows.withColumn("groups_sha256", digest).drop("groups"))
    return out.select(F.col(key).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
