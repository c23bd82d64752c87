"""Operator 2: benchmark decontamination by one Aho-Corasick automaton.

Normalised form of a text: A-Z lower-cased, words of ``WORD`` joined by single blanks, one blank at
either end. A benchmark item gives its windows of ``window`` consecutive words (an item of fewer
words, but not none, is one window). The automaton holds every distinct window with its blanks, so
that one scan of a normalised document finds all occurrences; ends of matches are mapped to words
and, for the spans, to offsets of the original text.

The automaton is built in the workers from broadcast windows. A block of items holds at most
``BLOCK_BYTES`` of windows, however large the benchmark is: beyond that the items are dealt to
several blocks and the corpus is scanned once for each, by tasks of their own, so a task holds one
automaton; what the scans find meets the documents by two hashes of the text.

Defined results: a null text or item has no words; equal items keep their own ids, repeated rows of
one item count once; a null item id marks words but is not listed; ids of any type; an empty
benchmark finds nothing; an empty documents table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, few, give_back, written

WINDOW = 10
#: Bytes of windows that one automaton holds.
BLOCK_BYTES = 24 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes: A-Z to a-z, ASCII letters and digits and all bytes beyond ASCII stay, the others are blanks.
_CLEAN = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

HITS = "n_words long, hit_words array<int>, item_ids array<{}>, spans array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_CLEAN).split()


def windows(item: list[bytes], window: int) -> Iterator[bytes]:
    n = min(window, len(item))
    for i in range(len(item) - n + 1 if item else 0):
        yield b" " + b" ".join(item[i : i + n]) + b" "


@functools.lru_cache(maxsize=2)
def _automaton(key: str):
    """Per worker: the automaton of a broadcast block; its values are (words, item numbers)."""
    import ahocorasick

    items, window = _BLOCKS[key].value
    owners: dict[bytes, set[int]] = defaultdict(set)
    for item_id, text in items:
        for w in windows(words(text), window):
            owners[w].add(item_id)
    auto = ahocorasick.Automaton()
    for w, ids in owners.items():
        auto.add_word(w.decode(), (w.count(b" ") - 1, tuple(sorted(i for i in ids if i is not None))))
    if owners:
        auto.make_automaton()
    return auto


#: Broadcasts that this worker has met, by the key of their scan.
_BLOCKS: dict = {}


def _automaton_of(key: str, shared):
    _BLOCKS[key] = shared
    return _automaton(key)


def _matches(text: str | None, auto, with_spans: bool):
    import numpy as np

    found = words(text)
    if not found or not len(auto):
        return len(found), [], [], []
    ends, ids = [], set()
    for end, (n, owners) in auto.iter((b" " + b" ".join(found) + b" ").decode()):
        ends.append((end, n))
        ids.update(owners)
    if not ends:
        return len(found), [], [], []
    # characters, not bytes: where the blank behind each word stands
    blanks = np.cumsum([len(w.decode()) + 1 for w in found])
    delta = np.zeros(len(found) + 1, np.int64)
    last = np.searchsorted(blanks, [e for e, _ in ends])
    np.add.at(delta, last + 1, -1)
    np.add.at(delta, last + 1 - np.array([n for _, n in ends]), 1)
    hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
    spans = []
    if with_spans:
        at = [m.span() for m in WORD.finditer(text.translate(_LOWER_STR))]
        cut = np.flatnonzero(np.diff(hit) > 1)
        for a, b in zip([hit[0], *hit[cut + 1]], [*hit[cut], hit[-1]]):
            spans.append({"start": at[a][0], "end": at[b][1]})
    return len(found), hit.tolist(), sorted(ids), spans


_LOWER_STR = {i: i + 32 for i in range(65, 91)}


def _finder(shared, window: int, with_spans: bool, schema: str):
    key = uuid.uuid4().hex

    @F.pandas_udf(schema)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        auto = _automaton_of(key, shared)
        for texts in batches:
            yield pd.DataFrame(
                [_matches(t, auto, with_spans) for t in texts], columns=["n_words", "hit_words", "item_ids", "spans"]
            )

    return find


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, window: int, most: int) -> Iterator[list]:
    """The items, in blocks of at most ``most`` bytes of windows, one block on the driver at a time."""
    items = benchmark.select(F.col(item_id).alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).where("t != ''")
    block, total = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        n = window * (len(r.t.encode()) + 2)
        if block and total + n > most:
            yield block
            block, total = [], 0
        block.append((r.i, r.t))
        total += n
    yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    with_spans: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted), spans (code points of the original text) and
    contaminated. Spans cover neighbouring hit words together."""
    sc = docs.sparkSession.sparkContext
    schema = HITS.format(benchmark.schema[item_id].dataType.simpleString())
    find = [_finder(sc.broadcast((block, window)), window, with_spans, schema) for block in item_blocks(benchmark, item_id, item_text, window, block_bytes)]
    if len(find) == 1:
        out = docs.withColumn("__hits", find[0](F.col(text)))
    else:
        # a scan of its own for each block: a task holds one automaton; what it finds depends on the text alone
        key = [F.xxhash64(F.lit(k), F.coalesce(text, F.lit(""))).alias(f"__key{k}") for k in (0, 1)]
        keys = ["__key0", "__key1"]
        found = None
        for f in find:
            part = docs.select(*key, f(F.col(text)).alias("h")).where(F.size("h.hit_words") > 0)
            found = part if found is None else found.unionByName(part)
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"h.{c}")))).alias(f"__{c}")
        found = written(found.groupBy(*keys).agg(*[union(c) for c in ("hit_words", "item_ids", "spans")]), "hits")
        met = docs.withColumns(dict(zip(keys, key))).join(few(found), keys, "left")
        words_of = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
        none = lambda c: F.coalesce(c, F.array())
        made = F.struct(words_of.cast("long").alias("n_words"), *[none(f"__{c}").alias(c) for c in ("hit_words", "item_ids", "spans")])
        out = met.withColumn("__hits", made).drop(*keys, "__hit_words", "__item_ids", "__spans")
    return out.withColumns(
        {
            "n_words": F.col("__hits.n_words"),
            "n_hit": F.size("__hits.hit_words").cast("long"),
            "item_ids": F.array_sort("__hits.item_ids"),
            "spans": F.array_sort("__hits.spans"),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0).drop("__hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kind) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; the columns stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("text"))  # no column of a document meets one of a hit
    return benchmark_hits(rows, benchmark, with_spans=False, **kind).where(~F.col("contaminated")).select("__row.*")


def hits_digest(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return hits.select(
        doc_id,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM bp),
ks AS (SELECT DISTINCT k FROM bw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM dp),
m AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
