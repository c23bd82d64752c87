"""Operator 13: fill-in-the-middle transformation of whole texts.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). Two cuts between units, told by a hash of the document's key, make a prefix, a middle
and a suffix, which are put in another order behind sentinels: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle. Texts that are empty, hold a sentinel or are not drawn stay as they are (``plain``).

Cuts are found by a Fenwick tree over blocks of ``BLOCK`` bytes, which stores each block's units and code points: a binary-lifting descent
finds the block in which a unit ends and the code points before it, then the place is looked up inside that one block. An Arrow function
returns the two places only; texts are put together and taken apart by column functions.

Defined results: a null text is the empty text (0 units, plain); a null key hashes as the empty text; a line end alone is a unit, ``\\r`` is
none; repeated rows of one key get the same cuts; extra columns are kept, a column of the name of a result is replaced; an empty table gives
an empty result. A task holds an Arrow batch of texts and the counts of one text's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import session_ready

#: Bytes of text a block has.
BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50


class LineIndex:
    """Lines and code points of a UTF-8 text by blocks, in a Fenwick tree of both counts."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, np.uint8), block
        starts = np.arange(0, len(data), block)
        self.blocks = len(starts)
        each = np.zeros((self.blocks + 1, 2), np.int64)
        if self.blocks:
            each[1:, 0] = np.add.reduceat(self.data == 10, starts, dtype=np.int64)
            each[1:, 1] = np.add.reduceat((self.data & 0xC0) != 0x80, starts, dtype=np.int64)
        sums = each.cumsum(axis=0)
        self.ends, self.points = int(sums[-1, 0]), int(sums[-1, 1])
        # node i holds the counts of the blocks (i - lowbit(i), i]
        i = np.arange(self.blocks + 1)
        self.tree = (sums - sums[i - (i & -i)]).tolist()
        self.units = self.ends + (len(data) > 0 and data[-1] != 10)

    def place(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units <= 0:
            return 0
        if units > self.ends:  # the last line has no end
            return self.points
        at, left, points = 0, units, 0
        step = 1 << self.blocks.bit_length()
        while step:
            if at + step <= self.blocks and self.tree[at + step][0] < left:
                at += step
                left -= self.tree[at][0]
                points += self.tree[at][1]
            step >>= 1
        own = self.data[at * self.block : (at + 1) * self.block]
        end = int(np.flatnonzero(own == 10)[left - 1]) + 1
        return points + int(((own[:end] & 0xC0) != 0x80).sum())


def cuts():
    """An Arrow function from a text and two numbers to its units and the code points before both cuts."""

    @F.arrow_udf("struct<units:long,first:long,second:long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            out = []
            for text, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
                index = LineIndex(text.as_buffer().to_pybytes())
                lo, hi = sorted((a % (index.units + 1), b % (index.units + 1)))
                out.append((index.units, index.place(lo), index.place(hi)))
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["units", "first", "second"])

    return cut


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned integers of 32 bits that stand for a key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; ``rate`` per cent of all texts are cut, ``spm`` per cent of these suffix first."""
    session_ready(docs.sparkSession)
    said = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(key), seed)
    rows = docs.withColumn("__cut", cuts()(said, h[0], h[1]))
    plain = (said == "") | (h[2] % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | said.contains(mark)
    first, second = F.col("__cut.first"), F.col("__cut.second")
    before, middle = F.substr(said, F.lit(1), first), F.substr(said, first + 1, second - first)
    after = F.substr(said, second + 1)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    whole = (
        F.when(form == "plain", said)
        .when(form == "psm", F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle))
    )
    made = {"n": F.col("__cut.units"), "form": form, "prefix_chars": F.when(~plain, first), "middle_chars": F.when(~plain, second - first), "output": whole}
    return rows.withColumns({f"__{k}": v for k, v in made.items()}).drop("__cut", *made).withColumnsRenamed({f"__{k}": k for k in made})


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transformed`` was made of. No part holds a sentinel, and none arises where a part meets one."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    body = F.substr(output, F.lit(4))
    psm = F.concat(part(body, SUFFIX, 1), part(part(body, SUFFIX, 2), MIDDLE, 2), part(part(body, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(body, PREFIX, 2), MIDDLE, 1), part(part(body, PREFIX, 2), MIDDLE, 2), part(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transformed_digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    sha = lambda c: F.sha2(c, 256)
    return rows.select(
        F.col(key).alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') END AS lines, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
p AS (SELECT doc_id, n, t, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
