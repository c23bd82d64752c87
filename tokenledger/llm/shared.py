"""What several corpus operators share: the scratch folder, written stages and text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step inside a Python task takes at a time.
CHUNK_BYTES = 4 << 20

#: Rows of a few columns that may be broadcast.
BROADCAST_ROWS = 500_000
#: Share of all rows from which on a key is met by broadcast.
HOT_SHARE = 2000

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def session_ready(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokenledger-")
        base = "file://" + base
    # results are read from here lazily, so nothing is deleted while the application runs; its folder can go when it has ended
    return f"{base.rstrip('/')}/tokenledger/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read again: a cut in the lineage
    that outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it behind more underscores, as no column of ``df`` is called, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """What a Python worker has freed goes back to the system: workers live on from stage to stage, and a next one loads tables of its own."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries do without
    if trim is not None:
        trim(0)


def byte_runs(sizes: Sequence[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to about ``most``; a larger item is a range of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def sizes(texts: Iterable[str | None]) -> list[int]:
    """UTF-8 bytes of each text."""
    return [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written ``table`` of short rows as the small side of a join: broadcast if it has at most ``rows`` rows, hashed by a shuffle beyond that."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("shuffle_hash")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` and the columns of ``table``, which has one row per key and says in ``count`` how many rows have it.

    Keys that more than 1/HOT_SHARE of all ``total`` rows have, of which there are fewer than HOT_SHARE,
    meet the table by broadcast; all others by a shuffle, in which no key is frequent. Both are written tables.
    """
    most = total // HOT_SHARE
    hot = table.where(F.col(count) > most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(table.where(F.col(count) <= most), keys))


def tree_summed(parts: DataFrame, dtype, fan: int = 32) -> dict[int, np.ndarray]:
    """The sums, by block, of rows (block, part, sums: bytes of ``dtype``), of which each block has one per task at most.

    Parts are added ``fan`` at a time, level by level, so no group holds the parts of all tasks; only the last sums, one a block, reach
    the driver. The number of blocks has to be fixed."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = np.zeros(1)
        for x in rows["sums"]:
            total = total + np.frombuffer(zlib.decompress(x), dtype)
        return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1] // fan, "sums": [zlib.compress(total.astype(dtype).tobytes(), 1)]})

    parts = written(parts, "sums")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = parts.groupBy("block", F.floor(F.col("part") / fan).alias("of")).applyInPandas(lambda rows: merged(rows), "block int, part int, sums binary")
        most //= fan
    return {r["block"]: np.frombuffer(zlib.decompress(bytes(r["sums"])), dtype) for r in parts.collect()}


def packed_sums(sums: np.ndarray, blocks: int) -> pd.DataFrame:
    """A task's rows for ``tree_summed``: ``sums`` cut into equal blocks."""
    from pyspark import TaskContext

    own = sums.reshape(blocks, -1)
    return pd.DataFrame({"block": range(blocks), "part": [TaskContext.get().partitionId()] * blocks, "sums": [zlib.compress(x.tobytes(), 1) for x in own]})


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    session_ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
