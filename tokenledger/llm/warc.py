"""Operator 4: WARC archives, index first.

Writing: each task writes its records, one gzip member each, to archives of its own name in the
shared folder, and returns the index of what it wrote: file, offset, length, URL, payload digest,
kind. The index is a table of the attempts that succeeded; archives of lost attempts are in no
index. Reading: records are selected on the index, sorted by file and offset and coalesced to byte
ranges (gaps of at most ``GAP``, ranges of about ``RANGE``); a task reads whole ranges.

Equal payloads of at least ``min_bytes`` are stored once: the record of the largest page_id is the
response, the others are revisits that refer to it. Digests that hold more than a thousandth of all
rows, of which there are fewer than a thousand, meet their response by broadcast; the others by a
shuffle.

Defined results: an empty table gives an empty result; a null payload is empty; ids may hold any characters; a null page_id counts as the smallest; rows that repeat
the response's own page_id and payload are responses too; extra columns stay out of the archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import scratch, written

#: An archive is closed beyond so many bytes.
ARCHIVE = 1 << 30
GAP, RANGE = 64 << 10, 8 << 20
#: Archive bytes that a task reads back, about.
TASK = 64 << 20
#: Share of all rows from which on a digest is met by broadcast.
HOT_SHARE = 1000
LEVEL = 1

INDEX = "file string, offset long, length long, page_id string, url string, digest string, record_type string, refers_to string, payload_bytes long"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload string, intact boolean"


def _urn(page_id: str | None) -> str:
    """Ids of any characters stand in a header percent-encoded; a null id is a name without one."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id, safe='', errors='replace')}>"


def _id_of(urn: str | None) -> str | None:
    return None if urn in (None, "<urn:page>") else unquote(urn[len("<urn:page:") : -1])


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> tuple[bytes, str]:
    """An uncompressed WARC record and the digest of its payload; ``refers_to`` makes it a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    target = re.sub(r"[\r\n]", " ", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """A record's fields from its uncompressed bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    same = True
    if not revisit:  # a revisit's payload stands elsewhere
        told, digest = (digest, size), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same, size = told == (digest, len(payload)), len(payload)
    return {
        "page_id": _id_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": _id_of(fields.get("WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": None if revisit else payload.decode("utf-8", "replace"),
        "intact": same,
    }


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_responses(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload) with refers_to: the page whose record holds the payload, null for that one."""
    sized = pages.withColumns({"__digest": F.sha1(F.col("payload").cast("binary")), "__size": F.octet_length("payload")})
    groups = (
        sized.where(F.col("__size") >= min_bytes)
        .groupBy("__digest")
        .agg(F.count("*").alias("__n"), F.max("page_id").alias("__response"))
        .where("__n > 1")
    )
    groups = written(groups, "payload-groups")
    hot = pages.count() // HOT_SHARE + 1
    few = groups.where(F.col("__n") > hot).select("__digest", F.col("__response").alias("__hot"))  # fewer than HOT_SHARE rows
    rest = groups.where(F.col("__n") <= hot).select(F.col("__digest").alias("__key"), "__response")
    met = sized.join(F.broadcast(few), "__digest", "left")
    # a page that has its response already takes a key that meets nothing, and no two the same
    open_ = F.col("__hot").isNull() & (F.col("__size") >= min_bytes)
    other_key = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    met = met.withColumn("__key", F.when(open_, F.col("__digest")).otherwise(other_key))
    met = met.join(rest.hint("shuffle_hash"), "__key", "left")
    held = F.coalesce("__hot", "__response")
    other = held.isNotNull() & ~F.col("page_id").eqNullSafe(held)
    return met.select("page_id", "url", "payload", F.when(other, held).alias("refers_to"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per row and returns the written index."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = with_responses(named, min_bytes).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for i, u, p, r in batch.itertuples(index=False, name=None):
                    if out is None or at > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = p.encode("utf-8", "replace")
                    raw, digest = record(i, u, data, r)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    index.append((f"{folder}/{name}", at, len(member), i, u, digest, "response" if r is None else "revisit", r, len(data)))
                    at += len(member)
                yield pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInPandas(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records that rows of the index name, by coalesced byte ranges."""
    in_file = W.partitionBy("file").orderBy("offset", "length")
    end = F.col("offset") + F.col("length")
    ranges = (
        index.select("file", "offset", "length")
        .distinct()
        .withColumn("jump", F.coalesce((F.col("offset") - F.lag(end).over(in_file) > gap).cast("int"), F.lit(1)))
        .withColumn("stretch", F.sum("jump").over(in_file))
        .withColumn("part", F.floor(F.col("offset") / most))
        .groupBy("file", "stretch", "part")
        .agg(
            F.min("offset").alias("lo"),
            F.max(end).alias("hi"),
            F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
        .select("file", "lo", "hi", "records")
    )

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, lo, hi, records in batch.itertuples(index=False, name=None):
                store, path = _store(file)
                with store.open_input_file(path) as f:
                    f.seek(lo)
                    data = f.read(hi - lo)
                rows = [parse(zlib.decompress(data[r["offset"] - lo : r["offset"] - lo + r["length"]], 31)) for r in records]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    # tasks by bytes of the archives, not of the index
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    return ranges.repartition(int(tasks), "file", "lo").mapInPandas(fetch, RECORD)


def archived(pages: DataFrame, page_id: str = "page_id", **kind) -> DataFrame:
    """Every page's record, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload read; one that is not what its header says fails the job."""
    back = read_records(write_archives(pages, page_id, **kind))
    back = back.withColumn("record_type", F.when(F.col("intact"), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce("page_id", F.lit("null"))))))
    number = pages.schema[page_id].dataType
    return back.select(
        F.col("page_id").cast(number).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(number).alias("refers_to"),
    )


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(p.h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
