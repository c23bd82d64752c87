"""The registered queries of the corpus operators: each over its whole table, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontamination, fill_in_middle, line_dedup, near_dedup, secrets, warc
from .decontamination import benchmark_hits, hits_digest
from .line_dedup import dedup_lines, lines_digest
from .lm_scoring import lm_scores
from .near_dedup import near_duplicates
from .neighbours import nearest
from .packing import pack
from .quality import fit_quality, held_out, quality_scores
from .secrets import secret_spans, secrets_digest
from .shared import read
from .token_counts import token_counts
from .warc import archived


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return hits_digest(benchmark_hits(docs, read(spark, sf_dir, "benchmark")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_digest(dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table is an event of the log, a whole message; the planted conversation's log has edits and streamed parts."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
    return chat_format.chat_digest(chat_format.formatted(chat_format.messages(rows.unionByName(chat_format.planted(spark)))))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(alignment.aligned(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transformed_digest(fill_in_middle.transformed(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_lm_scores": op9_lm_scores,
    "op10_line_dedup": op10_line_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op4_warc": warc.ORACLE,
    "op7_near_dedup": near_dedup.oracle(),
    "op10_line_dedup": line_dedup.ORACLE,
    "op2_decontamination": decontamination.ORACLE,
    "op6_secret_scan": secrets.oracle(),
    "op11_chat_format": chat_format.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
