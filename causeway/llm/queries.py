"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import lines, mixing, pieces, quality, simhash, spotsigs, suffixes, tiff, toxicity, wavelet
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.query(documents(spark, sf_dir, "doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by the line classifier; null and empty texts too."""
    return quality.query(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text by the regularised classifier; null and empty texts too."""
    return toxicity.query(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF that is written, read back and described."""
    return tiff.query(documents(spark, sf_dir, "doc_id", "text"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to it and to the next one's."""
    return spotsigs.query(documents(spark, sf_dir, "doc_id", "text"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read from the shard files."""
    return wavelet.query(documents(spark, sf_dir, "doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.query(documents(spark, sf_dir, "doc_id", "source", "text"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that go of every text, the checksum of the rest, and words in repeated passages."""
    return suffixes.query(documents(spark, sf_dir, "doc_id", "text"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that leave every document, and the checksum of the rest."""
    return lines.query(documents(spark, sf_dir, "doc_id", "text"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, described, and the text that they decode to."""
    return pieces.query(documents(spark, sf_dir, "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_wavelet": op3_wavelet,
        "op4_toxicity": op4_toxicity,
        "op5_tiff": op5_tiff,
        "op6_spotsigs": op6_spotsigs,
        "op7_mixing": op7_mixing,
        "op8_suffixes": op8_suffixes,
        "op9_lines": op9_lines,
        "op10_pieces": op10_pieces,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {}
