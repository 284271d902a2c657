"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: One row in this many, by the checksum of doc_id, is held out from learning.
FOLDS = 5
#: Bytes of text that are learnt from at most, whatever the number of documents.
SAMPLE_BYTES = 32 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, label, text) of at most ``bound`` labelled documents that are not held out.

    Which ones is decided by a hash of doc_id; in that order they count as long
    as their texts come to ``most_bytes`` at most. Only ``bound`` ids are broadcast.
    Of several labels the smallest counts, and of several texts of one doc_id
    that with the smallest hash, so that repeated rows do not exceed the bound.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(found, "training-sample")
    # At most ``bound`` rows of two numbers are summed up in one task.
    so_far = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    kept = found.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= most_bytes).select("doc_id")
    return found.join(F.broadcast(kept), "doc_id", "left_semi")
