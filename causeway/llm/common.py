"""What the operators share: reading, the shared folder, batches and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold; texts are long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Up to this many rows of a name and a number or two go to every executor; more are joined by a shuffle.
FEW_ROWS = 250_000

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with the named columns only."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds an Arrow batch, so that a Python worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may go without: it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="causeway-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there.

    ``batch_rows`` holds for the Arrow batches of this write; rows of a few
    numbers travel better in large ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark, batch_rows)
    df.write.parquet(path)
    small_batches(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_name() -> Column:
    """128 bits that name a row by its ``doc_id`` and ``text`` (null: empty)."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")))


def few_rows(rows: DataFrame, few: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Joins a large table with a written one that is mostly small: broadcast if its count allows, else shuffled."""
    return rows.join(F.broadcast(few) if few.count() <= FEW_ROWS else few, on, how)


def rows_of(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of the named columns."""
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema that answers to a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Gathers tuples into Arrow batches of at most ``size`` rows."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)


def map_rows(df: DataFrame, function, ddl: str, size: int = BATCH_ROWS) -> DataFrame:
    """``function`` maps an iterator of Arrow batches to tuples of ``ddl``."""
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda batches: batches_of(function(batches), schema, size), ddl)


def sliced(df: DataFrame, key: str = "doc_id", neighbours: bool = False, slices: int | None = None) -> DataFrame:
    """Deals rows to ascending slices of a long ``key`` (nulls first), sorted within each.

    Adds ``slice`` int and ``borrowed`` boolean. There are two slices a shuffle
    partition unless ``slices`` says otherwise; their bounds are approximate
    quantiles of all keys. With ``neighbours`` each slice also holds, marked
    ``borrowed``, the first row of the next slice that has rows (the last slice:
    the very first row). Only one bound and one key a slice reach the driver.
    """
    n = slices or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(key).cast("long").alias(key))
    found = keys.approxQuantile(key, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = np.array(sorted({int(x) for x in found}), dtype=np.int64)

    def slices_of(column: pa.Array) -> np.ndarray:
        ids = column.cast(pa.int64())
        at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
        at[ids.is_null().to_numpy(zero_copy_only=False)] = 0
        return at

    def only_slices(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slices_of(b.column(0))), b.column(0)], ["slice", "k"])

    heads: list[tuple[int, int | None]] = []  # (slice that borrows, key of the row it borrows)
    if neighbours:
        # A slice may hold null keys only in slice 0, where they come first.
        firsts = {r["slice"]: None if r["nulls"] else r["k"] for r in keys.mapInArrow(only_slices, "slice int, k long").groupBy("slice").agg(F.min("k").alias("k"), F.count_if(F.col("k").isNull()).alias("nulls")).collect()}
        have = sorted(firsts)
        heads = [(have[i - 1], firsts[s]) for i, s in enumerate(have)]
    lent = pa.array([k for _, k in heads if k is not None], pa.int64())
    nulls_lent = any(k is None for _, k in heads)
    names, where = df.columns, df.columns.index(key)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", slice int, borrowed boolean"

    def deal(batches):
        for b in batches:
            at = slices_of(b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(np.zeros(len(at), bool))], [*names, "slice", "borrowed"])
            ids = b.column(where).cast(pa.int64())
            if not pc.any(pc.is_in(ids, value_set=lent)).as_py() and not (nulls_lent and ids.null_count):
                continue
            for to, k in heads:
                hit = ids.is_null() if k is None else pc.fill_null(pc.equal(ids, k), False)
                if hit.true_count:
                    few = b.filter(hit)
                    yield pa.RecordBatch.from_arrays([*few.columns, pa.array(np.full(few.num_rows, to, np.int32)), pa.array(np.ones(few.num_rows, bool))], [*names, "slice", "borrowed"])

    order = [F.col("slice"), F.col("borrowed"), F.col(key).asc_nulls_first(), *(F.col(c) for c in names if c != key)]
    return df.mapInArrow(deal, ddl).repartition(n, "slice").sortWithinPartitions(*order)
