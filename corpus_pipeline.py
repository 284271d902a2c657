"""A training corpus from the documents table, in five stages.

Each stage works on all rows that the one before kept, and its decisions take
effect: rejected documents go, shared lines leave the later document, one
document of each near-duplicate group stays, sources are mixed to their target
weights, and texts become ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import lines, mixing, pieces, quality, simhash
from causeway.llm.common import few_rows, map_rows, row_name, rows_of, small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold.

    Null and empty texts have the score of an empty line; repeated rows stay or
    go together; with labels of one kind only nothing is rejected. An empty table
    gives no rows; columns beyond those of documents are dropped.
    """
    small_batches(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, "_score").where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks that an earlier document has; what lost all its text goes.

    Null and empty texts stay as they are; repeated rows are one document and
    stay alike; of equal doc_ids the text with the least digest is the earlier.
    An empty table gives no rows; columns beyond those of documents are dropped.
    """
    small_batches(spark)

    def cut(batches):
        for doc, text, lang, source, n, gone in rows_of(batches, *COLUMNS, "gone"):
            if not gone:
                yield doc, text, lang, source, n
            elif (rest := lines.kept_text(text, gone)).strip():
                yield doc, rest, lang, source, len(rest)

    return map_rows(lines.without_shared(docs.select(*COLUMNS)), cut, "doc_id long, text string, lang string, source string, n_chars long")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id (null last), of each group of five-word likeness 0.8 or more.

    Of repeated rows (one doc_id and text) one stays. Null, empty and blank texts
    are alike; of equal doc_ids the text with the least digest comes first. An
    empty table gives no rows; columns beyond those of documents are dropped.
    """
    small_batches(spark)
    rows = docs.select(*COLUMNS).withColumn("row", row_name())
    groups = simhash.alike(rows.select("row", "text", "doc_id"), keep=("doc_id",))
    groups = written(groups.groupBy("component", "row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times")), "near-groups", 1 << 14)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = groups.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    gone = groups.join(first, "component").where(F.col("row") != F.col("first.row")).select("row", F.lit(True).alias("_gone"))
    # What leaves, or stands there more than once, is looked up; all other rows pass.
    marked = gone.unionByName(groups.where("times > 1").select("row", F.lit(False).alias("_gone"))).groupBy("row").agg(F.max("_gone").alias("_gone"))
    rows = few_rows(rows, written(marked, "marked-rows", 1 << 14), "row", "left")
    once = rows.where("_gone IS NULL")
    return once.unionByName(rows.where("NOT _gone").dropDuplicates(["row"])).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix draws it: not at all, once or twice.

    Documents without a word (null and empty texts) are never drawn; a null
    source is a source; repeated rows are drawn alike, as often as that one of
    them that is drawn most; ties follow digests of doc_id and text. An empty
    table gives no rows; columns beyond those of documents are dropped.
    """
    rows = docs.select(*COLUMNS).withColumn("_row", row_name())
    drawn = mixing.mix(rows, keep=("_row",)).where("copies > 0")
    drawn = drawn.groupBy("_row").agg(F.max("copies").alias("_copies"))
    both = rows.join(drawn, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return both.select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_chunks, n_tokens, ids_crc32, decoded_sha256) of every row.

    Null is empty text, which has no ids; each of repeated rows gives a row. An
    empty table gives no rows; other columns are ignored.
    """
    small_batches(spark)
    return pieces.described(pieces.encode(docs.select("doc_id", "text")))


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: No stage can be told in SQL: the classifier and the tokenizer are models, and the hashes are not DuckDB's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
