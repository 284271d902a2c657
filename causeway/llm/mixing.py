"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Each source's text is a stream of words: its documents in a seeded order, dealt
to shards by a hash of ``doc_id``, one after another. The stream is cut into
blocks of equal token count. Blocks are given to sources by highest quotients
target / (2 seats + 1), then each source's blocks to its shards in the same way,
which yields an integer quota for every shard. Within a shard a seeded
systematic draw picks the quota's blocks; a quota above the number of blocks
repeats blocks. All of that is arithmetic on a document's place in its shard's
stream, so no block is ever a row.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; repeated rows are separate documents; an empty table gives an
empty result; further columns are ignored but for those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Sources by code point weigh these in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix holds this share of all tokens; a source gives at most MOST times its size.
SHARE, MOST = 1.5, 2.0
#: Words of a block at most; the smallest source is cut into about LEAST_BLOCKS blocks at least.
BLOCK_WORDS, LEAST_BLOCKS = 256, 2000
#: A shard holds about this many words, and a source at most MOST_SHARDS shards.
SHARD_WORDS, MOST_SHARDS = 1 << 17, 1 << 16
SEED = 20240229


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size).

    The targets are min(most * size, weight * level) at the one level where they
    sum to ``share`` of all sizes, which is what resharing each excess by weight
    until no source is above its bound comes to. In the order of bound / weight,
    the level is the largest of (total - bounds before) / (weights from here on).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    return ranked.withColumn("target", F.least("bound", F.col("weight") * F.max("level").over(everything))).drop("bound", "level")


def sainte_lague(df: DataFrame, group: list[str], order: list[Column], claim: str, seats: str, out: str) -> DataFrame:
    """Gives each group's ``seats`` to its rows by highest quotients of ``claim``.

    Starts from claims rounded to their share of seats and then takes or gives
    back single seats in order of quotient. A row can move by at most its share
    of (missing seats + rows of the group) + 1 seats, so the listed quotients
    are a few a row. ``order`` breaks ties; rows without claim get no seats.
    """
    whole = Window.partitionBy(*group)
    row = Window.partitionBy(*group).orderBy(*order)
    total = F.sum(claim).over(whole)
    part = F.when(total > 0, F.col(claim) / total).otherwise(F.lit(0.0))
    base = df.withColumn("_part", part).withColumn("_row", F.row_number().over(row))
    base = base.withColumn("_base", F.floor(F.col("_part") * F.col(seats) + 0.5).cast("long"))
    base = base.withColumn("_gap", F.col(seats) - F.sum("_base").over(whole)).withColumn("_rows", F.count(F.lit(1)).over(whole))
    reach = (F.ceil(F.col("_part") * (F.abs("_gap") + F.col("_rows"))) + 1).cast("long")
    reach = F.when((F.col("_gap") == 0) | (F.col("_part") <= 0), F.lit(0)).when(F.col("_gap") < 0, F.least(reach, F.col("_base"))).otherwise(F.least(reach, F.col("_gap")))
    steps = base.where(reach > 0).withColumn("_step", F.explode(F.sequence(F.lit(1).cast("long"), reach)))
    up = F.col("_gap") > 0
    seat = F.when(up, F.col("_base") + F.col("_step") - 1).otherwise(F.col("_base") - F.col("_step"))
    steps = steps.withColumn("_q", F.col(claim) / (2 * seat + 1))
    best = Window.partitionBy(*group).orderBy(F.when(up, -F.col("_q")).otherwise(F.col("_q")), F.when(up, F.col("_row")).otherwise(-F.col("_row")), "_step")
    moved = steps.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= F.abs("_gap"))
    moved = moved.groupBy(*group, "_row").agg(F.sum(F.signum("_gap")).cast("long").alias("_moved"))
    on = F.col("b._row") == F.col("m._row")
    for g in group:
        on &= F.col(f"b.{g}").eqNullSafe(F.col(f"m.{g}"))
    both = base.alias("b").join(moved.alias("m"), on, "left")
    keep = [F.col(f"b.{c}") for c in df.columns]
    return both.select(*keep, (F.col("b._base") + F.coalesce(F.col("m._moved"), F.lit(0))).alias(out))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, text) to (doc_id, source, size, source_size, target, taken, copies) and the columns of ``keep``.

    ``taken`` counts the document's words in the drawn blocks, repeats included.
    ``copies`` is how often the block at the document's middle was drawn: the
    whole-document form of the same draw. Sizes are checkpointed, so that texts
    are read once.
    """
    rest = list(keep)
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_at"), *rest).checkpoint()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / LEAST_BLOCKS))).cast("long"))
    sources = targets(sources, weights, share, most).withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    sources = sainte_lague(sources, [], [F.col("source").asc_nulls_last()], "target", "blocks", "source_blocks")
    sources = sources.withColumn("shards", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_words) + 1).cast("long")).drop("blocks")
    placed = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    placed = placed.select("d.*", "s.source_size", "s.target", "s.source_blocks", "s.block", F.pmod("_at", F.col("s.shards")).alias("shard"))
    cells = placed.groupBy("source", "shard", "source_blocks", "block").agg(F.sum("size").alias("words"))
    cells = sainte_lague(cells, ["source"], [F.col("shard")], "words", "source_blocks", "quota")
    cells = cells.withColumn("n", F.ceil(F.col("words") / F.col("block")).cast("long")).withColumn("quota", F.least("quota", (F.col("n") * F.lit(most)).cast("long")))
    cells = cells.withColumn("phase", F.when(F.col("n") > 0, F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.col("n"))).otherwise(F.lit(0)))
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "_at"), "_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    on = F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.shard") == F.col("c.shard"))
    both = placed.alias("p").join(cells.alias("c"), on, "left").select("p.*", "c.n", "c.quota", "c.phase")

    def drawn(k: str) -> str:
        """Blocks drawn of the first k of a shard, repeats counted, but for a constant."""
        return f"((({k}) + phase) * quota div n)"

    def words(x: str) -> str:
        k = f"({x} div block)"
        return f"(block * {drawn(k)} + ({x} - block * {k}) * ({drawn(f'{k} + 1')} - {drawn(k)}))"

    middle = "((begin + size div 2) div block)"
    taken = F.when(F.col("n") > 0, F.expr(f"{words('end')} - {words('begin')}")).otherwise(F.lit(0))
    copies = F.when((F.col("n") > 0) & (F.col("size") > 0), F.expr(f"{drawn(f'{middle} + 1')} - {drawn(middle)}")).otherwise(F.lit(0))
    return both.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.cast("int").alias("copies"), *rest)


def query(docs: DataFrame) -> DataFrame:
    """op7: the words that the mix takes of every document."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
