"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to this many links (16 bytes each) are joined in one task; more go round by round.
ONE_TASK_LINKS = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (a, b) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for side in (x, y):
            np.minimum.at(new, root[side], low)
            np.minimum.at(new, side, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(a, b) links between longs to (node, root), root being the least node reached.

    A set of links of a checked, bounded size is joined in one task. Any other
    goes through rounds of large-star and small-star contraction, each a join on
    equal keys, written to the shared folder, until no link changes.
    """
    links = written(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct(), "links", 1 << 14)
    if links.count() <= one_task:

        def joined(batches):
            parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
            if parts:
                nodes, root = roots(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                for i in range(0, len(nodes), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 14)]), pa.array(root[i : i + (1 << 14)])], ["node", "root"])

        return written(links.coalesce(1).mapInArrow(joined, "node long, root long"), "components", 1 << 14)
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = written(large, "large-star", 1 << 14)
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, large.b == least.u).select("m", "a", "b")
        small = small.select("m", F.explode(F.array("a", "b")).alias("v")).where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        links = written(small, "small-star", 1 << 14)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            own = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return own.union(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
        seen = now
