"""SimHash near-duplicates through pigeonring filtering.

A fingerprint is cut into ``radius + 1`` ring segments, three at least. By the pigeonring
principle two fingerprints within ``radius`` bits have a segment from which on
every chain of l consecutive segments differs in at most l * radius / segments
bits: the first not at all, the first two in one bit at most, and so on. The
first two conditions become an equality key (the fingerprint's own chain head,
and that of each neighbour with one set bit of the second segment cleared); the
longer chains are tested inside a key's run before the full distance. Keys are
taken from distinct fingerprints only, and a run yields links that join its
parts, never all of its pairs.

Defined results: null, empty and blank texts have fingerprint 0, which links
like any other; repeated rows are separate documents of one component; a null
doc_id is never a component's name unless it is alone; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, forget, map_rows, rows_of, written
from .components import components

BITS = 64
SHINGLE, RADIUS, SEED = 3, 2, 42
#: Longer runs are joined through masked values instead of one against all.
LONG_RUN = 4096
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of the text, in order, repeats included."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed long."""
    counts = np.concatenate([np.bincount(hashes.view(np.uint8)[i::8], minlength=256) @ _BIT for i in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long)."""

    def made(batches):
        for doc, text in rows_of(batches, "doc_id", "text"):
            yield doc, fingerprint(shingle_hashes(text, words, seed))

    return map_rows(docs, made, "doc_id long, fp long", size=4096)


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each ring segment; at least three, so that two fit into a key."""
    n = max(3, radius + 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def heads(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Chain-head keys and the fingerprint of each: own heads, then cleared ones."""
    ring, keys, who = segments(radius), [], []
    for i, (low, width) in enumerate(ring):
        first = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
        low2, width2 = ring[(i + 1) % len(ring)]
        second = (fps >> np.uint64(low2)) & np.uint64((1 << width2) - 1)
        base = np.uint64(i << 56) | first << np.uint64(width2)
        keys.append(base | second)
        who.append(fps)
        for bit in range(width2):
            has = (second >> np.uint64(bit)) & np.uint64(1) == 1
            keys.append((base | second & ~np.uint64(1 << bit))[has])
            who.append(fps[has])
    return np.concatenate(keys), np.concatenate(who)


def _joined(fps: np.ndarray, radius: int, chain: int) -> list[tuple[int, int]]:
    """Links that join the distinct fingerprints of one run as far as they are near."""
    n, label, out = len(fps), np.arange(len(fps)), []
    if n > LONG_RUN and radius <= 2:
        # Values within two bits agree once some two bits are masked: each mask joins equal values.
        free = [b for b in range(BITS) if len(np.unique((fps >> np.uint64(b)) & np.uint64(1))) > 1]
        for i, a in enumerate(free):
            for b in free[i + 1 :] if radius > 1 and len(free) > 1 else [a]:
                masked = fps & ~(np.uint64(1 << a) | np.uint64(1 << b))
                order = np.argsort(masked, kind="stable")
                same = masked[order][1:] == masked[order][:-1]
                x, y = order[:-1][same], order[1:][same]
                apart = label[x] != label[y]
                for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                    if label[p] != label[q]:
                        out.append((p, q))
                        label[label == label[q]] = label[p]
        return out
    ring = segments(radius)
    ring = ring[chain:] + ring[:chain]
    for i in range(n - 1):
        if len(out) == n - 1:
            break
        differ = fps[i] ^ fps[i + 1 :]
        near = np.ones(len(differ), bool)
        total = np.zeros(len(differ), np.int64)
        for length, (low, width) in enumerate(ring, 1):
            total += np.bitwise_count((differ >> np.uint64(low)) & np.uint64((1 << width) - 1))
            near &= total <= math.floor(length * radius / len(ring))
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct ``fp`` longs to links (a, b) that join all fingerprints within ``radius`` bits."""

    def keyed(batches):
        for b in batches:
            keys, who = heads(b.column("fp").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who.view(np.int64))], ["key", "fp"])

    def runs(batches):
        """Keys come in order; a run may go on in the next batch."""
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys, fps):
            cut = np.flatnonzero(np.diff(keys)) + 1
            begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
            found = []
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if b - a > 1:
                    own = np.unique(fps[a:b]).view(np.uint64)
                    found += [(int(own[p].view(np.int64)), int(own[q].view(np.int64))) for p, q in _joined(own, radius, int(keys[a]) >> 56)]
            return found

        def batch(found):
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for x in batches:
            keys = np.concatenate((held_k, x.column("key").to_numpy()))
            fps = np.concatenate((held_f, x.column("fp").to_numpy()))
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            held_k, held_f = keys[last:], fps[last:]
            if last and (found := links(keys[:last], fps[:last])):
                yield batch(found)
        if len(held_k) and (found := links(held_k, held_f)):
            yield batch(found)

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, text) to (doc_id, fp, component_id)."""
    marked = written(fingerprints(docs.select("doc_id", "text"), words, seed), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints", 1 << 14)
    reached = components(near_links(distinct, radius))
    named = distinct.join(reached, distinct.fp == reached.node).groupBy("root").agg(F.min("first").alias("name"))
    named = reached.join(named, "root").select("node", "name")
    named = distinct.join(named, distinct.fp == named.node, "left").select("fp", F.coalesce("name", "first").alias("component_id"))
    # Written, so that the join has a plain exchange on either side and Spark can split a fingerprint with very many rows.
    named = written(named, "named-fingerprints", 1 << 14)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


LIKENESS_SHINGLE, LIKENESS = 5, 0.8
#: Bits in which the fingerprints of a pair differ at most that ``alike`` finds by chains: with five segments a key has 25 bits.
NEAR_RADIUS = 4
#: Documents whose shingles are counted to tell common ones, and how many of those are kept. They order shingles, no more.
SAMPLE, COMMON = 10_000, 50_000
#: Members of a shingle's run that one task holds at most; a longer run is dealt to blocks, and in the end to pairs of blocks.
RUN_ROWS = 20_000
#: Bits of the smallest parity fingerprint.
LEAST_PARITY = 256


def shingle_set(text: str | None, words: int = LIKENESS_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard ratio of two ascending sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def parities(found: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of the set has it.

    Two sets differ in at least as many members as their parities differ in
    bits. There are about as many bits as members, a power of two; the halves
    of a fingerprint, one over the other, make the fingerprint of half the bits.
    """
    bits = max(LEAST_PARITY, 1 << max(0, len(found) - 1).bit_length())
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def may_differ(n, m, likeness: float):
    """Members that are in one of two sets of this likeness alone, at most."""
    return (n + m) * (1 - likeness) / (1 + likeness) + 1e-6


def prefix_size(n: int, likeness: float) -> int:
    """How many of n shingles, in one order for all sets, meet those of every set of this likeness."""
    return n - math.ceil(n * likeness - 1e-9) + 1 if n else 0


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are often met in a sample of the texts, ascending, and their counts."""
    step = max(1, docs.count() // SAMPLE)

    def listed(batches):
        for b in batches:
            if b.num_rows:
                found = np.concatenate([shingle_set(t, words) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("text").mapInArrow(listed, "shingle long")
    many = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingles, n = many["shingle"].to_numpy().view(np.uint64), many["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def rarest_first(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the order of all sets: by the count in the sample, then by hash."""
    shingles, n = common
    if not len(shingles):
        return found
    at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
    return found[np.argsort(np.where(shingles[at] == found, n[at], 0), kind="stable")]


def _near_later(sizes: np.ndarray, comps: np.ndarray, marks: list[bytes], likeness: float):
    """For each member of a run, the later ones of another component that may be alike, as places.

    Members ascend in size, so do the bits of their parities. Sizes that rule
    the likeness out come last; of the others those go whose parities differ in
    too many bits.
    """
    k, ends = len(sizes), np.searchsorted(sizes, np.floor(sizes / likeness + 1e-9), side="right")
    if k <= 16:
        numbers = [int.from_bytes(x, "little") for x in marks]
        for i in range(k - 1):
            out, bits = [], 8 * len(marks[i])
            for j in range(i + 1, ends[i]):
                if comps[j] != comps[i]:
                    other = numbers[j]
                    width = 8 * len(marks[j])
                    while width > bits:
                        width //= 2
                        other = other >> width ^ other & (1 << width) - 1
                    if (numbers[i] ^ other).bit_count() <= may_differ(sizes[i], sizes[j], likeness):
                        out.append(j)
            yield i, out
        return
    widths = np.array([len(x) for x in marks])
    block = {int(w): (int(np.searchsorted(widths, w)), int(np.searchsorted(widths, w, side="right"))) for w in np.unique(widths)}
    table = {w: np.frombuffer(b"".join(marks[a:b]), np.uint64).reshape(b - a, -1) for w, (a, b) in block.items()}
    halves = {w: t[:, : t.shape[1] // 2] ^ t[:, t.shape[1] // 2 :] for w, t in table.items() if w // 2 in table}
    for i in range(k - 1):
        out, w = [], int(widths[i])
        own = table[w][i - block[w][0]]
        for v, there in ((w, table), (2 * w, halves)):
            if v in there:
                a, b = max(block[v][0], i + 1), min(block[v][1], int(ends[i]))
                at = np.flatnonzero(comps[a:b] != comps[i]) + a if a < b else ()
                if len(at):
                    apart = np.bitwise_count(there[v][at - block[v][0]] ^ own).sum(axis=1)
                    out += at[apart <= may_differ(sizes[i], sizes[at], likeness)].tolist()
        yield i, out


def run_pairs(sizes: np.ndarray, comps: np.ndarray, marks: list[bytes], first: int, likeness: float) -> tuple[list[tuple[int, int]], int | None]:
    """Pairs of members of a run that may be alike, and the first member that was not compared yet, if any.

    Once there are more than twice as many pairs as members, the rest waits
    until the components of these pairs are known; most are of one component by then.
    """
    out: list[tuple[int, int]] = []
    if len(sizes) < 2 or (comps == comps[0]).all():
        return out, None
    for i, later in _near_later(sizes, comps, marks, likeness):
        if i < first or not later:
            continue
        if len(out) > 2 * len(sizes):
            return out, i
        out += [(i, j) for j in later]
    return out, None


def _by_run(rows: DataFrame, likeness: float) -> DataFrame:
    """(key, block, n, id, comp, first, parity) to pairs (a, b) and, with null a, runs (key, block) to go on with at ``first``."""
    ddl = "a long, b long, key long, block long, first int"

    def runs(batches):
        now, held = None, []
        for key, block, n, i, comp, first, mark in rows_of(batches, "key", "block", "n", "id", "comp", "first", "parity"):
            if (key, block) != now:
                yield from told(now, held)
                now, held = (key, block), []
            if not held or held[-1][1] != i:
                held.append((n, i, comp, first, mark))
        yield from told(now, held)

    def told(now, held):
        if len(held) < 2:
            return
        n, ids, comps, firsts, marks = zip(*held, strict=True)
        pairs, on = run_pairs(np.array(n), np.array(comps), marks, max(firsts), likeness)
        for i, j in pairs:
            yield min(ids[i], ids[j]), max(ids[i], ids[j]), None, None, None
        if on is not None:
            yield None, None, *now, on

    return map_rows(rows.repartition("key", "block").sortWithinPartitions("key", "block", "n", "id"), runs, ddl, size=4096)


def print_pairs(sets: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """(id, fp) to pairs (a, b) of ids that join all of one fingerprint and of fingerprints within ``radius`` bits."""
    first = written(sets.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints", 1 << 14)
    same = sets.join(first, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = near_links(first, radius).toDF("x", "y").join(first.toDF("x", "a"), "x").join(first.toDF("y", "b"), "y")
    return written(same.union(near.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "print-pairs", 1 << 14)


def alike(docs: DataFrame, words: int = LIKENESS_SHINGLE, likeness: float = LIKENESS, keep: tuple[str, ...] = (), run_rows: int | None = None, radius: int = NEAR_RADIUS) -> DataFrame:
    """(row, text) to (row, component) and the columns of ``keep``: texts whose shingle sets have at least this Jaccard ratio.

    SimHash fingerprints within ``radius`` bits meet first, through pigeonring
    chains, and the pairs are tested by the exact ratio. Sets of this likeness
    may differ in more bits than any chain allows, so the others are looked for
    among the sets that are not joined yet; a shingle whose sets all are is done.

    That search is exact, by prefix filtering: with the shingles of all sets in
    one order, rarest first, two sets of this likeness meet in the first
    ``n - ceil(n * likeness) + 1`` shingles of each. Members of a shingle's run
    are compared by parity fingerprints, whose distance bounds that of the sets
    from below; what is left is compared whole. Pairs that links found so far
    have joined need no test, so a run goes on in rounds. A run of over
    ``run_rows`` members (RUN_ROWS) is dealt to blocks that all have its least member; if
    the blocks' links do not join all of it, pairs of blocks are compared.
    A component is a number without meaning.
    """
    from xxhash import xxh3_128_digest

    run_rows = run_rows or RUN_ROWS
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    common = common_shingles(docs, words)

    def marked(batches):
        for row, text, *rest in rows_of(batches, "row", "text", *keep):
            found = shingle_set(text, words)
            yield row, *rest, xxh3_128_digest(found.tobytes()), len(found), fingerprint(shingle_hashes(text)), parities(found), rarest_first(found, common)[: prefix_size(len(found), likeness)].view(np.int64)

    kind = docs.schema["row"].dataType.simpleString()
    sets = written(map_rows(docs.select("row", "text", *keep), marked, f"row {kind}{kept}, mark binary, n long, fp long, parity binary, prefix array<long>", size=1024), "shingle-prefixes")
    # A number once written stays: a set is named by it from here on.
    distinct = sets.select("row", "mark", "n", "fp", "parity", "prefix").dropDuplicates(["mark"])
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets", 1 << 14)
    pairs = print_pairs(distinct.select("id", "fp"), radius)
    links = _alike_pairs(docs, distinct, pairs, words, likeness)
    reached = written(components(links), "joined-by-prints", 1 << 14)
    named = few_rows(distinct.select("prefix", "n", "id"), reached.toDF("id", "root"), "id", "left")
    keys = named.select(F.explode("prefix").alias("key"), "n", "id", F.coalesce("root", "id").alias("comp"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "id")).alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    blocks = F.ceil(F.col("met") / run_rows)
    # Most keys have one document, or documents that are joined. They go before the parities come. Written, as its join may have keys of very many rows.
    met = written(met.select("key", blocks.alias("blocks"), F.col("least.id").alias("least")), "met-shingles", 1 << 14)
    shared = keys.join(met, "key")
    own = F.when(F.col("blocks") == 1, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")))
    everywhere = (F.col("blocks") > 1) & (F.col("id") == F.col("least"))
    shared = shared.withColumn("block", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))))
    shared = shared.join(distinct.select("id", "parity"), "id")
    shared = written(shared.select("key", "block", "blocks", "n", "id", "comp", F.lit(0).alias("first"), "parity"), "shared-shingles", 1 << 14)
    forget(pairs, reached)
    long = not shared.where("blocks > 1").isEmpty()
    while True:
        found = written(_by_run(shared, likeness), "run-pairs", 1 << 14)
        pairs = written(found.where("a IS NOT NULL").select("a", "b").distinct(), "pairs", 1 << 14)
        new = _alike_pairs(docs, distinct, pairs, words, likeness)
        links = links.union(new)
        reached = components(links)
        on = found.where("a IS NULL").select("key", "block", "first")
        if not long and on.isEmpty():
            break
        joined = shared.drop("comp").join(reached, shared.id == reached.node, "left").withColumn("comp", F.coalesce("root", "id"))
        rest = joined.drop("first").join(on, ["key", "block"]).select(shared.columns)
        if long:
            rest, long = rest.unionByName(_crossed(joined.select(shared.columns))), False
        old, shared = shared, written(rest, "open-shingles", 1 << 14)
        forget(old, found, pairs)
    least = distinct.join(reached, distinct.id == reached.node, "left").select("mark", F.coalesce("root", "id").alias("component"))
    least = written(least, "named-sets", 1 << 14)
    return sets.select("row", "mark", *keep).join(least, "mark").select("row", "component", *keep)


def _crossed(runs: DataFrame) -> DataFrame:
    """Runs of several blocks whose members are not of one component yet, dealt anew to pairs of blocks."""
    runs = runs.where("blocks > 1")
    apart = runs.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    pairs = runs.join(apart, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pairs.withColumn("block", (F.lit(1) + low) * F.col("blocks") + high).withColumn("first", F.lit(0)).drop("other")


def _alike_pairs(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, words: int, likeness: float) -> DataFrame:
    """Of pairs (a, b) of sets those that are alike by the exact ratio."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = written(distinct.select("id", "row").join(ids, "id"), "compared", 1 << 14)

    def whole(batches):
        for i, text in rows_of(batches, "id", "text"):
            yield i, shingle_set(text, words).tobytes()

    def tested(batches):
        for a, b, x, y in rows_of(batches, "a", "b", "x", "y"):
            if jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= likeness:
                yield a, b

    texts = few_rows(docs.select("row", "text"), wanted, "row", "inner")
    found = written(map_rows(texts.select("id", "text"), whole, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b")
    out = written(map_rows(both, tested, "a long, b long", size=4096), "alike-links", 1 << 14)
    forget(wanted, found)
    return out


def query(docs: DataFrame) -> DataFrame:
    """op1: fingerprint and component of every document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
