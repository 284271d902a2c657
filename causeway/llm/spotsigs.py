"""SpotSigs document fingerprints.

A signature is a common word (the anchor) with the next ``CHAIN`` content words
after it. In a stretch without anchors every word becomes one, and a text's
first few content words stand alone, which decides very short texts. A text's
fingerprint is the sorted set of its signatures' hashes, in hexadecimal. Likeness is the Jaccard ratio of two sets. Near-duplicate search
deals sets to ranges of set length within which the ratio can reach the
threshold, meets candidates on the rarest signatures of each set, and stops
comparing as soon as the ratio is out of reach.

Defined results: null is empty text; a text without content words stands by its
first words; a text without words has the empty fingerprint, which is wholly
like another empty one and unlike any other. Repeated rows are separate documents, equal doc_ids follow
each other by their texts, null doc_ids come first, an empty table gives no
rows, and further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, rows_of, sliced, written

CHAIN = 2
#: After this many words without an anchor every word is one, until the next anchor.
DROUGHT = 4
#: The first content words are signatures on their own, so that very short texts have some.
OPENING = 4
THRESHOLD = 0.8

# Common words of English, German, French and Spanish.
ANCHORS = frozenset(
    "the of and to in is was that for it on as with at by this from are be or an a not have has "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les un une et à en que qui dans pour du au par sur pas plus est sont avec ce "
    "el los las de y por con para se no lo al su más una como".split()
)
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|«»¿¡…-_/\\"


def words_of(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(_STRIP))]


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's signatures."""
    from xxhash import xxh32_intdigest

    words = words_of(text)
    content = [w for w in words if w not in ANCHORS]
    found: set[tuple[str, ...]] = {(w,) for w in content[:OPENING] or words[:OPENING]}
    seen, since = 0, 0
    for w in words:
        common = w in ANCHORS
        since = 0 if common else since + 1
        seen += not common
        if (common or since > DROUGHT) and seen + chain <= len(content):
            found.add((w, *content[seen : seen + chain]))
    return np.array(sorted({xxh32_intdigest(" ".join(f)) for f in found}), dtype=np.uint32)


def to_string(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard ratio of two sorted sets; 0.0 as soon as it is sure to be under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    ratio = common / (len(a) + len(b) - common)
    return ratio if ratio >= least else 0.0


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """op6's rows: each text, its fingerprint, and both for its edited text and the next one."""

    def pairs(batches):
        """A slice is in order; its last own row is followed by a borrowed one."""
        held, last = None, None
        for doc, text, part, borrowed in rows_of(batches, "doc_id", "text", "slice", "borrowed"):
            text = text or ""
            mark = signatures(text)
            if last == part and held:
                old, before, old_mark = held
                changed = edited(before, text)
                changed_mark = signatures(changed)
                yield (old, len(before), hashlib.sha256(changed.encode()).hexdigest(), to_string(old_mark), to_string(changed_mark), likeness(old_mark, changed_mark), likeness(old_mark, mark))
            held, last = (None, part) if borrowed else ((doc, text, mark), part)

    return map_rows(sliced(docs.select("doc_id", "text"), neighbours=True), pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_links(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal fingerprints: ((a, b, ratio), (doc_id, class_id, mark)).

    A class is named by a number of its own, since documents may have no doc_id
    or share one. Set lengths are cut into ranges
    that grow by 1 / threshold, so that a partner lies in the same range or the
    next. Signatures are ranked by how many classes have them; sets of ratio
    ``threshold`` share one of the first n - ceil(threshold * n) + 1.
    """
    marked = written(map_rows(docs.select("doc_id", "text"), lambda bs: ((d, to_string(signatures(t, chain))) for d, t in rows_of(bs, "doc_id", "text")), "doc_id long, mark string"), "spot-marks")
    classes = written(marked.select("mark").distinct().withColumn("class_id", F.monotonically_increasing_id()), "spot-classes")
    members = marked.join(classes, "mark").select("doc_id", "class_id", "mark")
    size = F.length("mark") / 8
    sets = classes.where(F.length("mark") > 0).withColumn("n", size.cast("int"))
    # A ratio of logarithms is rounded up at a bound, where both ranges are looked at anyway.
    sets = sets.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / np.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col("n"))
    tokens = sets.select("class_id", "n", "range", F.explode(F.expr("transform(sequence(0, n - 1), i -> substring(mark, 8 * i + 1, 8))")).alias("token"))
    ranked = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "token"))
    first = ranked.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("df") > 1))
    a = first.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "range", "token")
    b = first.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("range"), F.col("range") - 1)).alias("range"), "token")
    candidates = a.join(b, ["range", "token"]).where((F.col("a") != F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    candidates = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    texts = sets.select("class_id", "mark")
    both = candidates.join(texts.toDF("a", "mark_a"), "a").join(texts.toDF("b", "mark_b"), "b")

    def compared(batches):
        for x, y, p, q in rows_of(batches, "a", "b", "mark_a", "mark_b"):
            ratio = likeness(from_string(p), from_string(q), threshold)
            if ratio >= threshold:
                yield x, y, ratio

    return map_rows(both, compared, "a long, b long, ratio double"), members


def query(docs: DataFrame) -> DataFrame:
    """op6: fingerprints of every text, its edited text, and their likeness."""
    return with_next(docs)
