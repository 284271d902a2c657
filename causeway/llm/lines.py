"""Line dedup by pairwise patience alignment.

Documents meet through shared lines, however many documents share them. A line
counts if it is not short; so does every pair of neighbouring lines of some
length, and where a pair is shorter the shortest such block of lines. The first
document that has such a key owns it, and each later one is aligned with the
owners of its keys: one partner a key, so the work grows with the lines and no
group is paired off. Patience diff aligns a pair on keys that are unique in both
documents, keeps the longest increasing run of them and goes on in the gaps with
what is unique there; where nothing is, it takes a longest common subsequence.
Aligned lines leave the later document.

Documents are ordered by ``doc_id`` (nulls first), then by a hash of their text.

Defined results: null is empty text, which has one empty line; repeated rows are
the same document and stay alike; equal doc_ids with different texts are
different documents; blank lines go only inside a block; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, row_name, rows_of, written

#: Words and bytes of a line at least, bytes of a long line, bytes of a line of few words, a pair or a block.
LEAST_WORDS, LEAST_BYTES, LONG_BYTES, PAIR_BYTES = 5, 24, 200, 40


def keys_of(text: str | None) -> dict[tuple[int, int], list[int]]:
    """(hash, kind) to line places. Kinds: 0 a line, 1 a long line, k > 1 a block of k lines."""
    from xxhash import xxh64_intdigest

    lines = [x.strip().encode() for x in (text or "").split("\n")]
    out: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, x in enumerate(lines):
        if len(x) >= LONG_BYTES:
            out[xxh64_intdigest(x) - (1 << 63), 1].append(i)
        elif len(x) >= PAIR_BYTES or len(x) >= LEAST_BYTES and len(x.split()) >= LEAST_WORDS:
            out[xxh64_intdigest(x) - (1 << 63), 0].append(i)
        if i + 1 < len(lines) and len(x) + len(lines[i + 1]) >= PAIR_BYTES:
            out[xxh64_intdigest(x + b"\n" + lines[i + 1], 2) - (1 << 63), 2].append(i)
        elif x:
            # Starts are lines with text, so at most PAIR_BYTES of these blocks run over any place.
            size, end = len(x), i + 1
            while size < PAIR_BYTES and end < len(lines):
                size += len(lines[end])
                end += 1
            if size >= PAIR_BYTES and end > i + 1:
                out[xxh64_intdigest(b"\n".join(lines[i:end]), end - i) - (1 << 63), end - i].append(i)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first place, that increases in both."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def longest_common(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned places of a longest common subsequence of two lists of (place, key).

    Bit j of a row is unset where the length grows at ``b[j]``; a row follows
    from the one before by an addition of long integers. Of the rows every
    ``step``-th is kept, and those between are made again on the way back.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head][1] == b[head][1]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail][1] == b[-1 - tail][1]:
        tail += 1
    ends = [(x[0], y[0]) for x, y in zip(a[:head], b[:head], strict=True)] + [(x[0], y[0]) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    at: dict[int, int] = defaultdict(int)
    for j, (_, k) in enumerate(b):
        at[k] |= 1 << j
    full, step = (1 << len(b)) - 1, isqrt(len(a)) + 1

    def after(row: int, key: int) -> int:
        same = row & at.get(key, 0)
        return (row + same | row - same) & full

    kept, row = [full], full
    for i, (_, k) in enumerate(a, 1):
        row = after(row, k)
        if i % step == 0:
            kept.append(row)
    out, j = [], len(b) - 1
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for _, k in a[block * step : min((block + 1) * step, len(a))]:
            rows.append(after(rows[-1], k))
        for i in range(len(rows) - 1, 0, -1):
            while j >= 0 and rows[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if rows[i - 1] >> j & 1:
                out.append((a[block * step + i - 1][0], b[j][0]))
                j -= 1
    return sorted(out + ends)


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned places of two lists of (place, key), each in order of place."""
    out: list[tuple[int, int]] = []
    work = [(a, b)]
    while work:
        a, b = work.pop()
        many_a, many_b = Counter(k for _, k in a), Counter(k for _, k in b)
        there = {k: p for p, k in b if many_b[k] == 1}
        anchors = increasing([(p, there[k]) for p, k in a if many_a[k] == 1 and k in there])
        if not anchors:
            if not many_a.keys().isdisjoint(many_b):
                out += longest_common(a, b)
            continue
        out += anchors
        # One key cannot be unique on one side only for ever: each gap holds fewer keys.
        gaps = zip([(-1, -1), *anchors], [*anchors, (float("inf"), float("inf"))], strict=True)
        ia = ib = 0
        for (pa, pb), (qa, qb) in gaps:
            sub_a, sub_b = [], []
            while ia < len(a) and a[ia][0] < qa:
                if a[ia][0] > pa:
                    sub_a.append(a[ia])
                ia += 1
            while ib < len(b) and b[ib][0] < qb:
                if b[ib][0] > pb:
                    sub_b.append(b[ib])
                ib += 1
            if sub_a and sub_b:
                work.append((sub_a, sub_b))
    return sorted(out)


def common_lines(own: dict[tuple[int, int], list[int]], other: dict[tuple[int, int], list[int]]) -> set[int]:
    """Lines of the later document that lie in blocks aligned with the earlier one.

    Single lines and blocks of lines are aligned each on their own. What is left
    of both is aligned again until nothing is, so that blocks which have changed
    places are found too.
    """
    gone: set[int] = set()
    for block in (False, True):
        a = sorted((p, h) for (h, kind), places in own.items() if (kind > 1) == block for p in places)
        b = sorted((p, h) for (h, kind), places in other.items() if (kind > 1) == block for p in places)
        many = {p: max(kind, 1) for (_, kind), places in own.items() if (kind > 1) == block for p in places}
        while found := patience(a, b):
            for p, _ in found:
                gone.update(range(p, p + many[p]))
            here, there = {p for p, _ in found}, {q for _, q in found}
            a, b = [x for x in a if x[0] not in here], [x for x in b if x[0] not in there]
    return gone


def shared_lines(docs: DataFrame) -> DataFrame:
    """(row binary, doc_id, text) to (row, gone array<int>): the lines that leave each document."""

    def listed(batches):
        for row, doc, text in rows_of(batches, "row", "doc_id", "text"):
            for (h, kind), places in keys_of(text).items():
                yield h, kind, doc, row, places

    keys = written(map_rows(docs, listed, "key long, kind int, doc_id long, row binary, places array<int>", size=4096), "line-keys")
    owners = keys.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row")).alias("first"))
    # Written, so that the joins have a plain exchange on either side and Spark can split a line of very many documents.
    owners = written(owners.where("n > 1").select("key", "kind", "first"), "line-owners", 1 << 14)
    both = keys.join(owners, ["key", "kind"])
    # An owner's places reach the others in a second, smaller step: its own row of each key carries them.
    mine = F.struct("doc_id", "row") == F.col("first")
    held = both.where(mine).dropDuplicates(["key", "kind"]).select("key", "kind", F.col("row").alias("owner"), F.col("places").alias("there"))
    held = written(held, "owned-lines", 1 << 12)
    rest = keys.join(held, ["key", "kind"]).where(F.col("row") != F.col("owner")).select("row", "owner", "key", "kind", "places", "there")
    rest = rest.repartition("row").sortWithinPartitions("row", "owner", "key", "kind")

    def aligned(batches):
        now = partner = None
        gone: set[int] = set()
        own: dict = {}
        other: dict = {}
        for row, owner, h, kind, places, there in rows_of(batches, "row", "owner", "key", "kind", "places", "there"):
            if (row, owner) != (now, partner):
                if own:
                    gone |= common_lines(own, other)
                    own, other = {}, {}
                if row != now and now is not None:
                    yield now, sorted(gone)
                    gone = set()
                now, partner = row, owner
            own[h, kind], other[h, kind] = places, there
        if now is not None:
            yield now, sorted(gone | common_lines(own, other))

    return map_rows(rest, aligned, "row binary, gone array<int>", size=4096)


def without_shared(docs: DataFrame) -> DataFrame:
    """Adds ``row`` and ``gone`` to documents; ``text`` stays as it is."""
    rows = docs.drop("gone").withColumn("row", row_name())
    gone = shared_lines(rows.select("row", "doc_id", "text"))
    return rows.join(gone, "row", "left")


def kept_text(text: str | None, gone: list[int] | None) -> str | None:
    if not gone or text is None:
        return text
    out = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)


def query(docs: DataFrame) -> DataFrame:
    """op9: lines and blocks that leave every document, and the checksum of the rest."""

    def told(batches):
        for doc, text, gone in rows_of(batches, "doc_id", "text", "gone"):
            gone = gone or []
            blocks = sum(1 for i, x in enumerate(gone) if not i or gone[i - 1] != x - 1)
            rest = kept_text(text, gone) or ""
            yield doc, (text or "").count("\n") + 1, len(gone), blocks, hashlib.sha256(rest.encode()).hexdigest()

    found = without_shared(docs.select("doc_id", "text")).select("doc_id", "text", "gone")
    return map_rows(found, told, "doc_id long, n_lines long, n_removed long, n_blocks long, kept_sha256 string", size=4096)
