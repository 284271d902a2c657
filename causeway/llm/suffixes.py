"""Exact removal of long repeated strings, with a logarithmic family of suffix arrays.

A unit of a text (a byte, or a word) goes if a string of ``length`` units that
covers it also starts anywhere else in the corpus. The work narrows in exact steps:

1. Every text's windows of units pick their least-hashed gram as anchor. All
   string starts of an anchor make up a stretch. Equal strings have anchors at
   the same place inside, followed by ``length - window`` equal units, so a
   stretch whose key occurs once in the corpus holds no repeat.
2. Of the stretches of a repeated key, those that are equal from end to end
   repeat wholly; that is a count by hash. Keys whose stretches differ anywhere
   are contested.
3. The distinct stretches of contested keys go, key by key, into a family of
   suffix arrays. A new batch is sorted, merge-scanned
   against the arrays of every level for strings of full length, and becomes a
   level; levels of equal size are merged, so there are logarithmically many.
   Keys with more than ``HOT`` distinct stretches, which no single task should
   hold, have their strings counted one by one by digest instead.

Defined results: null and empty texts have no units; texts under ``length``
units are left alone; repeated rows repeat each other; equal doc_ids may carry
different texts; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, row_name, rows_of, written


@dataclass(frozen=True)
class Unit:
    """What texts are cut into: ``length`` units make a string, ``window`` units pick an anchor."""

    kind: str
    length: int
    window: int

    def __post_init__(self):
        if self.kind not in ("bytes", "words") or not 0 < self.window <= self.length - self.gram + 1:
            raise ValueError(self)

    @property
    def size(self) -> int:
        """Bytes of a unit."""
        return 1 if self.kind == "bytes" else 4

    @property
    def gram(self) -> int:
        """Units whose hash orders the places of a window; the words of one are few, so that it takes several to tell places apart."""
        return 8 if self.kind == "bytes" else 4

    def of(self, text: str | None) -> np.ndarray:
        """The units of a text: its bytes, or 32-bit hashes of its words."""
        data = (text or "").encode()
        return np.frombuffer(data, np.uint8) if self.kind == "bytes" else word_hashes(data)


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
#: Bytes of a text that are hashed at once, and an odd number with its inverse modulo 2**64.
_PART, _ODD = 1 << 16, 0x9E3779B97F4A7C15
_UNDO = pow(_ODD, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd number and of its inverse."""
    out = []
    for base in (_ODD, _UNDO):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def word_hashes(data: bytes) -> np.ndarray:
    """32-bit hashes of the words of a text: polynomials in its bytes, from running sums."""
    out, at = [np.zeros(0, np.uint32)], 0
    while at < len(data):
        part = data[at : at + _PART]
        if at + _PART < len(data):  # up to the end of a word, which may be longer
            gaps = np.flatnonzero(_SPACES.take(np.frombuffer(part, np.uint8)))
            if len(gaps):
                part = part[: gaps[-1] + 1]
            else:
                far = _SPACE.search(data, at + _PART)
                part = data[at : far.start() if far else len(data)]
        at += len(part)
        x = np.frombuffer(part, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACES.take(x), [True]))))
        begin, end = edges[::2], edges[1::2]
        up, down = _powers(max(_PART, len(x)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])))
        h = (sums[end] - sums[begin]) * down[begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(out)


#: Strings of 400 bytes are removed; passages of over 50 words are told. A shorter window makes more anchors, but fewer strings that are contested.
BYTES, WORDS = Unit("bytes", 400, 224), Unit("words", 51, 41)
#: Low bits of a key that tell its unit.
KINDS = 16
#: Bytes of stretches that make up a batch, and distinct stretches of a key that one task holds.
BATCH_BYTES, HOT = 1 << 18, 4000
#: Positions that are compared at once in a merge scan.
SCAN_ROWS = 8192
#: Longer texts have their anchors found in pieces of this many units.
PIECE = 1 << 20


def _anchors(x: np.ndarray, unit: Unit) -> np.ndarray:
    """For each string start of the units, the place of its first window's least gram."""
    window = unit.window
    a = x.astype(np.uint64)
    if unit.size == 1:
        a = a[:-1] | a[1:] << np.uint64(8)
        a = a[:-2] | a[2:] << np.uint64(16)
        a = a[:-4] | a[4:] << np.uint64(32)
    else:
        a = a[:-1] | a[1:] << np.uint64(32)
        a = a[:-2] * np.uint64(0xD6E8FEB86659FD93) + a[2:]
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    n = len(a)
    # The place in the low bits makes each least value the leftmost of its kind.
    a = (a & ~np.uint64(PIECE * 2 - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate((a, np.full(-n % window, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(x) - unit.length + 1
    least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
    return (least & np.uint64(PIECE * 2 - 1)).astype(np.int64)


def stretches(x: np.ndarray, unit: Unit) -> Iterator[tuple[int, int, int]]:
    """(first string start, last string start, anchor) of every stretch of a text."""
    base = 0
    while len(x) - base >= unit.length:
        part = x[base : base + PIECE + unit.length - 1]
        at = _anchors(part, unit)
        cut = np.flatnonzero(np.diff(at)) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
        yield from zip((begin + base).tolist(), (end + base).tolist(), (at[begin] + base).tolist(), strict=True)
        base += PIECE


def _strings(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings at some places, side by side. NULs at their ends compare as other bytes do, since lengths are equal."""
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[starts]
    return np.ascontiguousarray(rows).view(f"S{length}").ravel()


class Level:
    """A suffix array over stretches: the string starts in order of their ``length`` bytes."""

    def __init__(self, text: np.ndarray, order: np.ndarray, owner: np.ndarray, weight: int, length: int):
        #: ``owner``: place of each text position in the family's list of strings.
        self.text, self.order, self.owner, self.weight, self.length = text, order, owner, weight, length

    def strings(self, places: np.ndarray) -> np.ndarray:
        """The strings at some places of the order."""
        return _strings(self.text, self.order[places], self.length)

    @classmethod
    def of(cls, parts: list[bytes], first: int, length: int, step: int = 1) -> tuple[Level, np.ndarray]:
        """Sorts a batch's string starts, one every ``step`` bytes; also names the strings that repeat inside it."""
        text = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        last = np.repeat(ends, sizes) - length
        places = np.arange(len(text))
        starts = np.flatnonzero((places <= last) & (places % step == 0))
        owner = np.full(len(text), -1, np.int64)
        owner[starts] = first + np.arange(len(starts))
        strings = _strings(text, starts, length)
        by = np.argsort(strings, kind="stable")
        same = strings[by[1:]] == strings[by[:-1]]
        repeats = np.zeros(len(starts), bool)
        repeats[by[1:][same]] = repeats[by[:-1][same]] = True
        return cls(text, starts[by], owner, 1, length), owner[starts[repeats]]

    def scan(self, other: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge scan: where each string of ``other`` falls in this order, and the equal ones of both.

        Both orders are read once, in blocks: a block of the other's strings
        meets the stretch of this order that lies between its ends.
        """
        falls, own, theirs, low = [], [], [], 0
        for i in range(0, len(other.order), SCAN_ROWS):
            places = np.arange(i, min(i + SCAN_ROWS, len(other.order)))
            strings = other.strings(places)
            high = self._first_from(strings[-1:], low)
            at = np.empty(len(places), np.int64)
            equal = np.zeros(len(places), bool)
            done = 0
            while done < len(places):
                # Strings up to the last one of this piece of the order find their place in it.
                piece = self.strings(np.arange(low, min(low + 4 * SCAN_ROWS, high + 1, len(self.order))))
                last = low + len(piece) > high or low + len(piece) >= len(self.order)
                upto = len(places) if last else done + int(np.searchsorted(strings[done:], piece[-1:], side="right")[0])
                found = np.searchsorted(piece, strings[done:upto]) if len(piece) else np.zeros(upto - done, np.int64)
                inside = found < len(piece)
                same = np.zeros(upto - done, bool)
                same[inside] = piece[found[inside]] == strings[done:upto][inside]
                at[done:upto], equal[done:upto] = found + low, same
                done = upto
                low = high if last else low + len(piece) - 1
            falls.append(at)
            theirs.append(other.owner[other.order[places[equal]]])
            own.append(self.owner[self.order[at[equal]]])
            low = min(int(at[-1]), len(self.order))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (falls, own, theirs))

    def _first_from(self, string: np.ndarray, low: int) -> int:
        """The first place from ``low`` on whose string is not less."""
        high = len(self.order)
        while low < high:
            middle = (low + high) // 2
            if (self.strings(np.array([middle])) < string)[0]:
                low = middle + 1
            else:
                high = middle
        return low

    def merged(self, other: Level, falls: np.ndarray) -> Level:
        """One level of both; ``falls`` places the other's strings in this order."""
        order = np.insert(self.order, falls, other.order + len(self.text))
        return Level(np.concatenate((self.text, other.text)), order, np.concatenate((self.owner, other.owner)), self.weight + other.weight, self.length)


class Family:
    """Levels of geometrically growing size over all batches so far."""

    def __init__(self, length: int = BYTES.length, step: int = 1):
        #: Bytes of a string, and from one string start to the next.
        self.length, self.step = length, step
        self.levels, self.count = [], 0
        self.repeats: list[np.ndarray] = []

    def add(self, parts: list[bytes]) -> None:
        """Sorts a batch, scans it against every level and merges equal levels."""
        new, inside = Level.of(parts, self.count, self.length, self.step)
        self.count += len(new.order)
        self.repeats.append(inside)
        falls = None
        for level in self.levels:
            falls, own, theirs = level.scan(new)
            self.repeats += [own, theirs]
        while self.levels and self.levels[-1].weight <= new.weight:
            old = self.levels.pop()
            # The last level was just scanned; larger ones meet a merged array.
            new = old.merged(new, old.scan(new)[0] if falls is None else falls)
            falls = None
        self.levels.append(new)

    def marks(self) -> np.ndarray:
        """For every string in the order of adding: does it occur again? An equal run marks its first at least.

        A scan names one of several equal strings of a level; those were marked
        as repeats of each other when the level was made.
        """
        out = np.zeros(self.count, bool)
        for x in self.repeats:
            out[x] = True
        return out


def _spans(marks: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """Spans covered by the marked string starts first, first + 1, ..."""
    at = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return [(first + a, first + b - 1 + length) for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True)]


def repeated_spans(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,), hot: int = HOT) -> DataFrame:
    """(row binary, text) to (row, kind, begin, finish): spans of units that repeated strings cover, in any order.

    ``kind`` counts the units from 0. All of them go through the same steps, so texts are read once.
    """

    if len(units) > KINDS:
        raise ValueError(f"more than {KINDS} units")

    def found(batches):
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        schema = pa.schema([("row", pa.binary()), ("p", pa.int32()), ("more", pa.int32()), ("key", pa.int64()), ("whole", pa.int64())])
        for b in batches:
            out = []
            for row, text in rows_of([b], "row", "text"):
                for kind, unit in enumerate(units):
                    x, size, length = unit.of(text), unit.size, unit.length
                    data, same = x.tobytes(), length - unit.window
                    for p, q, a in stretches(x, unit):
                        out.append((row, p, q - p, xxh64_intdigest(data[a * size : (a + same) * size]) & -KINDS | kind, xxh3_64_intdigest(data[p * size : (q + length) * size])))
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns[:3], schema.types, strict=False)] + [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    anchors = written(docs.select("row", "text").mapInArrow(found, "row binary, p int, more int, key long, whole long"), "anchors")
    keys = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high"))
    # Written, so that the joins have a plain exchange on either side; merged, as Spark can split a key with very many stretches then.
    keys = written(keys.where("n > 1").select("key", (F.col("low") != F.col("high")).alias("contested")), "repeated-keys", 1 << 14)
    kept = written(anchors.join(keys.hint("merge"), "key"), "repeated-anchors", 1 << 14)
    forget(anchors, keys)
    kind = F.col("key").bitwiseAND(F.lit(KINDS - 1)).cast("byte")
    length = F.element_at(F.array(*(F.lit(u.length) for u in units)), F.col("kind").cast("int") + 1)
    span = [F.col("row"), F.col("kind"), F.col("p").alias("begin"), (F.col("p") + F.col("more") + length).alias("finish")]
    agreed = kept.where(~F.col("contested")).withColumn("kind", kind).select(*span)

    contested = kept.where("contested").drop("contested")
    classes = contested.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "p", "more")).alias("first"))
    classes = written(classes.select("key", "whole", "n", "first.row", "first.p", "first.more"), "stretch-classes", 1 << 14)
    twice = contested.join(classes.where("n > 1").select("key", "whole").hint("merge"), ["key", "whole"]).withColumn("kind", kind).select(*span)
    crowded = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"))
    wanted = classes.join(crowded, "key").withColumn("hot", F.col("classes") > hot).withColumn("kind", kind)
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("kind", "p", "more", "key", "n", "hot")).alias("wanted"))

    def cut(batches):
        for row, text, asked in rows_of(batches, "row", "text", "wanted"):
            cuts: dict[int, np.ndarray] = {}
            for w in asked:
                kind, p = w["kind"], w["p"]
                if kind not in cuts:
                    cuts[kind] = units[kind].of(text)
                yield kind, row, p, w["key"], w["n"], w["hot"], cuts[kind][p : p + w["more"] + units[kind].length].tobytes()

    # Repeated rows have one name and one text; each of their stretches is wanted once.
    texts = docs.select("row", "text").join(wanted, "row")
    pieces = written(map_rows(texts, cut, "kind byte, row binary, p int, key long, n long, hot boolean, bytes binary", size=1024).dropDuplicates(["kind", "row", "p"]), "stretches")

    def searched(batches):
        """Keys come together. A family ends where a batch does, unless a key goes on."""
        family, held, size, stack, now = None, [], 0, [], None

        def flush():
            nonlocal held, size
            family.add([x[3] for x in held])
            unit = units[now[0]]
            stack.extend((r, p, n, len(x) // unit.size - unit.length + 1) for r, p, n, x in held)
            held, size = [], 0

        def results():
            nonlocal family, stack
            if held:
                flush()
            marks, at, kind = family.marks(), 0, now[0]
            for row, p, n, starts in stack:
                if n == 1:
                    yield from ((row, kind, a, b) for a, b in _spans(marks[at : at + starts], p, units[kind].length))
                at += starts
            family, stack = None, []

        for kind, row, p, key, n, data in rows_of(batches, "kind", "row", "p", "key", "n", "bytes"):
            if size >= BATCH_BYTES:
                flush()
            if family is not None and now != (kind, key) and (size == 0 or now[0] != kind):
                yield from results()
            now = (kind, key)
            if family is None:
                family = Family(units[kind].length * units[kind].size, units[kind].size)
            held.append((row, p, n, data))
            size += len(data)
        if family is not None:
            yield from results()

    cold = pieces.where(~F.col("hot")).repartition("key").sortWithinPartitions(F.col("kind"), "key", "row", "p")
    partly = map_rows(cold, searched, "row binary, kind byte, begin int, finish int", size=4096)

    def digests(batches):
        from xxhash import xxh3_128_intdigest

        for kind, row, p, data in rows_of(batches, "kind", "row", "p", "bytes"):
            unit = units[kind]
            for i in range(0, len(data) - unit.length * unit.size + 1, unit.size):
                d = xxh3_128_intdigest(data[i : i + unit.length * unit.size])
                yield row, kind, p + i // unit.size, (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (d >> 64) - (1 << 63)

    single = map_rows(pieces.where("hot"), digests, "row binary, kind byte, begin int, d1 long, d2 long", size=4096)
    again = single.groupBy("kind", "d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "d1", "d2")
    crowd = single.join(again, ["kind", "d1", "d2"]).select("row", "kind", "begin", (F.col("begin") + length).alias("finish"))
    # A row may be there several times; its spans are wanted once.
    out = written(agreed.union(twice).union(partly).union(crowd).distinct(), "spans", 1 << 14)
    forget(kept, classes, pieces)
    return out


def removed(docs: DataFrame, *units: Unit, hot: int = HOT) -> DataFrame:
    """(doc_id, text) to (doc_id, text, spans): the spans of each unit that repeated strings cover, sorted; some overlap or touch.

    ``spans`` has (kind, begin, finish), ``kind`` counting the units from 0.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", row_name())
    spans = repeated_spans(rows, units or (BYTES,), hot)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "begin", "finish"))).alias("spans"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans")


def joined_spans(spans: list[dict] | None, kind: int = 0) -> list[tuple[int, int]]:
    """Sorted spans of a kind, joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if s["kind"] != kind:
            continue
        if out and s["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["finish"]))
        else:
            out.append((s["begin"], s["finish"]))
    return out


def query(docs: DataFrame) -> DataFrame:
    """op8: what goes of every text, and the checksum of the rest; also the words in passages of over 50 words that stand anywhere else."""

    def told(batches):
        for doc, text, spans in rows_of(batches, "doc_id", "text", "spans"):
            data, at, kept, gone = text.encode(), 0, hashlib.sha256(), joined_spans(spans)
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            words = sum(b - a for a, b in joined_spans(spans, 1))
            yield doc, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), words

    return map_rows(removed(docs, BYTES, WORDS), told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long", size=4096)
