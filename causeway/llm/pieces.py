"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The models are byte-fallback BPE vocabularies. A sequence of pieces is the BPE
encoding of its text exactly if every two neighbours are the encoding of their
own concatenation, so encoding is a search for the one path whose steps all
weigh 0 where a wrong step weighs minus infinity: a max-plus chain over "the
piece that covers this place".

Texts longer than ``CHUNK`` characters are cut there, wherever that falls. Each
chunk yields the matrix from pieces across its left bound to pieces across its
right one; the matrices of a document are multiplied in the max-plus semiring by
an associative scan from either side; where both agree is the piece across each
bound, and every chunk is then traced back on its own. Inside a chunk the part
between two word starts has one encoding whatever surrounds it, since no piece
holds a word start inside, and is looked up word by word.

Defined results: null and empty texts have no ids; repeated rows are encoded
each; a white block character in a text decodes as a blank, as in the library;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of, written

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk; longer texts are cut.
CHUNK = 16384
MEMORY = 300_000
BLOCK = "▁"
NO = -np.inf


class Pieces:
    """A model's vocabulary, its merges and remembered encodings of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = {lib.id_to_piece(i): i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(lib.get_piece_size()) if lib.is_byte(i)}
        self.longest = max(map(len, self.ids))
        if any(BLOCK in p.lstrip(BLOCK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a word start or line break inside")
        self.out = [b""] * lib.get_piece_size()
        for p, i in self.ids.items():
            self.out[i] = p.replace(BLOCK, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes((b,))
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short normalised string: the best-scored pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def usable(self, piece: str) -> bool:
        """May the string be one step of an encoding?"""
        return len(piece) == 1 or (piece in self.ids and self.pair(piece, ""))

    def pair(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == ([a, b] if b else [a])
        return found

    def ids_of(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return np.array(out, "<u2").tobytes()

    def encode_units(self, text: str) -> bytes:
        """Ids of normalised text that begins at a word start or line break."""
        if "\n" not in text and BLOCK * 2 not in text:
            units = text.split(BLOCK)[1:]
        else:
            units = [u[1:] if u[0] == BLOCK and u[1:2] != BLOCK else u for u in _UNIT.findall(text)]
        known = self.units
        try:
            return b"".join(map(known.__getitem__, units))
        except KeyError:
            pass
        if len(known) > MEMORY:
            known.clear()
        new = [u for u in set(units) if u not in known]
        # The library puts a word start in front of what it gets.
        plain = [u for u in new if u[:1] != "\n"]
        texts = [u[1:].replace(BLOCK, " ") if u[:1] == BLOCK else u for u in plain]
        for u, e in zip(plain, self.library.encode(texts, num_threads=1), strict=True):
            known[u] = np.array(e, "<u2").tobytes() if u else self.ids_of([BLOCK])
        for u in new:
            if u[:1] == "\n":
                known[u] = self.ids_of(["\n"]) + self.ids_of(self.merged_long(u[1:]))
        return b"".join(map(known.__getitem__, units))

    def merged_long(self, text: str) -> list[str]:
        """As ``merged``; long strings without word starts go through the path search."""
        if len(text) <= 2 * self.longest:
            return self.merged(text)
        reach = self.walk(text, {0: {-1: 1}}, 0, len(text))
        return [text[a:b] for a, b in trace(reach, len(text), 0, 1, lambda s, p, q: self.pair(text[s:p], text[p:q]) if s >= 0 else True)]

    def walk(self, s: str, reach: dict[int, dict[int, int]], begin: int, end: int) -> dict[int, dict[int, int]]:
        """Steps of weight 0 from the given states until each path is at or past ``end``.

        ``reach[p][q]`` holds, as bits, the entries from which the piece s[q:p]
        is reached; q is -1 where nothing stands before.
        """
        for p in range(begin, end):
            here = reach.get(p)
            if not here:
                continue
            for q in range(p + 1, min(len(s), p + self.longest) + 1):
                piece = s[p:q]
                if not self.usable(piece):
                    continue
                bits = 0
                for before, entries in here.items():
                    if before < 0 or self.pair(s[before:p], piece):
                        bits |= entries
                if bits:
                    at = reach.setdefault(q, {})
                    at[p] = at.get(p, 0) | bits
        return reach


_UNIT = re.compile(f"{BLOCK}+[^{BLOCK}\n]*|\n[^{BLOCK}\n]*")


def normalised(text: str) -> str:
    return BLOCK + text.replace(" ", BLOCK) if text else ""


def trace(reach: dict, end: int, begin: int, bit: int, valid, last: int | None = None) -> list[tuple[int, int]]:
    """The pieces (from, to) of the one path from ``begin`` to ``end``."""
    out, p, q, after = [], end, last, None
    while p > begin:
        if q is None:
            # Among the states that the entry reaches, the step onward decides.
            options = [x for x, entries in reach[p].items() if entries & bit and (after is None or valid(x, p, after))]
            q = options[0]
        if q < begin:
            break
        out.append((q, p))
        p, q, after = q, None, p
    return out[::-1]


class Chunk:
    """A stretch [left, right) of the normalised string ``s``, which goes on around it.

    A state at a bound is the piece across or up to it, as (characters before,
    characters after) packed in one int; 0 is the bound of the text itself.
    """

    def __init__(self, pieces: Pieces, s: str, left: int, right: int):
        self.pieces, self.s, self.left, self.right = pieces, s, left, right
        starts = [i for i in range(left, right + 1) if i < len(s) and self.is_start(i)]
        self.first, self.last = (starts[0], starts[-1]) if starts else (None, None)

    def is_start(self, i: int) -> bool:
        """No piece reaches over this place, whatever the surroundings."""
        s = self.s
        return i == 0 or (s[i] == BLOCK and s[i - 1] != BLOCK) or s[i] == "\n"

    def states(self, bound: int) -> list[int]:
        s, long = self.s, self.pieces.longest
        if bound in (0, len(s)):
            return [0]
        return [n << 8 | r for n in range(1, min(long, bound) + 1) for r in range(0, min(long - n, len(s) - bound) + 1) if self.pieces.usable(s[bound - n : bound + r])]

    def _from_left(self) -> tuple[list[int], dict[int, dict[int, int]]]:
        """The walk from all entries up to the first word start, or to the right bound."""
        entries, reach = self.states(self.left), {}
        for k, e in enumerate(entries):
            at = reach.setdefault(self.left + (e & 255), {})
            q = self.left - (e >> 8) if e else -1
            at[q] = at.get(q, 0) | 1 << k
        end = self.right if self.first is None else self.first
        return entries, self.pieces.walk(self.s, reach, self.left, end)

    def _to_right(self) -> dict[int, dict[int, int]]:
        return self.pieces.walk(self.s, {self.last: {-1: 1}}, self.last, self.right)

    def _exits(self, reach: dict) -> dict[int, int]:
        """State at the right bound: the entries that reach it."""
        if self.right == len(self.s):
            bits = 0
            for x in reach.get(self.right, {}).values():
                bits |= x
            return {0: bits} if bits else {}
        return {(self.right - q) << 8 | (p - self.right): bits for p in range(self.right, self.right + self.pieces.longest) for q, bits in reach.get(p, {}).items() if 0 <= q < self.right}

    def matrix(self) -> list[int]:
        """(entry, exit) pairs of weight 0, one after the other; all others weigh minus infinity."""
        entries, reach = self._from_left()
        if self.first is None:
            exits = self._exits(reach)
        else:
            bits = 0
            for x in reach.get(self.first, {}).values():
                bits |= x
            if self.last < self.right:
                exits = dict.fromkeys(self._exits(self._to_right()), bits)
            elif self.first < self.last:
                # The right bound is a word start: the last word's last piece is the state.
                begin = next(i for i in range(self.last - 1, -1, -1) if self.is_start(i))
                exits = dict.fromkeys(self._exits(self.pieces.walk(self.s, {begin: {-1: 1}}, begin, self.right)), bits)
            else:
                exits = self._exits(reach)
        return [x for state, bits in exits.items() for k, e in enumerate(entries) if bits >> k & 1 for x in (e, state)]

    def ids(self, entry: int, exit_: int) -> bytes:
        """Ids of the pieces after the entry's up to the exit's."""
        s, valid = self.s, lambda a, p, b: a < 0 or self.pieces.pair(s[a:p], s[p:b])
        entries, reach = self._from_left()
        bit, begin = 1 << entries.index(entry), self.left + (entry & 255)
        end, last = (self.right + (exit_ & 255), self.right - (exit_ >> 8)) if exit_ else (self.right, None)
        if self.first is None or (self.first == self.last == self.right):
            return self.pieces.ids_of([s[a:b] for a, b in trace(reach, end, begin, bit, valid, last)])
        out = self.pieces.ids_of([s[a:b] for a, b in trace(reach, self.first, begin, bit, valid)])
        if self.first < self.last:
            out += self.pieces.encode_units(s[self.first : self.last])
        if self.last < self.right:
            out += self.pieces.ids_of([s[a:b] for a, b in trace(self._to_right(), end, self.last, 1, valid, last)])
        return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NO)


def scan(items: list, op) -> list:
    """All prefixes under an associative operation, in a logarithmic number of rounds."""
    if len(items) < 2:
        return list(items)
    pairs = [op(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)]
    inner, out = scan(pairs, op), [items[0]]
    for i in range(1, len(items)):
        out.append(inner[i // 2] if i % 2 else op(inner[i // 2 - 1], items[i]))
    return out


def bounds(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entry, exit) of every chunk on the one path through all of them."""
    names = [[0]]
    for k, flat in enumerate(matrices):
        ahead = set(matrices[k + 1][::2]) if k + 1 < len(matrices) else {0}
        names.append(sorted(ahead & set(flat[1::2])))
    dense = []
    for k, flat in enumerate(matrices):
        rows, columns = ({x: i for i, x in enumerate(names[k + d])} for d in (0, 1))
        m = np.full((len(rows), len(columns)), NO)
        for a, b in zip(flat[::2], flat[1::2], strict=True):
            if a in rows and b in columns:
                m[rows[a], columns[b]] = 0.0
        dense.append(m)
    ahead = [np.zeros((1, 1)), *scan(dense, combine)]
    behind = [np.zeros((1, 1)), *scan([m.T for m in dense[::-1]], combine)][::-1]
    states = [names[k][int(np.argmax(ahead[k][0] + behind[k][0]))] for k in range(len(names))]
    return list(zip(states, states[1:], strict=False))


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def model_path(model: str | None = None) -> str:
    import public_tokenizers

    model = model or MODEL
    return model if "/" in model else public_tokenizers.path(model)


def decode(pieces: Pieces, ids: bytes) -> str:
    """The text of little-endian 16-bit ids; broken byte runs become replacement characters."""
    out = b"".join(map(pieces.out.__getitem__, np.frombuffer(ids, "<u2").tolist()))
    return out.decode(errors="replace")[1:]


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) to (doc_id, n_chunks, ids binary: little-endian 16-bit)."""
    long = F.coalesce(F.length("text") + 1 > chunk, F.lit(False))
    rows = docs.select("doc_id", "text")

    def short(batches):
        pieces = _pieces(model_path(model))
        for doc, text in rows_of(batches, "doc_id", "text"):
            yield doc, 1 if text else 0, pieces.encode_units(normalised(text)) if text else b""

    def cut(batches):
        reach = _pieces(model_path(model)).longest + 1
        for doc, text, copies in rows_of(batches, "doc_id", "text", "copies"):
            s = normalised(text)
            key, n = hashlib.sha256(text.encode()).hexdigest(), -(-len(s) // chunk)
            for k in range(n):
                left, right = k * chunk, min((k + 1) * chunk, len(s))
                # At an inner bound the surroundings go as far as any piece, and no bound looks like the text's own.
                low, high = max(0, left - reach), min(len(s), right + reach)
                yield doc, key, copies, k, n, s[low:high], left - low, right - low

    def transfer(batches):
        pieces = _pieces(model_path(model))
        for doc, key, k, s, left, right in rows_of(batches, "doc_id", "key", "chunk", "s", "at", "until"):
            yield doc, key, k, Chunk(pieces, s, left, right).matrix()

    def scanned(batches):
        now, own = None, []
        for doc, key, _, matrix in rows_of(batches, "doc_id", "key", "chunk", "matrix"):
            if (doc, key) != now and own:
                yield from ((*now, k, *b) for k, b in enumerate(bounds(own)))
                own = []
            now = doc, key
            own.append(matrix)
        if own:
            yield from ((*now, k, *b) for k, b in enumerate(bounds(own)))

    def traced(batches):
        pieces = _pieces(model_path(model))
        for doc, key, copies, k, n, s, left, right, entry, exit_ in rows_of(batches, "doc_id", "key", "copies", "chunk", "n", "s", "at", "until", "entry", "exit"):
            yield doc, key, copies, k, n, Chunk(pieces, s, left, right).ids(entry, exit_)

    def assembled(batches):
        now, own = None, []
        for doc, key, copies, _, n, ids in rows_of(batches, "doc_id", "key", "copies", "chunk", "n", "ids"):
            if (doc, key, copies, n) != now and own:
                yield from ((now[0], now[3], b"".join(own)) for _ in range(now[2]))
                own = []
            now = doc, key, copies, n
            own.append(ids)
        if own:
            yield from ((now[0], now[3], b"".join(own)) for _ in range(now[2]))

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("doc_id", "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key", "chunk")

    whole = map_rows(rows.where(~long), short, "doc_id long, n_chunks int, ids binary")
    giants = rows.where(long).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    chunks = map_rows(giants, cut, "doc_id long, key string, copies long, chunk int, n int, s string, at int, until int", size=64)
    chunks = written(chunks.repartition("doc_id", "key", "chunk"), "piece-chunks")
    matrices = map_rows(chunks, transfer, "doc_id long, key string, chunk int, matrix array<int>")
    path = map_rows(in_order(matrices), scanned, "doc_id long, key string, chunk int, entry int, exit int", size=4096)
    on = chunks.doc_id.eqNullSafe(path.doc_id) & (chunks.key == path.key) & (chunks.chunk == path.chunk)
    both = chunks.join(path, on).select(*(chunks[c] for c in chunks.columns), "entry", "exit")
    parts = map_rows(both, traced, "doc_id long, key string, copies long, chunk int, n int, ids binary")
    return whole.union(map_rows(in_order(parts), assembled, "doc_id long, n_chunks int, ids binary"))


def described(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_chunks, n_tokens, ids_crc32, decoded_sha256) from encoded documents."""

    def read(batches):
        pieces = _pieces(model_path(model))
        for doc, n, ids in rows_of(batches, "doc_id", "n_chunks", "ids"):
            wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
            yield doc, n, len(ids) // 2, zlib.crc32(wide), hashlib.sha256(decode(pieces, ids).encode()).hexdigest()

    return map_rows(encoded, read, "doc_id long, n_chunks int, n_tokens long, ids_crc32 long, decoded_sha256 string", size=4096)


def query(docs: DataFrame) -> DataFrame:
    """op10: ids of every text as the library gives them, and the text that they decode to."""
    return described(encode(docs))
