"""Token ids in wavelet-matrix files: one self-contained compressed file a shard.

A shard holds the ids of consecutive documents in ascending ``doc_id`` order.
Its bytes are

    magic ``WMX2``, then little-endian u32: bits, ids, documents, bytes of the packed starts;
    the directory, for each bit from the highest u32: zeros of the plane, then for each
    block of 512 words the ones before it and its packed bytes;
    u64 document starts (documents + 1), a Zstandard frame;
    the blocks of all planes in that order, each a Zstandard frame of u64 words.

A plane holds that bit of all ids in the order that a stable sort by the higher
bits leaves them in. The directory takes 64 bits for 32,768 of a plane; a look-up
inflates one block a plane and counts inside it, and from such ranks come access,
counting and the places of an id, without the rest of the file. Files are stored
as rows of a Parquet table (``shard``, ``first``, ``payload``), so that every
store that Spark can write holds them; ``payload`` alone is the file.

Defined results: null text is empty and yields the end id alone; equal doc_ids
follow each other in the order of their texts; null doc_ids come first; an empty
table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress
from functools import cache
from itertools import chain, groupby, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of, sliced, written

MAGIC = b"WMX2"
#: Words of a block, which is inflated as a whole.
BLOCK_WORDS = 512
#: Ids a shard holds at least before it is closed; a document is never split.
SHARD_IDS = 1 << 18
#: Encoded words of a generation; a worker remembers two, some 400 MB.
MEMORY_WORDS = 1_000_000
END_ID = 2
#: Words that go to the library as one text.
TOGETHER = 500
#: 1: ASCII letters and digits; 2: punctuation that never continues a word (an apostrophe does, in contractions).
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KINDS[list(b".,;:!?*#$%&|()[]{}/+=-_")] = 2
TOKENIZER = "word_bpe_49k.json"


class WaveletMatrix:
    """Ids below 2**bits with access, rank and select on succinct bit planes.

    ``planes`` are whole blocks of words; those of a file are empty until a
    look-up needs them.
    """

    def __init__(self, planes: list[np.ndarray], zeros: list[int], before: list[np.ndarray], n: int, starts: np.ndarray):
        self.planes, self.zeros, self.before, self.n, self.starts, self.bits = planes, zeros, before, n, starts, len(planes)
        self._packed: list[list[bytes | memoryview | None]] = [[None] * len(x) for x in before]
        self._inside: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def blocks(n: int) -> int:
        """Blocks of a plane of n bits, with a place left after the last one."""
        return n // (64 * BLOCK_WORDS) + 1

    @classmethod
    def of(cls, ids: np.ndarray, starts: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids, dtype=np.uint32)
        bits, blocks = bits or max(1, int(ids.max(initial=1)).bit_length()), cls.blocks(len(ids))
        now, planes, zeros, before = ids.astype(np.uint16) if bits <= 16 else ids, [], [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)).astype(bool)
            plane = np.zeros(8 * BLOCK_WORDS * blocks, np.uint8)
            plane[: -(-len(ids) // 8)] = np.packbits(bit, bitorder="little")
            planes.append(plane.view("<u8"))
            ones = np.bitwise_count(planes[-1]).reshape(blocks, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
            before.append(np.cumsum(ones) - ones)
            left = now.take(np.flatnonzero(~bit))  # much faster than a mask
            zeros.append(len(left))
            now = np.concatenate((left, now.take(np.flatnonzero(bit))))
        return cls(planes, zeros, before, len(ids), np.asarray(starts, dtype=np.uint64))

    def to_bytes(self) -> bytes:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1).compress
        starts = pack(self.starts.astype("<u8").tobytes())
        packed = [[pack(x) for x in p.reshape(-1, BLOCK_WORDS)] for p in self.planes]
        table = [np.concatenate(([z], np.stack((b, [len(x) for x in p]), axis=1).ravel())) for z, b, p in zip(self.zeros, self.before, packed, strict=True)]
        head = struct.pack("<4I", self.bits, self.n, len(self.starts) - 1, len(starts))
        return b"".join((MAGIC, head, np.concatenate(table).astype("<u4").tobytes(), starts, *chain.from_iterable(packed)))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """Reads the directory and the starts; blocks stay packed."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        bits, n, documents, size = struct.unpack_from("<4I", data, 4)
        blocks = cls.blocks(n)
        table = np.frombuffer(data, "<u4", bits * (1 + 2 * blocks), 20).reshape(bits, -1)
        at = 20 + table.nbytes
        starts = np.frombuffer(cls._unpack(data[at : at + size]), "<u8", documents + 1)
        counts = table[:, 1:].reshape(bits, blocks, 2).astype(np.int64)
        out = cls([np.zeros(blocks * BLOCK_WORDS, "<u8") for _ in range(bits)], table[:, 0].tolist(), list(counts[:, :, 0]), n, starts)
        ends, view = at + size + np.cumsum(counts[:, :, 1].ravel()), memoryview(data)
        edges = [at + size, *ends.tolist()]
        streams = [view[a:b] for a, b in pairwise(edges)]
        out._packed = [streams[i * blocks : (i + 1) * blocks] for i in range(bits)]
        return out

    @staticmethod
    def _unpack(frame) -> bytes:
        from zstandard import ZstdDecompressor

        return ZstdDecompressor().decompress(frame)

    def inflated(self) -> int:
        """How many blocks of the file have been inflated."""
        return sum(x is None for p in self._packed for x in p)

    def _block(self, level: int, block: int) -> np.ndarray:
        """The words of a block, inflated on first use."""
        words = self.planes[level][block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS]
        if (packed := self._packed[level][block]) is not None:
            words[:] = np.frombuffer(self._unpack(packed), "<u8")
            self._packed[level][block] = None
        return words

    def _plane(self, level: int) -> np.ndarray:
        for k, packed in enumerate(self._packed[level]):
            if packed is not None:
                self._block(level, k)
        return self.planes[level]

    def _ones(self, level: int, block: int) -> np.ndarray:
        """Ones of a block before each of its words."""
        if (level, block) not in self._inside:
            counts = np.bitwise_count(self._block(level, block))
            self._inside[level, block] = (np.cumsum(counts, dtype=np.int32) - counts).astype(np.uint16)
        return self._inside[level, block]

    def _bits(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bit at each place, ones before each place)."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        block = word // BLOCK_WORDS
        inside, own = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        for k in np.unique(block).tolist():
            here = block == k
            place = word[here] - k * BLOCK_WORDS
            inside[here], own[here] = self._ones(level, k)[place], self._block(level, k)[place]
        ones = self.before[level][block] + inside + np.bitwise_count(own & ((np.uint64(1) << shift) - np.uint64(1)))
        return (own >> shift) & np.uint64(1), ones

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bits(level, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit.astype(np.uint32)
        return out

    def decode(self) -> np.ndarray:
        """All ids in order: undoes each stable split, from the lowest plane up."""
        now = None
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self._plane(level).view(np.uint8), count=self.n, bitorder="little").view(bool)
            shape = np.uint16 if self.bits <= 16 else np.uint32
            own = np.zeros(self.n, shape) if now is None else now
            zeros, put = self.zeros[level], np.empty(self.n, shape)
            put[np.flatnonzero(~bit)] = own[:zeros]
            put[np.flatnonzero(bit)] = own[zeros:] | shape(1 << (self.bits - 1 - level))
            now = put
        return (now if now is not None else np.zeros(self.n)).astype(np.uint32)

    def rank(self, token: int, end: int) -> int:
        """How often the id occurs before ``end``."""
        lo, hi = 0, min(end, self.n)
        for level, zeros in enumerate(self.zeros):
            a, b = self._bits(level, np.array([lo, hi]))[1].tolist()
            lo, hi = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo if token < 1 << self.bits else 0

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence (from 0); -1 if there are fewer."""
        if nth < 0 or nth >= self.rank(token, self.n):
            return -1
        lo = 0
        for level, zeros in enumerate(self.zeros):
            a = int(self._bits(level, np.array([lo]))[1][0])
            lo = zeros + a if token >> (self.bits - 1 - level) & 1 else lo - a
        at = lo + nth
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, at - self.zeros[level] if one else at, one)
        return at

    def _select_bit(self, level: int, nth: int, one: int) -> int:
        before = self.before[level]
        if not one:
            before = np.arange(len(before)) * 64 * BLOCK_WORDS - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        ones = self._ones(level, block).astype(np.int64)
        inside = ones if one else np.arange(BLOCK_WORDS) * 64 - ones
        nth -= int(before[block])
        word = int(np.searchsorted(inside, nth, side="right")) - 1
        bits = np.unpackbits(self._block(level, block)[word : word + 1].view(np.uint8), bitorder="little")
        return (block * BLOCK_WORDS + word) * 64 + int(np.flatnonzero(bits == one)[nth - int(inside[word])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, i) for i in range(self.rank(token, self.n))]


#: Stands between texts; no UTF-8 text holds this byte.
_END = b"\xff"


def parted(texts: list[bytes]) -> list[bytes]:
    """The parts of some texts, each text's followed by ``_END``; the tokenizer encodes a part as it would inside the text.

    It drops white space, so ASCII white space parts. It lowers case first, so
    ASCII letters may be lowered here. It splits between a letter or digit and
    punctuation that is no apostrophe, whatever surrounds them, so those part
    too. Special tokens hold punctuation and are as they are written: a text that
    may have one is only parted at white space.
    """
    out: list[bytes] = []
    for special, group in groupby(texts, key=lambda t: b"<|" in t):
        data = b"".join(t + b" \xff " for t in group)
        if special:
            out += data.split()
            continue
        x = np.frombuffer(data, np.uint8)
        kinds = _KINDS[x]
        before = np.flatnonzero((kinds[:-1] == 1) & (kinds[1:] == 2)) + 1
        out += (np.insert(x, before, 32).tobytes() if len(before) else data).lower().split()
    return out


class Encoder:
    """Encodes with the tokenizers library and remembers the ids of single parts.

    New parts of a batch go to the library together. Two generations of parts
    are remembered: what was not looked up in a generation is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: The same model without what does nothing to words of lower-case ASCII letters.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        #: Ids that end a word; a word of lower-case letters has one of them, at its end.
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        if len(self.known) > MEMORY_WORDS:
            self.known, self.older = {}, self.known
        parts = parted([t.encode() for t in texts])
        found = list(map(self.known.get, parts))
        missing, at = [], -1
        with suppress(ValueError):  # raised at the end of the list
            while True:
                missing.append(at := found.index(None, at + 1))
        if missing:
            self.learn({parts[i] for i in missing}.difference((_END,)))
            for i in missing:
                found[i] = self.known.get(parts[i], b"")
        out, at = [], 0
        for _ in texts:
            end = parts.index(_END, at)
            out.append(b"".join(found[at:end]))
            at = end + 1
        return out

    def learn(self, new: set[bytes]) -> None:
        known, older = self.known, self.older
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        words = new.difference(again)
        plain = {w for w in words if w.isalpha() and w.islower()}  # of bytes: ASCII only
        letters = {w for w in words - plain if (t := w.decode()).isalpha() and t == t.lower()}
        for model, some in ((self.words, plain), (self.tokenizer, letters)):
            listed = list(some)
            lines = [listed[i : i + TOGETHER] for i in range(0, len(listed), TOGETHER)]
            for own, e in zip(lines, model.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u2")
                cuts, data = [0, *(2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()], ids.tobytes()
                known.update(zip(own, [data[a:b] for a, b in pairwise(cuts)], strict=True))
        other = list(words - plain - letters)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        known.update(zip(other, [array("H", e.ids).tobytes() for e in found], strict=True))


@cache
def encoder(path: str) -> Encoder:
    """One for each worker, so that words are remembered from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(doc_id, text) to shards: (shard, ahead: ids of its slice before it, n_ids, doc_ids, payload)."""
    name = tokenizer or TOKENIZER

    def shards(batches) -> Iterator[tuple]:
        import public_tokenizers

        words = encoder(name if "/" in name else public_tokenizers.path(name))
        tail, number = np.array([end_id], dtype="<u2").tobytes(), 0
        open_slice, ids, docs_, held, ahead = None, [], [], 0, 0

        def close():
            nonlocal ids, docs_, held, number, ahead
            sizes = np.array([len(x) // 2 for x in ids], dtype=np.uint64)
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(ids), "<u2"), np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64))
            row = ((open_slice << 32) + number, ahead, held, docs_, matrix.to_bytes())
            ids, docs_, held, number, ahead = [], [], 0, number + 1, ahead + held
            return row

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, at, x in zip(b.column("doc_id").to_pylist(), b.column("slice").to_pylist(), words.ids(texts), strict=True):
                if docs_ and (at != open_slice or held >= shard_ids):
                    yield close()
                if at != open_slice:
                    number = ahead = 0
                open_slice = at
                x += tail
                ids.append(x)
                docs_.append(doc)
                held += len(x) // 2
        if docs_:
            yield close()

    return written(map_rows(sliced(docs.select("doc_id", "text")), shards, "shard long, ahead long, n_ids long, doc_ids array<long>, payload binary", size=4), "token-shards")


def read_documents(shards: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Opens every shard file: (doc_id, start, n_tokens, ids_crc32).

    End ids are looked up through the file's directory first: those of the first
    and last document by access, and their number by rank; then all ids are read.

    What reaches the driver is the number of ids of each slice; there are two
    slices a shuffle partition.
    """
    counts = shards.groupBy(F.shiftright("shard", 32).alias("slice")).agg(F.sum("n_ids").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(counts, key=lambda r: r["slice"]):
        before[r["slice"]] = at
        at += r["n"]

    def read(batches) -> Iterator[tuple]:
        for shard, ahead, ids, payload in rows_of(batches, "shard", "ahead", "doc_ids", "payload"):
            matrix, first = WaveletMatrix.from_bytes(payload), before[shard >> 32] + ahead
            starts = matrix.starts.astype(np.int64)
            if (matrix.access(starts[[1, -1]] - 1) != end_id).any() or matrix.rank(end_id, matrix.n) < len(ids):
                raise ValueError(f"shard {shard}: its documents do not end where its starts say")
            tokens = matrix.decode().astype("<u4")
            for doc, a, b in zip(ids, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield doc, first + a, b - a, zlib.crc32(tokens[a:b])

    return map_rows(shards, read, "doc_id long, start long, n_tokens long, ids_crc32 long", size=4096)


def query(docs: DataFrame) -> DataFrame:
    """op3: every document's place, length and checksum, read from the shard files."""
    return read_documents(encode_documents(docs))
