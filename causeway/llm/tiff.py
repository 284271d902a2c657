"""TIFF media columns: a reader that yields one row a page, and a plain writer.

The reader walks the chain of image directories of a classic TIFF of either
byte order, reads strips or tiles of 1- to 32-bit integer samples, chunky or
planar, undoes no compression, PackBits, LZW or deflate and then the horizontal
predictor, and cuts tiles to the image.

Defined results: a null or empty media value, one that is not a TIFF, and one
whose directories are cut off or use another compression give one row with
``error`` set and no pixels; pages before a fault are kept. A directory chain
that returns to an earlier directory ends there. Repeated rows are read again;
further columns are kept, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, rows_of, written

# Fixed values of the TIFF 6.0 format: field types, tags and compression codes.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

PAYLOAD_UNIT = 192
PAGE_ROWS = 2048
STRIP_ROWS = 256


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one code early, 256 clears, 257 ends."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, last, held, bits = [], 9, None, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # The decoder's table is one entry behind; widths follow the decoder.
        width = max(9, size.bit_length())
        if size >= 4094:
            put(256)
            table = {bytes((i,)): i for i in range(256)}
            size, width = 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise TiffError(str(e)) from None


DECODERS = {NONE: bytes, PACKBITS: unpack_bits, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
ENCODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Each image directory: (byte order, values by tag)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if kind not in TYPE_SIZES:
                    continue
                where = at + 10 + 12 * i
                if TYPE_SIZES[kind] * count > 4:
                    where = struct.unpack_from(order + "I", data, where)[0]
                letter = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
                if letter:
                    fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
            yield order, fields
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error:
            raise TiffError("a directory is cut off") from None


def _block(data: bytes, order: str, fields: dict, offset: int, count: int, rows: int, width: int, bits: int, samples: int) -> np.ndarray:
    """One decoded strip or tile: rows x width x samples; missing bytes are zero."""
    code = fields.get(COMPRESSION, (NONE,))[0]
    if code not in DECODERS:
        raise TiffError(f"compression {code}")
    if offset + count > len(data):
        raise TiffError("image data is cut off")
    raw = DECODERS[code](data[offset : offset + count])
    line = -(-width * samples * bits // 8)
    raw = raw[: rows * line].ljust(rows * line, b"\0")
    if bits < 8:
        flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : width * samples * bits]
        return (flat.reshape(rows, width, samples, bits) @ (1 << np.arange(bits)[::-1])).astype(np.uint8)
    kind = np.dtype(f"{order}u{bits // 8}")
    out = np.frombuffer(raw, kind).reshape(rows, width, samples)
    if fields.get(PREDICTOR, (1,))[0] == 2:
        out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
    elif fields.get(PREDICTOR, (1,))[0] != 1:
        raise TiffError("predictor")
    return out.astype(kind.newbyteorder("="))


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(width, height, samples, bits, pixels) of each page; pixels are little-endian, chunky."""
    for order, f in directories(data):
        try:
            width, height = f[WIDTH][0], f[HEIGHT][0]
            samples, bits = f.get(SAMPLES, (1,))[0], f.get(BITS, (1,))[0]
            planes = samples if f.get(PLANAR, (1,))[0] == 2 else 1
            if bits not in (1, 2, 4, 8, 16, 32):
                raise TiffError(f"{bits} bits")
            tiled = TILE_OFFSETS in f
            offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
            wide, high = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(f.get(ROWS_PER_STRIP, (height,))[0], height))
        except KeyError as e:
            raise TiffError(f"tag {e} is missing") from None
        out = np.zeros((height, width, samples), np.dtype(f"u{max(1, bits // 8)}"))
        across, down = (-(-width // wide), -(-height // high)) if width and height else (0, 0)
        if len(offsets) < across * down * planes or len(counts) < len(offsets):
            raise TiffError("strips or tiles are missing")
        for i in range(across * down * planes):
            plane, cell = divmod(i, across * down)
            y, x = cell // across * high, cell % across * wide
            rows = high if tiled else min(high, height - y)
            part = _block(data, order, f, offsets[i], counts[i], rows, wide, bits, samples // planes)
            own = slice(plane, plane + 1) if planes > 1 else slice(None)
            out[y : y + rows, x : x + wide, own] = part[: height - y, : width - x]
        yield width, height, samples, bits, out.astype(out.dtype.newbyteorder("<")).tobytes()


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of unsigned images (rows x width, or rows x width x samples), one page each."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        kind = image.dtype.newbyteorder(order)
        wide, high = tile or (width, strip_rows)
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = image[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
                packed = ENCODERS[compression](part.astype(kind).tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * kind.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, type_, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if type_ == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, type_, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(text: str | None) -> tuple[int, bytes]:
    """A text's length in bytes and its payload as the pages of a TIFF."""
    data = (text or "").encode()
    payload = data.ljust(max(1, -(-len(data) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b" ")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_UNIT)
    return len(data), write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], DEFLATE, predictor=2)


def decode_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a page: the other columns, then page, width, height, samples, bits, pixels, error."""
    names = [c for c in media.columns if c != column]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != column)

    def read(batches):
        for *rest, data in rows_of(batches, *names, column):
            number = 0
            try:
                for page in pages(data or b""):
                    yield *rest, number, *page, None
                    number += 1
            except TiffError as e:
                yield *rest, number, None, None, None, None, None, str(e)

    return map_rows(media, read, f"{kinds}, page int, width int, height int, samples int, bits int, pixels binary, error string", size=64)


def query(docs: DataFrame) -> DataFrame:
    """op5: stores every text as a TIFF, reads its pages back and describes them.

    ``feature``: pages, mean and standard deviation of the samples, and the
    shares of 16 equal sample ranges in hexadecimal thousandths.
    """

    def stored(batches):
        for doc, text in rows_of(batches, "doc_id", "text"):
            n, media = store(text)
            yield doc, n, len(media), hashlib.sha256(media).hexdigest(), media

    def described(batches):
        """Pages of a document follow each other: page 0 begins the next one."""
        now, parts = None, []

        def row():
            payload = b"".join(parts)
            x = np.frombuffer(payload, np.uint8)
            bins = np.bincount(x, minlength=256).reshape(16, 16).sum(axis=1)
            feature = f"{len(parts)}:{x.mean():.4f}:{x.std():.4f}:" + "".join(f"{int(b * 1000 // len(x)):03x}" for b in bins)
            return now[0], now[1], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), now[2], now[3], feature

        for doc, n, size, digest, page, pixels, error in rows_of(batches, "doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pixels", "error"):
            if error:
                raise TiffError(error)
            if page == 0:
                if now:
                    yield row()
                now, parts = (doc, n, size, digest), []
            parts.append(pixels)
        if now:
            yield row()

    media = written(map_rows(docs.select("doc_id", "text"), stored, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary"), "media")
    return map_rows(decode_pages(media), described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
