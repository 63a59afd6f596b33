"""Media columns: TIFF files in binary columns (operator 10).

``read_pages`` walks every image directory of a file, decodes its strips or tiles (none, PackBits,
LZW, deflate), undoes the predictor and gives one row per page.  ``write_tiff`` stores raw samples as
a multi-page TIFF.  ``text_media`` is the digest query's form: text -> padded payload -> TIFF ->
pages read back -> features.

Defined results: null text counts as empty; a null or empty media value has no pages; a damaged file
raises ``ValueError`` in ``read_pages`` and gives one row with ``error`` set in ``tiff_pages``, also one that
claims more than its bytes can hold.  Images of 1, 2 or 4 bits a sample are refused that way.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

# Fixed values of the TIFF 6.0 format.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325

#: Bytes that a stored byte can stand for (LZW: strings of up to 3839 bytes in 9 to 12 bits), and bytes of a strip or tile, at most.
EXPANSION, MOST_BLOCK = 4096, 1 << 30

#: Layout of stored payloads: bytes per row, rows per page, rows per strip.
ROW_BYTES, PAGE_ROWS, STRIP_ROWS = 192, 1024, 256


class Page(NamedTuple):
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes


# -- codecs ---------------------------------------------------------------------------------------


def packbits_encode(raw: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i > 2:
            out += bytes((257 - (j - i), raw[i]))
        else:
            while j < n and j - i < 128 and not (j + 2 < n and raw[j] == raw[j + 1] == raw[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += raw[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise ValueError("PackBits data ends early")
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out[:size])


def lzw_encode(raw: bytes) -> bytes:
    """MSB-first codes with the format's early width change."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    book: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    width, following, prefix = 9, 258, b""
    put(256, width)
    for i in range(len(raw)):
        longer = prefix + raw[i : i + 1]
        if longer in book:
            prefix = longer
            continue
        put(book[prefix], width)
        book[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            book = {bytes((k,)): k for k in range(256)}
            width, following = 9, 258
        elif following + 1 > 1 << width:
            width += 1
        prefix = raw[i : i + 1]
    if prefix:
        put(book[prefix], width)
        if following + 2 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    book = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, held, bits, made, last = 9, 0, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or made >= size:
            break
        if code == 256:
            del book[258:]
            width, last = 9, b""
            continue
        if code < len(book):
            entry = book[code]
        elif last and code == len(book):
            entry = last + last[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(entry)
        made += len(entry)
        if last:
            book.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(book) + 1).bit_length()))
    raw = b"".join(out)
    if len(raw) < size:
        raise ValueError("LZW data ends early")
    return raw[:size]


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data[:size]
    elif compression in (DEFLATE, DEFLATE_OLD):
        try:
            raw = zlib.decompressobj().decompress(data, size) if size else b""
        except zlib.error as e:
            raise ValueError(f"bad deflate data: {e}") from e
    elif compression == LZW:
        return lzw_decode(data, size)
    elif compression == PACKBITS:
        return packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression} is not supported")
    if len(raw) < size:
        raise ValueError("strip or tile ends early")
    return raw


def _encode(raw: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 6), DEFLATE_OLD: lambda b: zlib.compress(b, 6), LZW: lzw_encode, PACKBITS: packbits_encode}[compression](raw)


# -- reading --------------------------------------------------------------------------------------


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    end = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(end + "I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("bad image directory")
        seen.add(at)
        (n,) = struct.unpack_from(end + "H", data, at)
        if at + 6 + 12 * n > len(data):
            raise ValueError("image directory ends early")
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code is None:
                continue
            place = at + 10 + 12 * k
            if count * TYPE_SIZES[kind] > 4:
                (place,) = struct.unpack_from(end + "I", data, place)
            if place + count * TYPE_SIZES[kind] > len(data):
                raise ValueError("tag value ends early")
            tags[tag] = struct.unpack_from(f"{end}{count}{code}", data, place)
        yield end, tags
        (at,) = struct.unpack_from(end + "I", data, at + 2 + 12 * n)


def _unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """block: rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise ValueError(f"predictor {predictor} is not supported")


def read_pages(data: bytes | None) -> Iterator[Page]:
    """Pages of a TIFF file in the order of its directories.  Pixels are chunky, 8 or 16 bits little-endian."""
    if not data:
        return
    for index, (end, tags) in enumerate(_directories(data)):
        one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if width is None or height is None:
            raise ValueError("page without size")
        if bits not in (8, 16) or set(tags.get(BITS, (bits,))) != {bits}:
            raise ValueError(f"{tags.get(BITS)} bits a sample are not supported")
        kind = np.dtype({8: "u1", 16: end + "u2"}[bits])
        if samples < 1 or planar not in (1, 2):
            raise ValueError(f"{samples} samples in planar configuration {planar} are not supported")
        tiled = TILE_OFFSETS in tags
        if tiled:
            block_w, block_h, offsets, counts = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, ())
        else:
            block_w, block_h, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
        if not block_w or not block_h:
            if width * height:
                raise ValueError("empty strips or tiles")
            yield Page(index, width, height, samples, bits, compression, b"")
            continue
        across, down, deep = -(-width // block_w), -(-height // block_h), samples if planar == 2 else 1
        if len(offsets) < across * down * deep or len(counts) < across * down * deep:
            raise ValueError("too few strips or tiles")
        # No codec makes more of a byte than this, so what is claimed must be there before memory is taken for it.
        if width * height * samples * kind.itemsize > EXPANSION * max(1, sum(counts[: across * down * deep])) or sum(counts[: across * down * deep]) > EXPANSION * len(data):
            raise ValueError("the page is larger than its data can be")
        if block_w * block_h * kind.itemsize * samples > MOST_BLOCK:
            raise ValueError("a strip or tile is too large")
        image = np.empty((height, width, samples), kind.newbyteorder("="))
        per = samples // deep
        for k in range(across * down * deep):
            plane, rest = divmod(k, across * down)
            top, left = rest // across * block_h, rest % across * block_w
            rows = block_h if tiled else min(block_h, height - top)
            raw = _decode(data[offsets[k] : offsets[k] + counts[k]], compression, rows * block_w * per * kind.itemsize)
            block = _unpredict(np.frombuffer(raw, kind).astype(image.dtype).reshape(rows, block_w, per), predictor)
            h, w = min(rows, height - top), min(block_w, width - left)
            image[top : top + h, left : left + w, plane * per if deep > 1 else 0 : plane * per + per] = block[:h, :w]
        yield Page(index, width, height, samples, bits, compression, image.tobytes())


# -- writing --------------------------------------------------------------------------------------


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """A TIFF of 8-bit images, each rows x columns x samples; tile: (columns, rows) of a tile, or strips."""
    end = ">" if big_endian else "<"
    out = bytearray((b"MM\0*" if big_endian else b"II*\0") + bytes(4))
    link = 4
    for image in pages:
        height, width, samples = image.shape
        bw, bh = tile or (width, strip_rows)
        offsets, counts = [], []
        for top in range(0, height, bh):
            for left in range(0, width, bw):
                block = image[top : top + bh, left : left + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = _encode(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data + b"\0" * (len(data) & 1)
        tags: list[tuple[int, int, tuple]] = [(WIDTH, 4, (width,)), (LENGTH, 4, (height,)), (BITS, 3, (8,) * samples), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (2 if samples >= 3 else 1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,))]
        tags += [(TILE_WIDTH, 4, (bw,)), (TILE_LENGTH, 4, (bh,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_COUNTS, 4, tuple(counts))] if tile else [(STRIP_OFFSETS, 4, tuple(offsets)), (ROWS_PER_STRIP, 4, (bh,)), (STRIP_COUNTS, 4, tuple(counts))]
        entries = b""
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{end}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) & 1)
                packed = struct.pack(end + "I", place)
            entries += struct.pack(end + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(end + "I", out, link, len(out))
        out += struct.pack(end + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def payload_tiff(payload: bytes) -> bytes:
    """Payload bytes (a positive multiple of ROW_BYTES) as grey pages of ROW_BYTES columns."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES, 1)
    return write_tiff([grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)])


# -- Spark ----------------------------------------------------------------------------------------

PAGE_SCHEMA = "id {id}, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string"


def tiff_pages(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF in ``media_col``; a damaged file gives one row with ``error``."""
    source = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))

    def pages(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = [], []
        for i, media in enumerate(part.column(1).to_pylist()):
            try:
                found = [(*p, None) for p in read_pages(media)]
            except (ValueError, struct.error, OverflowError, MemoryError) as e:
                found = [(None,) * 7 + (str(e),)]
            ids += [i] * len(found)
            rows += found
        cols = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "page", "width", "height", "samples", "bits", "compression", "pixels", "error"])

    return map_slices(source, "media", PAGE_SCHEMA.format(id=source.schema["id"].dataType.simpleString()), pages)


MEDIA_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int"


def _media_row(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))
    media = payload_tiff(payload)
    pages = list(read_pages(media))
    stored = b"".join(p.pixels for p in pages)
    counts = np.bincount(np.frombuffer(stored, np.uint8), minlength=256)
    share = counts[counts > 0] / len(stored)
    mean = float(counts @ np.arange(256)) / len(stored)
    entropy = float(-(share * np.log2(share)).sum())
    feature = f"pages={len(pages)};width={pages[0].width};height={sum(p.height for p in pages)};mean={mean:.4f};entropy={entropy:.4f}"
    return len(text), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(pages)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's padded bytes as a TIFF, reads its pages back and describes them."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))

    def media(part: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*(_media_row(b) for b in part.column(1).to_pylist()), strict=True)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        names = [f.split()[0] for f in MEDIA_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return map_slices(source, "body", MEDIA_SCHEMA, media)
