"""TIFF as a media column: walk the image directories, decode strips and tiles, one row per page.

Decoding covers both byte orders, gray and chunky samples of 8 bits, strips and tiles, no
compression, PackBits, LZW and deflate, and the horizontal predictor.  The writer makes such files
from samples, losslessly.  All of it runs batch by batch inside the tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bytes, text_or_empty

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_A_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 317, 322, 323, 324, 325
PAYLOAD_UNIT = 576
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def unpackbits(data: bytes, size: int) -> bytes:
    """PackBits: n >= 0 copies n + 1 bytes, n < 0 repeats one byte 1 - n times, -128 does nothing."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    values = np.frombuffer(data, np.uint8)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a < 3:
            plain.extend(data[a:b])
            continue
        flush()
        for k in range(a, b, 128):
            n = min(128, b - k)
            out.extend((257 - n, data[a]) if n > 1 else (0, data[a]))
    flush()
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; widths grow one code early."""
    out, table, previous = bytearray(), [], b""
    buffer = bits = 0
    width = 9
    for byte in data:
        buffer, bits = (buffer << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, buffer = buffer >> bits, buffer & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, previous = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data has to begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if previous and len(table) < 4096:
            table.append(previous + entry[:1])
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        previous = entry
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, buffer, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}
    following, width = 258, 9

    def emit(code: int) -> None:
        nonlocal buffer, bits
        buffer, bits = (buffer << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits)
            buffer &= (1 << bits) - 1

    emit(256)
    held = b""
    for k in range(len(data)):
        longer = held + data[k : k + 1]
        if len(longer) == 1 or longer in codes:
            held = longer
            continue
        emit(held[0] if len(held) == 1 else codes[held])
        codes[longer], following = following, following + 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4095:
            emit(256)
            codes, following, width = {}, 258, 9
        held = data[k : k + 1]
    if held:
        emit(held[0] if len(held) == 1 else codes[held])
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    emit(257)
    if bits:
        out.append(buffer << (8 - bits) & 255)
    return bytes(out)


#: What one page may declare.
MOST_PAGE_BYTES = 1 << 28

ENCODERS = {NONE: lambda b: b, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


DECODERS = {NONE: lambda b, n: b[:n], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate}


def walk(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The entries of each image directory, in file order; a directory that comes again ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        entries = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES or TYPES[kind] == "c":
                continue
            if count * struct.calcsize(TYPES[kind]) > len(data):
                raise ValueError("an entry has more values than the file has bytes")
            form = f"{order}{count}{TYPES[kind]}"
            inline = at + 10 + 12 * k
            place = inline if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, inline)[0]
            entries[tag] = struct.unpack_from(form, data, place)
        yield entries
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def decode_pages(data: bytes, most_bytes: int = MOST_PAGE_BYTES) -> Iterator[Page]:
    """Every page with its samples as they were before prediction and compression.

    A page whose directory is not sound, or that declares more than ``most_bytes``, raises ValueError.
    """
    for index, tags in enumerate(walk(data)):
        one = lambda tag, default=None, tags=tags: tags.get(tag, (default,))[0]
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        if set(tags.get(BITS, (1,))) != {8}:
            raise ValueError("only samples of 8 bits are read")
        compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if compression not in DECODERS or predictor not in (1, 2):
            raise ValueError(f"compression {compression} with predictor {predictor} is not read")
        tiled = TILE_AT in tags
        missing = {WIDTH, HEIGHT} | ({TILE_WIDTH, TILE_HEIGHT, TILE_BYTES} if tiled else {STRIP_AT, STRIP_BYTES})
        if absent := sorted(missing - {k for k, v in tags.items() if v}):
            raise ValueError(f"a directory without entries {absent}")
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_A_STRIP, height), height))
        starts, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
        if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, across, down)):
            raise ValueError("a page of no size")
        if max(width * height, across * down) * samples > most_bytes:
            raise ValueError(f"a page of over {most_bytes} bytes")
        columns = -(-width // across)
        if len(starts) != len(sizes) or len(starts) < columns * -(-height // down):
            raise ValueError("strips or tiles are missing")
        pixels = np.zeros((height, width, samples), np.uint8)
        for k, (at, size) in enumerate(zip(starts[: columns * -(-height // down)], sizes, strict=False)):
            top, left = k // columns * down, k % columns * across
            rows = down if tiled else min(down, height - top)
            raw = DECODERS[compression](data[at : at + size], rows * across * samples)
            if len(raw) < rows * across * samples:
                raise ValueError("a strip or tile is too short")
            block = np.frombuffer(raw, np.uint8).reshape(rows, across, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            pixels[top : top + rows, left : left + across] = block[: height - top, : width - left]
        yield Page(index, width, height, samples, compression, predictor, tiled, pixels)


def encode_pages(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_a_strip: int = 256, tile: int = 0, order: str = "<"
) -> bytes:
    """A TIFF file of pages (height x width x samples, 8 bits), in strips, or in tiles of ``tile`` pixels."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        down, across = (tile, tile) if tile else (min(rows_a_strip, height), width)
        starts, sizes = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = page[top : top + down, left : left + across]
                if tile and block.shape[:2] != (tile, tile):
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
                part = ENCODERS[compression](np.ascontiguousarray(block).tobytes())
                starts.append(len(out))
                sizes.append(len(part))
                out += part + b"\0" * (len(part) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1]}
        fields |= {SAMPLES: [samples], PREDICTOR: [predictor]}
        if tile:
            fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_AT: starts, TILE_BYTES: sizes}
        else:
            fields |= {ROWS_A_STRIP: [down], STRIP_AT: starts, STRIP_BYTES: sizes}
        body = bytearray()
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(packed) > 4:
                packed, at = struct.pack(order + "I", len(out)), out.extend(packed)
            body += struct.pack(order + "HHI", tag, 4, len(values)) + packed
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + body + struct.pack(order + "I", 0)
        link = len(out) - 4
    return bytes(out)


def payload_of(text: bytes) -> bytes:
    """The bytes and as many bytes 255 as make a positive multiple of the unit."""
    return text + b"\xff" * ((-len(text)) % PAYLOAD_UNIT or (0 if text else PAYLOAD_UNIT))


def store_payload(payload: bytes, rows_a_page: int = 2048) -> bytes:
    """Gray pages of 24 pixels a row, 24 rows a unit; deflate without prediction, which text does not gain from."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, 24, 1)
    rows_a_page -= rows_a_page % 24
    return encode_pages([pixels[k : k + rows_a_page] for k in range(0, len(pixels), rows_a_page)], predictor=1, rows_a_strip=rows_a_page)


def page_features(page: np.ndarray) -> tuple[float, float, str]:
    """Mean, standard deviation and a 64-bit difference hash of the page's brightness."""
    gray = page.mean(axis=2) if page.shape[2] > 1 else page[:, :, 0]
    rows = np.linspace(0, gray.shape[0], 9).astype(int)
    cols = np.linspace(0, gray.shape[1], 10).astype(int)
    sums = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    sums[1:, 1:] = gray.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    lo_r, hi_r = rows[:-1], np.minimum(np.maximum(rows[1:], rows[:-1] + 1), gray.shape[0])
    lo_c, hi_c = cols[:-1], np.minimum(np.maximum(cols[1:], cols[:-1] + 1), gray.shape[1])
    boxes = sums[hi_r][:, hi_c] - sums[lo_r][:, hi_c] - sums[hi_r][:, lo_c] + sums[lo_r][:, lo_c]
    boxes /= np.maximum(1, (hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :])
    bits = np.packbits((boxes[:, 1:] > boxes[:, :-1]).ravel()).tobytes()
    return float(gray.mean()), float(gray.std()), bits.hex()


PAGE_SCHEMA = "page long, width long, height long, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def decode_tiff(df: DataFrame, id_col: str = "id", bytes_col: str = "media", most_bytes: int = MOST_PAGE_BYTES) -> DataFrame:
    """One row per page of each file: the id, page number, size, how it was stored and its samples.

    A null, empty or broken file gives one row with page -1, its other columns null, and ``error``, and so
    does one with a page that declares over ``most_bytes``; pages before the broken one are kept.  Repeated rows are decoded each, an empty table stays empty.
    """
    source = df.select(F.col(id_col).alias("_id"), F.col(bytes_col).alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                try:
                    for p in decode_pages(batch.column("_bytes")[k].as_py() or b"", most_bytes):
                        rows.append((p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                except (ValueError, KeyError, TypeError, IndexError, OverflowError, struct.error, zlib.error) as broken:
                    rows.append((-1, *[None] * 7, str(broken)))
                if not rows:
                    rows.append((-1, *[None] * 7, "no image directory"))
                types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_(), pa.binary(), pa.string()]
                ids = batch.column("_id").take(pa.array([k] * len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))],
                    names=["_id", *(c.split()[0] for c in PAGE_SCHEMA.split(", "))],
                )

    kind = dict(source.dtypes)["_id"]
    return source.mapInArrow(run, f"_id {kind}, {PAGE_SCHEMA}").withColumnRenamed("_id", id_col)


FEATURE_COLUMNS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_pages": pa.int32(),
}


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a TIFF file, decodes that file again and describes what was read.

    One row per input row: n_bytes of the text, payload_bytes, payload_sha256 and tail_crc32 (the
    last 32 bytes) of what the decoder returned, media_bytes and media_sha256 of the file, feature
    (mean, deviation and difference hash of each page) and n_pages.  Null texts count as empty and
    become one unit of bytes 255; equal texts give equal values; an empty table stays empty.
    """
    source = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = arrow_bytes(batch.column("_text"))
            out = {c: [] for c in FEATURE_COLUMNS}
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = store_payload(payload_of(body[a:b].tobytes()))
                pages = list(decode_pages(media))
                read = b"".join(p.pixels.tobytes() for p in pages)
                features = ["{:.3f}:{:.3f}:{}".format(*page_features(p.pixels)) for p in pages]
                values = (
                    b - a, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), "|".join(features), len(pages),
                )
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *(pa.array(v, FEATURE_COLUMNS[c]) for c, v in out.items())], names=["_id", *out]
            )

    kind = dict(source.dtypes)["_id"]
    schema = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
