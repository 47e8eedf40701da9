"""TIFF columns: one row per page, with PackBits, LZW and deflate strips and tiles and predictors undone.

The writer stores text payloads losslessly as 8-bit grey pages; the reader takes classic TIFF of either byte order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, col, text_of

# Fixed values of the format: tags, compression numbers and the size of each field type.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, ADOBE_DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

COLUMNS = 64
PAGE_ROWS = 1 << 14
STRIP_ROWS = 1 << 10


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader can decode."""


def unpack_bits(data: bytes, need: int | None = None) -> bytes:
    """PackBits runs, as far as ``need`` bytes (all by default)."""
    out, at = bytearray(), 0
    while at < len(data) and (need is None or len(out) < need):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest as literals."""
    out, at, kept = bytearray(), 0, 0

    def literals(end: int) -> None:
        nonlocal kept
        while kept < end:
            n = min(128, end - kept)
            out.append(n - 1)
            out.extend(data[kept : kept + n])
            kept += n

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            literals(at)
            out.append(257 - run)
            out.append(data[at])
            kept = at + run
        at += run
    literals(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, need: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early; 256 clears the table and 257 ends. Stops at ``need`` bytes."""
    made = 0
    out: list[bytes] = []
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = base.copy()
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = base.copy(), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(entry)
        made += len(entry)
        if need is not None and made >= need:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        size = len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table = {bytes([i]): i for i in range(256)}
    known, size, width = b"", 258, 9
    for i in range(len(data)):
        longer = known + data[i : i + 1]
        if longer in table:
            known = longer
            continue
        codes.append((table[known], width))
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, width))
            table = {bytes([k]): k for k in range(256)}
            size, width = 258, 9
        known = data[i : i + 1]
    if known:
        codes.append((table[known], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    out, held, bits = bytearray(), 0, 0
    for code, wide in codes:
        held = (held << wide) | code
        bits += wide
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append((held << (8 - bits)) & 0xFF)
    return bytes(out)


def _inflate(data: bytes, need: int | None = None) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, need or 0)
    except zlib.error as bad:
        raise TiffError(str(bad)) from bad


PACK = {NONE: bytes, LZW: pack_lzw, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}
UNPACK = {NONE: lambda data, need=None: bytes(data), LZW: unpack_lzw, ADOBE_DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}

#: Bytes that one byte of a strip can become at most; LZW entries grow by one byte a code of nine bits or more.
EXPANSION = {NONE: 1, LZW: 3500, ADOBE_DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}


def _segment(raw: bytes, compression: int, rows: int, width: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """One strip or tile as rows x width x samples, its predictor undone."""
    if compression not in UNPACK:
        raise TiffError(f"compression {compression}")
    need = rows * width * samples * dtype.itemsize
    plain = UNPACK[compression](raw, need)
    if len(plain) < need:
        raise TiffError("short strip or tile")
    if predictor == 3:
        # Byte planes, most significant first, differenced along the row.
        flat = np.frombuffer(plain, np.uint8, need).reshape(rows, width * samples * dtype.itemsize)
        step = flat.reshape(rows, -1, samples) if samples > 1 else flat[:, :, None]
        summed = np.cumsum(step, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, width * samples)
        big = np.ascontiguousarray(summed.transpose(0, 2, 1))
        return big.view(dtype.newbyteorder(">")).reshape(rows, width, samples).astype(dtype.newbyteorder("="))
    grid = np.frombuffer(plain, dtype, need // dtype.itemsize).reshape(rows, width, samples)
    if predictor == 2:
        grid = np.cumsum(grid, axis=1, dtype=dtype.newbyteorder("="))
    return grid


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """Fields of one image directory and the offset of the next."""
    if at + 2 > len(data):
        raise TiffError("directory outside the file")
    (count,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * count > len(data):
        raise TiffError("directory outside the file")
    fields: dict[int, tuple] = {}
    for entry in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        size = TYPE_BYTES.get(kind, 0) * n
        place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
        if not size or place + size > len(data):
            continue
        if kind in (1, 3, 4):
            fields[tag] = struct.unpack_from(f"{order}{n}{'BHI'[(1, 3, 4).index(kind)]}", data, place)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_pages(data: bytes) -> Iterator[tuple[dict[str, int], np.ndarray]]:
    """Each page's facts and its samples as height x width x samples."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        fields, at = _directory(data, order, at)
        one = lambda tag, default=None: fields.get(tag, (default,))[0]
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits = set(fields.get(BITS, (1,)))
        kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
        if not width or not height or not samples or len(bits) != 1 or kind is None or (size := bits.pop()) not in (8, 16, 32, 64) or (kind == "f" and size < 32):
            raise TiffError("missing size or unsupported samples")
        dtype = np.dtype(f"{order}{kind}{size // 8}")
        compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if compression not in EXPANSION:
            raise TiffError(f"compression {compression}")
        planes = samples if one(PLANAR, 1) == 2 else 1
        inner = samples // planes
        tiled = TILE_OFFSETS in fields
        wide, high = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        offsets, sizes = (fields.get(TILE_OFFSETS), fields.get(TILE_BYTES)) if tiled else (fields.get(STRIP_OFFSETS), fields.get(STRIP_BYTES))
        if not wide or not high or not offsets or not sizes:
            raise TiffError("no strips or tiles")
        count = planes * -(-height // high) * -(-width // wide)
        if min(len(offsets), len(sizes)) < count:
            raise TiffError("strips or tiles are missing")
        # What the header asks for is held against the bytes there are before anything is allocated.
        if any(place + n > len(data) for place, n in zip(offsets[:count], sizes)) or sum(sizes[:count]) > len(data):
            raise TiffError("strips or tiles lie outside the file or overlap")
        rows_high = high if tiled else min(high, height)
        if wide * rows_high * inner * (size // 8) > EXPANSION[compression] * max(sizes[:count]) or width * height * samples * (size // 8) > EXPANSION[compression] * sum(sizes[:count]):
            raise TiffError("the page is larger than its bytes can hold")
        boxes = [(p, y, x) for p in range(planes) for y in range(0, height, high) for x in range(0, width, wide)]
        page = np.zeros((height, width, samples), dtype.newbyteorder("="))
        for (plane, y, x), place, n in zip(boxes, offsets, sizes):
            rows = high if tiled else min(high, height - y)
            part = _segment(data[place : place + n], compression, rows, wide, inner, dtype, predictor)
            band = slice(plane * inner, (plane + 1) * inner)
            page[y : y + rows, x : x + wide, band] = part[: height - y, : width - x]
        yield {"width": width, "height": height, "samples": samples, "bits": size, "compression": compression, "predictor": predictor}, page


def write_pages(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: int | None = None, order: str = "<") -> bytes:
    """Classic TIFF of 8-bit grey pages (height x width), in strips or square tiles."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        high, wide = (tile, tile) if tile else (min(strip_rows, height), width)
        offsets, sizes = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                part = page[y : y + high, x : x + wide]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1])))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.uint8(0))
                packed = PACK[compression](np.ascontiguousarray(part, np.uint8).tobytes())
                offsets.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        n = len(offsets)
        lists = len(out)
        if n > 1:
            out += struct.pack(f"{order}{2 * n}I", *offsets, *sizes)
        where, count = (lists, lists + 4 * n) if n > 1 else (offsets[0], sizes[0])
        shape = [(TILE_WIDTH, 4, 1, wide), (TILE_LENGTH, 4, 1, high), (TILE_OFFSETS, 4, n, where), (TILE_BYTES, 4, n, count)] if tile else [
            (STRIP_OFFSETS, 4, n, where), (ROWS_PER_STRIP, 4, 1, high), (STRIP_BYTES, 4, n, count)]
        fields = sorted([
            (WIDTH, 4, 1, width), (LENGTH, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression),
            (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), *shape])
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag, kind, k, value in fields:
            out += struct.pack(order + "HHI", tag, kind, k) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def payload_pages(payload: bytes, page_rows: int = PAGE_ROWS) -> list[np.ndarray]:
    """A payload (a multiple of ``COLUMNS`` bytes) as pages of at most ``page_rows`` rows."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    return [grid[y : y + page_rows] for y in range(0, len(grid), page_rows)]


def store_texts(documents: DataFrame, compression: int = ADOBE_DEFLATE, predictor: int = 2, text: str = "text") -> DataFrame:
    """``documents`` with ``tiff binary``: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as grey pages.

    Null texts count as empty; a column named tiff is replaced.
    """

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        files = []
        for t in texts:
            data = t.encode()
            payload = data + b"\0" * (-len(data) % COLUMNS if data else COLUMNS)
            files.append(write_pages(payload_pages(payload), compression, predictor))
        return [pa.array(files, pa.binary())]

    return add_columns(documents, "tiff binary", make, text)


PAGE = "page: int, width: bigint, height: bigint, samples: int, bits: int, compression: int, predictor: int, mean: double, deviation: double, pixels: binary"


def decode(data: bytes | None) -> tuple[list[dict], str | None]:
    """Pages of one file as dicts of the fields of ``PAGE``, or none and the reason why it does not decode."""
    pages = []
    try:
        for number, (facts, samples) in enumerate(read_pages(data or b"")):
            values = samples.astype(np.float64)
            pixels = samples.astype(samples.dtype.newbyteorder("<"), copy=False).tobytes()
            pages.append({"page": number, **facts, "mean": float(values.mean()), "deviation": float(values.std()), "pixels": pixels})
    except (TiffError, struct.error) as bad:
        return [], str(bad)
    return pages, None


def with_pages(files: DataFrame, content: str = "tiff") -> DataFrame:
    """``files`` with ``pages``, an array of page structs, and ``tiff_error`` (null when the file decodes).

    Null content and bytes that are no decodable TIFF give no pages and a message; nothing fails, and a header that asks for more
    than the file's bytes can hold is refused before memory is taken. ``pixels`` holds the samples row by row in little-endian order.
    """

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        found = [decode(cell.as_py()) for cell in batch.column(batch.schema.get_field_index(content))]
        kind = pa.list_(pa.struct([
            ("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()),
            ("compression", pa.int32()), ("predictor", pa.int32()), ("mean", pa.float64()), ("deviation", pa.float64()), ("pixels", pa.binary())]))
        return [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.string())]

    return add_columns(files, f"pages array<struct<{PAGE}>>, tiff_error string", make, None)


def explode_pages(files: DataFrame, content: str = "tiff") -> DataFrame:
    """One row per page: the columns of ``files`` but the content, then the page's fields (which replace namesakes)."""
    names = [x.split(":")[0] for x in PAGE.split(", ")]
    keep = [col(c) for c in files.columns if c not in (content, "pages", "tiff_error", *names)]
    rows = with_pages(files, content).select(*keep, F.explode("pages").alias("_page"))
    return rows.select(*keep, "_page.*")


def media_digest(documents: DataFrame, compression: int = ADOBE_DEFLATE, predictor: int = 2) -> DataFrame:
    """Digest of every document's stored payload, read back from its TIFF pages.

    Repeated texts give equal values, extra columns are ignored and an empty table gives no rows.
    """
    slim = documents.select(col("doc_id"), text_of().alias("text"))
    stored = store_texts(slim, compression, predictor).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "tiff")

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        payloads, features = [], []
        for cell in batch.column(batch.schema.get_field_index("tiff")):
            pages, error = decode(cell.as_py())
            if error:
                raise TiffError(error)
            rows = sum(p["height"] for p in pages)
            mean = sum(p["mean"] * p["height"] for p in pages) / rows
            payloads.append(b"".join([p["pixels"] for p in pages]))
            features.append(f"pages={len(pages)} rows={rows} mean={mean:.6f} deviation={max(p['deviation'] for p in pages):.6f}")
        return [pa.array(payloads, pa.binary()), pa.array(features, pa.string())]

    read = add_columns(stored, "payload binary, feature string", make, None)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("tiff").cast("long").alias("media_bytes"),
        F.sha2("tiff", 256).alias("media_sha256"), "feature",
    )
