"""TIFF media columns: read every page of a TIFF value, and write texts as TIFF pages.

The reader walks the chain of image directories in either byte order, reads strips or tiles,
undoes PackBits, LZW or deflate and then the horizontal predictor, and emits one row per page. Samples of
1, 8, 16 and 32 bits are read; other sizes, the floating-point predictor and other codecs give an error row. It needs
nothing outside the row, so it runs as a narrow step over any partitioning and holds one page at a
time.
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

from toponexus.llm.chunks import column_bytes
from toponexus.llm.storage import small_batches

# Fixed values of the format: tag numbers, field sizes by field type, compression and predictor codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS = 256, 257, 258, 259, 262, 270, 273
FILL_ORDER, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 266, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
INTEGERS = {1: "B", 3: "H", 4: "I"}
NO_COMPRESSION, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
CODECS = {"none": NO_COMPRESSION, "lzw": LZW, "deflate": ADOBE_DEFLATE, "packbits": PACKBITS}
LZW_CLEAR, LZW_END = 256, 257
HORIZONTAL = 2

MAX_PAGES = 1 << 20
PAGE_COLUMNS = "page int, width int, height int, samples int, bits int, compression int, predictor int, description string, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: n in 0..127 copies n + 1 bytes, n in 129..255 repeats one byte 257 - n times, 128 is skipped."""
    out = bytearray()
    i = 0
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
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes of 9 to 12 bits, high bit first, the width growing one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    held = bits = made = 0
    width, before = 9, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table = base.copy()
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == LZW_CLEAR:
            table, width, before = base.copy(), 9, b""
            continue
        if code == LZW_END or made >= size:
            break
        if not before:
            if code > 255:
                raise ValueError("LZW data starts with a code that is not a byte")
            text = table[code]
        elif code < len(table):
            text = table[code]
            table.append(before + text[:1])
        elif code == len(table):
            text = before + before[:1]
            table.append(text)
        else:
            raise ValueError("LZW code out of range")
        out.append(text)
        made += len(text)
        before = text
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)[:size]


def pack_lzw(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0
    width = 9
    codes: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def start() -> dict[bytes, int]:
        return {bytes([i]): i for i in range(256)}

    codes, following = start(), 258
    put(LZW_CLEAR)
    text = b""
    for i in range(len(data)):
        longer = text + data[i : i + 1]
        if longer in codes:
            text = longer
            continue
        put(codes[text])
        codes[longer] = following
        following += 1
        if following == 4094:
            put(LZW_CLEAR)
            codes, following, width = start(), 258, 9
        elif following >= (1 << width):
            width += 1
        text = data[i : i + 1]
    if text:
        put(codes[text])
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(LZW_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def compress(data: bytes, compression: int) -> bytes:
    if compression == NO_COMPRESSION:
        return data
    if compression == LZW:
        return pack_lzw(data)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.compress(data, 1)
    if compression == PACKBITS:
        return pack_bits(data)
    raise ValueError(f"unknown compression {compression}")


def decompress(data: bytes, compression: int, size: int) -> bytes:
    """At most ``size`` bytes, so that a damaged value can't fill the memory."""
    if size <= 0:
        return b""
    if compression == NO_COMPRESSION:
        return data[:size]
    if compression == LZW:
        return unpack_lzw(data, size)
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"unknown compression {compression}")


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    description: str | None
    pixels: bytes


class Reader:
    """The pages of one TIFF value."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise ValueError("not a TIFF value")
        self.order = "<" if data[:2] == b"II" else ">"
        magic, self.first = struct.unpack_from(self.order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF value")

    def pages(self) -> Iterator[Page]:
        at, seen = self.first, set()
        while at:
            if at in seen or len(seen) >= MAX_PAGES:
                raise ValueError("the image directories form a loop")
            seen.add(at)
            fields, at = self._directory(at)
            yield self._page(fields)

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        (count,) = struct.unpack_from(self.order + "H", self.data, at)
        fields = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * i)
            size = FIELD_SIZES.get(kind, 0) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(self.order + "I", self.data, at + 10 + 12 * i)[0]
            if place + size > len(self.data):
                raise ValueError("a field lies outside the value")
            if kind in INTEGERS:
                fields[tag] = struct.unpack_from(f"{self.order}{n}{INTEGERS[kind]}", self.data, place)
            elif kind in (2, 7):
                fields[tag] = (self.data[place : place + size],)
        (following,) = struct.unpack_from(self.order + "I", self.data, at + 2 + 12 * count)
        return fields, following

    def _page(self, fields: dict[int, tuple]) -> Page:
        def one(tag: int, default: int | None = None) -> int:
            if tag not in fields:
                if default is None:
                    raise ValueError(f"tag {tag} is missing")
                return default
            return fields[tag][0]

        width, height = one(WIDTH), one(HEIGHT)
        samples, bits, compression, predictor, planar = one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if bits not in (1, 8, 16, 32) or any(b != bits for b in fields.get(BITS, ())):
            raise ValueError(f"samples of {fields.get(BITS, (1,))} bits are not read")
        if predictor not in (1, HORIZONTAL) or (bits == 1 and predictor != 1):
            raise ValueError(f"unknown predictor {predictor}")
        if samples < 1 or not width or not height:
            raise ValueError("the page has no samples")
        if one(FILL_ORDER, 1) != 1:
            raise ValueError("bits are stored backwards")
        if width * height * samples * bits // 8 > 1 << 31:
            raise ValueError("the page is too large")
        kind = np.dtype("u1") if bits <= 8 else np.dtype(f"{self.order}u{bits // 8}")
        apart = samples if planar == 1 else 1
        layers = 1 if planar == 1 else samples
        image = np.zeros((layers, height, width, apart), dtype=kind)
        if TILE_OFFSETS in fields:
            wide, high, places, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), fields[TILE_OFFSETS], fields[TILE_SIZES]
        else:
            wide, high, places, sizes = width, min(one(ROWS_PER_STRIP, height), max(height, 1)), fields[STRIP_OFFSETS], fields[STRIP_SIZES]
        if not wide or not high or wide * high * apart * kind.itemsize > 1 << 31:
            raise ValueError("a strip or tile has no sensible size")
        across, down = -(-width // wide), -(-height // high)
        if len(places) < layers * across * down:
            raise ValueError("strips or tiles are missing")
        tiled = TILE_OFFSETS in fields
        for k in range(layers * across * down):
            layer, y, x = k // (across * down), k // across % down * high, k % across * wide
            rows = high if tiled else min(high, height - y)
            row_bytes = -(-wide * apart * bits // 8)
            want = rows * row_bytes
            raw = decompress(self.data[places[k] : places[k] + sizes[k]], compression, want)
            if len(raw) != want:
                raise ValueError("a strip or tile is too short")
            if bits == 1:  # eight samples a byte, each row from a new byte
                part = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(rows, row_bytes), axis=1)[:, : wide * apart].reshape(rows, wide, apart)
            else:
                part = np.frombuffer(raw, dtype=kind).reshape(rows, wide, apart)
            if predictor == HORIZONTAL:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            image[layer, y : y + rows, x : x + wide] = part[: height - y, : width - x]
        # planes apart are put together, bits as a byte each, wider samples little-endian
        pixels = np.ascontiguousarray(image.transpose(1, 2, 0, 3).reshape(height, width, samples)).astype(kind.newbyteorder("<"), copy=False)
        text = fields.get(DESCRIPTION)
        return Page(width, height, samples, bits, compression, predictor, text[0].rstrip(b"\0").decode("utf-8", "replace") if text else None, pixels.tobytes())


@dataclass
class Layout:
    """How ``write`` stores a page: codec, predictor, and strips of ``rows`` or tiles of ``tile`` (width, height)."""

    codec: str = "deflate"
    predictor: int = HORIZONTAL
    rows: int = 1024
    tile: tuple[int, int] | None = None


def write(pages: list[tuple[np.ndarray, str]], layout: Layout) -> bytes:
    """A little-endian TIFF of 8-bit grey pages (height x width arrays) with descriptions."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image, description in pages:
        height, width = image.shape
        if layout.tile:
            wide, high = layout.tile
            full = np.zeros((-(-height // high) * high, -(-width // wide) * wide), dtype=np.uint8)
            full[:height, :width] = image
            parts = [full[y : y + high, x : x + wide] for y in range(0, full.shape[0], high) for x in range(0, full.shape[1], wide)]
        else:
            parts = [image[y : y + layout.rows] for y in range(0, height, layout.rows)]
        places, sizes = [], []
        for part in parts:
            if layout.predictor == HORIZONTAL:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            raw = compress(np.ascontiguousarray(part).tobytes(), CODECS[layout.codec])
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        text = description.encode() + b"\0"
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8]), COMPRESSION: (3, [CODECS[layout.codec]]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [layout.predictor])}
        if layout.tile:
            fields |= {TILE_WIDTH: (4, [layout.tile[0]]), TILE_HEIGHT: (4, [layout.tile[1]]), TILE_OFFSETS: (4, places), TILE_SIZES: (4, sizes)}
        else:
            fields |= {ROWS_PER_STRIP: (4, [layout.rows]), STRIP_OFFSETS: (4, places), STRIP_SIZES: (4, sizes)}
        coded = {tag: (kind, len(values), struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)) for tag, (kind, values) in fields.items()}
        coded[DESCRIPTION] = (2, len(text), text)
        entries = b""
        for tag in sorted(coded):
            kind, n, raw = coded[tag]
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(coded)) + entries + b"\0\0\0\0"
    return bytes(out)


def _page_rows(keep: list[str], page_bytes: int = 1 << 23):
    names = [*keep, *(x.split()[0] for x in PAGE_COLUMNS.split(", "))]
    kinds = [pa.int32()] * 7 + [pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            owner: list[int] = []
            size = 0

            def release(batch=batch, held=held, owner=owner) -> pa.RecordBatch:
                index = pa.array(owner, pa.int64())
                columns = [batch.column(name).take(index) for name in keep]
                out = pa.RecordBatch.from_arrays([*columns, *(pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True))], names)
                held.clear()
                owner.clear()
                return out

            for i, value in enumerate(batch.column("__media")):
                page = -1
                try:
                    if not value.is_valid:
                        raise ValueError("null")
                    for page, found in enumerate(Reader(value.as_buffer().to_pybytes()).pages()):
                        held.append((page, found.width, found.height, found.samples, found.bits, found.compression, found.predictor, found.description, found.pixels, None))
                        owner.append(i)
                        size += len(found.pixels)
                        if size > page_bytes:
                            yield release()
                            size = 0
                except (ValueError, KeyError, struct.error, zlib.error, OverflowError) as error:
                    held.append((page + 1, None, None, None, None, None, None, None, None, str(error) or type(error).__name__))
                    owner.append(i)
            if held:
                yield release()

    return run


def pages(frame: DataFrame, media_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per page of each TIFF value, with the columns ``keep`` of its row.

    A row's pages follow one another in order. A null or damaged value gives the pages read so far
    and one row with ``error`` set. Pixels are rows of samples, 16-bit ones little-endian. Kept
    columns that are called like a page column give way to it. An empty table gives an empty result.
    """
    keep = [name for name in frame.columns if name != media_col] if keep is None else keep
    keep = [c for c in keep if c not in {x.split()[0] for x in PAGE_COLUMNS.split(", ")}]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema.fields)
    return frame.select(*keep, F.col(media_col).alias("__media")).mapInArrow(_page_rows(keep), f"{kinds}, {PAGE_COLUMNS}" if kinds else PAGE_COLUMNS)


def _write_rows(width: int, page_rows: int, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            body = data.tobytes()
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 22), "right")) - 1)
                media = []
                for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True):
                    size = max(width, -(-(y - x) // width) * width)
                    image = np.frombuffer(body[x:y].ljust(size, b"\0"), dtype=np.uint8).reshape(-1, width)
                    media.append(write([(image[r : r + page_rows], f"n_bytes={y - x}") for r in range(0, len(image), page_rows)], layout))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(media, pa.binary()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array([len(m) for m in media], pa.int64())],
                    ["doc_id", "media", "media_sha256", "media_bytes"],
                )
                a = b

    return run


def from_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, page_rows: int = 16384, layout: Layout | None = None) -> DataFrame:
    """Rows (doc_id, media, media_sha256, media_bytes): each text's UTF-8, zero-padded to a positive multiple of ``width``, as grey pages.

    Each page's description holds the unpadded number of bytes. Null text counts as empty.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_write_rows(width, page_rows, layout or Layout()), "doc_id long, media binary, media_sha256 string, media_bytes long")


class _Digest:
    """Running digests over the pages of one document."""

    def __init__(self, doc_id, media_sha256: str, media_bytes: int):
        self.doc_id, self.media = doc_id, (media_bytes, media_sha256)
        self.hash, self.size, self.tail, self.unpadded = hashlib.sha256(), 0, b"", None
        self.columns = None

    def add(self, page: dict) -> None:
        if page["error"] is not None:
            raise ValueError(f"document {self.doc_id}: {page['error']}")
        pixels = page["pixels"]
        self.hash.update(pixels)
        self.size += len(pixels)
        self.tail = pixels[-64:]
        self.unpadded = int(page["description"].removeprefix("n_bytes="))
        sums = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, page["width"]).sum(axis=0, dtype=np.int64)
        self.columns = sums if self.columns is None else self.columns + sums

    def row(self) -> tuple:
        # an average hash over the columns, then the mean grey in thousandths
        bits = (self.columns * len(self.columns) > self.columns.sum()).tolist()
        feature = f"{int(''.join('01'[b] for b in bits), 2):0{-(-len(bits) // 4)}x}-{int(self.columns.sum()) * 1000 // self.size}"
        return self.doc_id, self.unpadded, self.size, self.hash.hexdigest(), zlib.crc32(self.tail), *self.media, feature


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    now: _Digest | None = None
    done: list[tuple] = []

    def release() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        done.clear()
        return out

    for batch in batches:
        rest = batch.drop_columns(["pixels"]).to_pylist()
        for page, pixels in zip(rest, batch.column("pixels"), strict=True):
            if page["page"] == 0:
                if now:
                    done.append(now.row())
                now = _Digest(page["doc_id"], page["media_sha256"], page["media_bytes"])
            now.add(page | {"pixels": pixels.as_py()})
        if done:
            yield release()
    if now:
        done.append(now.row())
        yield release()


def digests(page_rows: DataFrame) -> DataFrame:
    """A row per document from the rows of ``pages`` over ``from_texts``, without an exchange: pages come in order."""
    return page_rows.select("doc_id", "media_sha256", "media_bytes", "page", "width", "description", "pixels", "error").mapInArrow(_digest_rows, DIGEST_SCHEMA)
