"""TIFF as a media column: writing images, and walking files page by page.

The reader follows the chain of image directories in either byte order, decodes strips or tiles (none, PackBits, LZW,
deflate), undoes horizontal and floating-point predictors, and gives one row for each page. A broken file gives one row
with its error and no pixels; pages before a broken one are kept. A page of over PAGE_BYTES counts as broken.

media_features stores each text as pages of at most PAGE_ROWS_OF_TEXT rows, so that no page grows with its text, and
chooses each page's codec and layout by its content: PackBits where bytes repeat, LZW for small pages, deflate for
others, or none where that saves nothing; tiles for pages of at least TILE rows, else strips. What it stores it reads
back with the reader above.

Defined results: null media give no rows; an empty table gives no rows; other columns are ignored. In media_features a
null text is empty, rows with null or repeated doc_ids are kept, equal texts have equal values, and very long texts have
very many pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
#: A page's decoded size beyond which a file is taken as broken rather than decoded.
PAGE_BYTES = 1 << 30


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, previous = bytearray(), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = [], 9, b""
            continue
        if code < 256:
            entry = bytes([code])
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif code - 258 == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("bad LZW code")
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        last = 258 + len(table)
        width = 12 if last >= 2047 else 11 if last >= 1023 else 10 if last >= 511 else 9
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256, 9)
    table: dict[bytes, int] = {}
    known, width = b"", 9
    code_of = lambda x: x[0] if len(x) == 1 else table[x]
    for byte in data:
        longer = known + bytes([byte])
        if len(longer) == 1 or longer in table:
            known = longer
            continue
        put(code_of(known), width)
        table[longer] = 258 + len(table)
        last = 258 + len(table)
        width = 12 if last >= 2048 else 11 if last >= 1024 else 10 if last >= 512 else 9
        if last >= 4094:
            put(256, width)
            table, width = {}, 9
        known = bytes([byte])
    if known:
        put(code_of(known), width)
        last = 258 + len(table) + 1
        width = 12 if last >= 2048 else 11 if last >= 1024 else 10 if last >= 512 else 9
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    inflater = zlib.decompressobj()
    out = inflater.decompress(data, PAGE_BYTES)
    if not inflater.eof:
        raise ValueError("deflate data end early")
    return out


_UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
_PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


def _predict(rows: np.ndarray) -> np.ndarray:
    """rows (height, width, samples): each sample less the one to its left."""
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def _unpredict(rows: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return rows
    if predictor == 2:
        return np.cumsum(rows, axis=1, dtype=rows.dtype)
    if predictor == 3 and rows.dtype.kind == "f":
        h, w, s = rows.shape
        size = rows.dtype.itemsize
        planes = np.cumsum(np.ascontiguousarray(rows).view(np.uint8).reshape(h, w * s * size // s, s), axis=1, dtype=np.uint8).reshape(h, size, w * s)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(rows.dtype.newbyteorder(">")).reshape(h, w, s).astype(rows.dtype)
    raise ValueError(f"predictor {predictor} is not known for these samples")


@dataclass(frozen=True)
class Layout:
    """How a page is stored: codec, predictor, rows of a strip, and the side of its tiles (0 for strips)."""

    compression: int = DEFLATE
    predictor: int = 2
    rows_per_strip: int = 256
    tile: int = 0


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    description: str
    pixels: np.ndarray


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        form, size = TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * count > len(data):
            raise ValueError(f"tag {tag} points past the end")
        tags[tag] = struct.unpack_from(f"{order}{count}s" if form == "s" else order + form * count, data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    depths = set(tags.get(BITS, (1,)))
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if len(depths) != 1 or (bits := depths.pop()) not in (8, 16, 32, 64) or kind is None:
        raise ValueError(f"samples of {tags.get(BITS)} bits are not read")
    compression, predictor, planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if compression not in _UNPACK:
        raise ValueError(f"compression {compression} is not read")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    if not width or not height or width * height * samples * dtype.itemsize > PAGE_BYTES:
        raise ValueError("the page has no size or too large a one")
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        offsets, sizes = tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())
    else:
        bw, bh = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, sizes = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
    if not bw or not bh:
        raise ValueError("blocks have no size")
    across, down = -(-width // bw), -(-height // bh)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise ValueError("blocks are missing")
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * bh, rest % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = _UNPACK[compression](data[offsets[k] : offsets[k] + sizes[k]])
        need = rows * bw * depth * dtype.itemsize
        if len(raw) < need:
            raise ValueError("a block is too short")
        block = np.frombuffer(raw[:need], dtype).reshape(rows, bw, depth)
        block = _unpredict(block if predictor == 3 else block.astype(dtype.newbyteorder("=")), predictor)
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane : plane + depth] = block[:h, :w]
    text = one(DESCRIPTION, b"").rstrip(b"\0").decode("latin-1")
    return Page(width, height, samples, bits, compression, text, out)


#: What a file that lies about itself can raise while it is taken apart.
BROKEN = (struct.error, zlib.error, IndexError, KeyError, TypeError, AttributeError, OverflowError, UnicodeError, ZeroDivisionError, MemoryError)


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories; ValueError where it is broken."""
    try:
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a ring")
            seen.add(at)
            tags, at = _directory(data, order, at)
            yield _page(data, order, tags)
    except BROKEN as e:
        raise ValueError(f"the file is broken: {type(e).__name__} {e}") from e


def write(images: list[np.ndarray], layouts: Layout | list[Layout] = Layout(), descriptions: list[str] | None = None, order: str = "<") -> bytes:
    """A file with one page for each image (height, width, samples) of unsigned samples."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for k, image in enumerate(images):
        image = np.atleast_3d(image)
        layout = layouts if isinstance(layouts, Layout) else layouts[k]
        compression, predictor, rows_per_strip, tile = layout.compression, layout.predictor, layout.rows_per_strip, layout.tile
        h, w, s = image.shape
        bits = image.dtype.itemsize * 8
        blocks = []
        step_y, step_x = (tile, tile) if tile else (rows_per_strip, w)
        for y in range(0, h, step_y):
            for x in range(0, w, step_x):
                block = image[y : y + step_y, x : x + step_x]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                block = _predict(block) if predictor == 2 else block
                blocks.append(_PACK[compression](block.astype(block.dtype.newbyteorder(order)).tobytes()))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b + b"\0" * (len(b) % 2)
        tags = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (bits,) * s), (COMPRESSION, 3, (compression,)), (PHOTOMETRIC, 3, (2 if s == 3 else 1,)), (SAMPLES, 3, (s,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,))]
        sizes = tuple(len(b) for b in blocks)
        if tile:
            tags += [(TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, 4, tuple(offsets)), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIP_OFFSETS, 4, tuple(offsets)), (ROWS_PER_STRIP, 4, (rows_per_strip,)), (STRIP_BYTES, 4, sizes)]
        if descriptions:
            tags.append((DESCRIPTION, 2, (descriptions[k].encode("latin-1") + b"\0",)))
        tags.sort(key=lambda t: t[0])
        at = len(out)
        struct.pack_into(order + "I", out, link, at)
        entries, more, free = [], bytearray(), at + 6 + 12 * len(tags)
        for tag, kind, values in tags:
            form, _ = TYPES[kind]
            body = values[0] if form == "s" else struct.pack(order + form * len(values), *values)
            count = len(body) if form == "s" else len(values)
            if len(body) <= 4:
                entries.append(struct.pack(order + "HHI", tag, kind, count) + body.ljust(4, b"\0"))
            else:
                entries.append(struct.pack(order + "HHII", tag, kind, count, free + len(more)))
                more += body + b"\0" * (len(body) % 2)
        out += struct.pack(order + "H", len(tags)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0) + more
    return bytes(out)


PAGE_ROWS = "key long, page int, width int, height int, samples int, bits int, compression int, description string, pixels binary, error string"


def _read(batches):
    import pandas as pd

    names = [x.split()[0] for x in PAGE_ROWS.split(", ")]
    for batch in batches:
        for key, media in zip(batch["key"], batch["media"], strict=True):
            key, k = None if pd.isna(key) else int(key), 0
            rows = []
            try:
                for p in pages(media):
                    rows.append((key, k, p.width, p.height, p.samples, p.bits, p.compression, p.description, p.pixels.tobytes(), None))
                    k += 1
            except ValueError as e:
                rows.append((key, k, None, None, None, None, None, None, None, str(e)))
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("key", "width", "height", "samples", "bits", "compression")})


def read_pages(spark: SparkSession, media: DataFrame) -> DataFrame:
    """One row for each page of media (key, media)."""
    work.prepare(spark)
    return media.select(F.col("key").cast("long").alias("key"), F.col("media").cast("binary").alias("media")).where("media is not null").mapInPandas(work.tidy(_read), PAGE_ROWS)


ROW_BYTES = 192
#: Rows of a text's page at most (96 KiB), rows from which a page is tiled, and rows of a strip.
PAGE_ROWS_OF_TEXT, TILE, STRIP_ROWS = 512, 64, 16
#: Bytes up to which a page is coded by LZW, and the share of bytes like the one before from which it is by PackBits.
LZW_BYTES, REPEATS = 768, 0.4
COLUMNS = "k long, m boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def layout_of(page: np.ndarray) -> Layout:
    """The codec and layout for a page (rows, 64, 3) of a text."""
    flat = page.reshape(-1)
    tile = TILE if len(page) >= TILE else 0
    if np.count_nonzero(flat[1:] == flat[:-1]) >= REPEATS * len(flat):
        return Layout(PACKBITS, 1, STRIP_ROWS, tile)
    if len(flat) <= LZW_BYTES:
        return Layout(LZW, 1, STRIP_ROWS, tile)
    sample = flat[:4096].tobytes()
    return Layout(DEFLATE if len(zlib.compress(sample, 1)) < len(sample) else NONE, 2, STRIP_ROWS * 4, tile)


def text_image(text: bytes) -> bytes:
    """A text as pictures: 64 pixels of 3 samples a row, filled up with spaces; its length is the first description."""
    padded = text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))
    rows = np.frombuffer(padded, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    images = [rows[at : at + PAGE_ROWS_OF_TEXT] for at in range(0, len(rows), PAGE_ROWS_OF_TEXT)]
    return write(images, [layout_of(x) for x in images], [f"bytes={len(text)}" if k == 0 else f"page {k}" for k in range(len(images))])


def feature(pixels: np.ndarray, n_pages: int) -> str:
    """Of all pages (height, width, samples): size, mean and deviation of the samples, shares of 8 brightness bins, a
    coarse picture of 16 row bands, and the number of pages."""
    height, width, samples = pixels.shape
    flat = pixels.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    levels = np.arange(256)
    mean = float((counts * levels).sum()) / len(flat)
    deviation = max(0.0, float((counts * levels * levels).sum()) / len(flat) - mean * mean) ** 0.5
    bins = counts.reshape(8, 32).sum(axis=1)
    rows = pixels.reshape(height, -1).sum(axis=1, dtype=np.int64)
    edges = np.linspace(0, height, 17).astype(int)
    bands = [int(rows[a:b].sum() > mean * (b - a) * width * samples) for a, b in zip(edges, edges[1:], strict=False)]
    code = int("".join(map(str, bands)), 2)
    return f"{width}x{height}x{samples};{mean:.4f};{deviation:.4f};{'/'.join(f'{b / len(flat):.4f}' for b in bins)};{code:04x};{n_pages}"


def _store(batches):
    for batch in batches:
        yield batch[["k", "m"]].assign(media=[text_image(t.encode("utf-8", "surrogatepass")) for t in batch["text"]])


def _digest(batches):
    import pandas as pd

    for batch in batches:
        rows = []
        for k, m, media in zip(batch["k"], batch["m"], batch["media"], strict=True):
            found = list(pages(media))
            pixels = np.concatenate([p.pixels for p in found])
            payload = pixels.tobytes()
            rows.append((k, m, int(found[0].description.removeprefix("bytes=")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels, len(found))))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])


def text_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(k, m, media): each document's text stored as a TIFF file; m marks a null doc_id."""
    work.prepare(spark)
    key = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(work.tidy(_store), "k long, m boolean, media binary")


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store each text as a TIFF file, read it back, and give digests and features of what was read."""
    out = text_media(spark, docs).mapInPandas(work.tidy(_digest), COLUMNS)
    names = [x.split()[0] for x in COLUMNS.split(", ")][2:]
    return out.select(F.when(~F.col("m"), F.col("k")).alias("doc_id"), *names)
