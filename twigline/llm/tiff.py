"""TIFF media columns (operator 5): a reader that emits one row per page, and a plain writer.

The reader walks the chain of image directories, takes strips or tiles, undoes PackBits, LZW or deflate compression
and the horizontal predictor, and gives each page's samples.  After the TIFF 6.0 specification (Adobe, 1992) and its
technical notes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the file format.
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
COMPRESSIONS = {"none": NONE, "lzw": LZW, "deflate": ADOBE_DEFLATE, "packbits": PACKBITS}


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader takes."""


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        i += 1
        if k < 128:
            out.append(data[i : i + k + 1])
            i += k + 1
        elif k > 128:
            out.append(data[i : i + 1] * (257 - k))
            i += 1
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 1 < n and data[i + 1] == data[i]):
            i += 1
        out += bytes([i - start - 1]) + data[start:i]
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: high bits first, codes 9 to 12 bits, wider one code early."""
    clear, stop = 256, 257
    words: list[bytes] = []
    out, acc, have, width, last = [], 0, 0, 9, b""
    for byte in data:
        acc = acc << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == clear:
            words = [bytes([b]) for b in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if code == stop:
            break
        if not words:
            raise TiffError("LZW data without a clear code")
        if code < len(words):
            word = words[code]
        elif last and code == len(words):
            word = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(word)
        if last and len(words) < 4096:
            words.append(last + word[:1])
        width = min(12, max(9, (len(words) + 1).bit_length()))
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    clear, stop = 256, 257
    out, acc, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, have
        acc = acc << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(acc >> have & 255)
        acc &= (1 << have) - 1

    table = {bytes([b]): b for b in range(256)}
    size, width, word = 258, 9, b""
    put(clear, 9)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = size
        size += 1
        width = max(9, size.bit_length())
        word = data[k : k + 1]
        if size >= 4094:
            put(table[word], width)
            put(clear, width)
            table = {bytes([b]): b for b in range(256)}
            size, width, word = 258, 9, b""
    if word:
        put(table[word], width)
        width = max(9, (size + 1).bit_length())
    put(stop, width)
    if have:
        out.append(acc << (8 - have) & 255)
    return bytes(out)


def _tags(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(data):
        raise TiffError("a directory lies outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("a directory is cut off")
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        code, size = TYPES[kind]
        place = at + 2 + 12 * k + 8
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * count > len(data):
            raise TiffError("a tag's values lie outside the file")
        if not count:
            continue
        if code == "c":
            tags[tag] = (data[place : place + count],)
        else:
            tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _expand(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    if compression in (DEFLATE, ADOBE_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(f"deflate data: {e}") from e
    raise TiffError(f"compression {compression} is not supported")


def _samples(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Samples of a strip or tile, (rows, width, samples); those of 1, 2 or 4 bits start each row at a byte."""
    row = -(-width * samples * bits // 8)
    if len(raw) < rows * row:
        raise TiffError("a strip or tile is too short")
    if bits < 8:
        if predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported with {bits} bits")
        packed = np.frombuffer(raw[: rows * row], np.uint8).reshape(rows, row)
        ones = np.unpackbits(packed, axis=1)[:, : width * samples * bits].reshape(rows, width, samples, bits)
        return (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    kind = np.dtype({8: "u1", 16: order + "u2", 32: order + "u4"}[bits])
    x = np.frombuffer(raw[: rows * row], kind).reshape(rows, width, samples)
    if predictor == 2:
        x = np.add.accumulate(x.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return x


def _number(tags: dict[int, tuple], tag: int, default: int | None = None) -> int | None:
    values = tags.get(tag) or (default,)
    if values[0] is not None and (not isinstance(values[0], int) or values[0] < 0):
        raise TiffError(f"tag {tag} is no number from 0")
    return values[0]


def _numbers(tags: dict[int, tuple], tag: int) -> tuple[int, ...]:
    values = tags.get(tag, ())
    if not all(isinstance(v, int) and v >= 0 for v in values):
        raise TiffError(f"tag {tag} holds no numbers from 0")
    return values


def _most(size: int, compression: int) -> int:
    """Bytes that so many compressed bytes can expand to: the formats' limits, with room."""
    return size * {NONE: 1, PACKBITS: 64, LZW: 4096}.get(compression, 1100) + 64


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    width, height = _number(tags, WIDTH), _number(tags, HEIGHT)
    if not width or not height:
        raise TiffError("a page without size")
    samples = _number(tags, SAMPLES, 1)
    if not samples:
        raise TiffError("a page without samples")
    bits = set(_numbers(tags, BITS) or (1,))
    if len(bits) != 1 or not bits <= {1, 2, 4, 8, 16, 32}:
        raise TiffError(f"{sorted(bits)} bits a sample are not supported")
    (depth,) = bits
    compression, predictor = _number(tags, COMPRESSION, NONE), _number(tags, PREDICTOR, 1)
    planes = _number(tags, PLANAR, 1)
    per = samples if planes == 1 else 1
    layers = 1 if planes == 1 else samples
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h = _number(tags, TILE_WIDTH), _number(tags, TILE_HEIGHT)
        offsets, counts = _numbers(tags, TILE_OFFSETS), _numbers(tags, TILE_COUNTS)
    else:
        w, h = width, min(height, _number(tags, ROWS_PER_STRIP, height) or height)
        offsets, counts = _numbers(tags, STRIP_OFFSETS), _numbers(tags, STRIP_COUNTS)
    if not w or not h:
        raise TiffError("strips or tiles without size")
    across, down = -(-width // w), -(-height // h)
    many = across * down * layers
    if len(offsets) < many or len(counts) < many:
        raise TiffError("strips or tiles are missing")
    for at, size in zip(offsets[:many], counts[:many], strict=True):
        if at + size > len(data):
            raise TiffError("a strip or tile lies outside the file")
    # no memory for samples that the strips or tiles can't hold
    row = -(-w * per * depth // 8)
    for k in range(many):
        rows = h if tiled else min(h, height - k % (across * down) * h)
        if rows * row > _most(counts[k], compression):
            raise TiffError("a strip or tile is too short")
    out = np.zeros((height, width, samples), dtype=f"u{max(1, depth // 8)}")
    for layer in range(layers):
        for k in range(across * down):
            y, x = k // across * h, k % across * w
            i = layer * across * down + k
            rows = h if tiled else min(h, height - y)
            raw = _expand(data[offsets[i] : offsets[i] + counts[i]], compression)
            part = _samples(raw, rows, w, per, depth, predictor, order)[: height - y, : width - x]
            if planes == 1:
                out[y : y + part.shape[0], x : x + part.shape[1]] = part
            else:
                out[y : y + part.shape[0], x : x + part.shape[1], layer] = part[:, :, 0]
    return {"width": width, "height": height, "samples": samples, "bits": depth, "compression": compression, "pixels": out}


def read_directories(data: bytes) -> Iterator[dict | TiffError]:
    """Every page in the order of the directories, or what is wrong with it; pixels as an array (height, width, samples).

    A page that can't be read does not hide those after it; a broken chain of directories ends with its fault.
    """
    try:
        if data[:4] == b"II*\0":
            order = "<"
        elif data[:4] == b"MM\0*":
            order = ">"
        else:
            raise TiffError("no TIFF header")
        if len(data) < 8:
            raise TiffError("the header is cut off")
        (at,) = struct.unpack_from(order + "I", data, 4)
        if not at:
            raise TiffError("no directory")
        seen = set()
        while at:
            if at in seen:
                raise TiffError("the directories form a loop")
            seen.add(at)
            tags, following = _tags(data, at, order)
            try:
                page = _page(data, tags, order)
            except TiffError as e:
                page = e
            except (ValueError, OverflowError, MemoryError, IndexError, struct.error) as e:
                page = TiffError(f"unreadable: {e}")
            yield page
            at = following
    except TiffError as e:
        yield e


def read_pages(data: bytes) -> Iterator[dict]:
    """Every page; raises at the first that can't be read."""
    for page in read_directories(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def write_tiff(
    pages: list[np.ndarray],
    compression: str = "deflate",
    predictor: bool = True,
    strip_bytes: int = 1 << 16,
    tile: tuple[int, int] | None = None,
    order: str = "<",
    level: int = 1,
) -> bytes:
    """Bytes of a TIFF with these (height, width[, samples]) arrays of unsigned 8 or 16 bits as pages."""
    head = b"II*\0" if order == "<" else b"MM\0*"
    out = [head, b""]
    size = 8
    links: list[tuple[int, int]] = []  # place of a link to the next directory: part of out, offset in it
    first = 0
    squeeze = {"none": bytes, "lzw": lzw_encode, "packbits": packbits_encode, "deflate": lambda b: zlib.compress(b, level)}
    for page in pages:
        x = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = x.shape
        kind = np.dtype(f"{order}u{x.dtype.itemsize}")
        if tile:
            h, w = tile
        else:
            h, w = max(1, min(height, strip_bytes // max(1, width * samples * x.dtype.itemsize))), width
        offsets, counts = [], []
        for y in range(0, height, h):
            for left in range(0, width, w):
                part = x[y : y + h, left : left + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = squeeze[compression](part.astype(kind).tobytes())
                offsets.append(size)
                counts.append(len(raw))
                raw += b"\0" * (len(raw) % 2)
                out.append(raw)
                size += len(raw)
        tags: list[tuple[int, int, list[int]]] = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * x.dtype.itemsize] * samples),
            (COMPRESSION, 3, [COMPRESSIONS[compression]]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [samples]),
            (PLANAR, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1]),
        ]
        if tile:
            tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_COUNTS, 4, counts)]
        tags.sort()
        entries, extra = [struct.pack(order + "H", len(tags))], []
        beyond = size + 2 + 12 * len(tags) + 4
        for tag, code, values in tags:
            raw = struct.pack(f"{order}{len(values)}{TYPES[code][0]}", *values)
            entry = struct.pack(order + "HHI", tag, code, len(values))
            if len(raw) <= 4:
                entries.append(entry + raw.ljust(4, b"\0"))
            else:
                entries.append(entry + struct.pack(order + "I", beyond))
                raw += b"\0" * (len(raw) % 2)
                extra.append(raw)
                beyond += len(raw)
        if links:
            part, place = links.pop()
            out[part] = out[part][:place] + struct.pack(order + "I", size) + out[part][place + 4 :]
        else:
            first = size
        directory = b"".join(entries)
        links.append((len(out), len(directory)))
        out.append(directory + b"\0\0\0\0" + b"".join(extra))
        size += len(out[-1])
    out[1] = struct.pack(order + "I", first)
    return b"".join(out)


PAGE_FIELDS = (
    "page int, width int, height int, samples int, bits int, compression int, pixels binary, feature string, error string"
)


def page_feature(x: np.ndarray) -> str:
    """Mean, deviation and a histogram of 8 classes of the samples: equal pages give equal text."""
    x = x.astype(np.float64) / (1 << 8 * (x.dtype.itemsize - 1))
    counts = np.histogram(x, bins=8, range=(0, 256))[0]
    return f"{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, counts.tolist()))


def tiff_pages(df: DataFrame, media_col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per page of every TIFF in ``media_col``: the columns of ``keep`` and the page's fields.

    ``pixels`` holds the samples row by row, little-endian; samples under 8 bits take a byte each.  Null media gives no
    rows.  A page that can't be read gives a row with its number and ``error``, and the pages after it follow; bytes that
    are no TIFF, or whose chain of directories breaks, give one such row at that place.  Kept columns with the name of
    a page field give way to it.  Narrow: no shuffle.
    """
    names = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    keep = [c for c in (keep if keep is not None else df.columns) if c != media_col and c not in names]
    schema = df.select(*keep).schema
    for f in StructType.fromDDL(PAGE_FIELDS):
        schema = schema.add(f)
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(batch.num_columns - 1)
            kept = batch.select(list(range(batch.num_columns - 1)))
            rows: list[int] = []
            found: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                data = media[i].as_py()
                if data is not None:
                    for n, p in enumerate(read_directories(data)):
                        rows.append(i)
                        if isinstance(p, TiffError):
                            found.append((n, *[None] * 7, str(p) or "unreadable"))
                            continue
                        x = p["pixels"]
                        raw = x.astype(x.dtype.newbyteorder("<"), copy=False).tobytes()
                        sizes = (n, p["width"], p["height"], p["samples"], p["bits"], p["compression"])
                        found.append((*sizes, raw, page_feature(x), None))
                        held += len(raw)
                if rows and (held > 8_000_000 or i == batch.num_rows - 1):
                    cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept.take(pa.array(rows)).columns, *cols], [*keep, *names])
                    rows, found, held = [], [], 0

    return df.select(*keep, media_col).mapInArrow(pages, schema)


def payload(text: str | None, multiple: int = 64) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % multiple if raw else multiple)


def text_media(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, compression: str = "deflate") -> DataFrame:
    """Store every whole text as a one-page 8-bit TIFF of 64 samples a row: columns n_bytes and media besides ``keep``.

    Null text is stored as the empty one (64 zeros).  Narrow.
    """
    keep = [c for c in (keep or []) if c not in ("n_bytes", "media")]
    schema = df.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < batch.num_rows:
                sizes, media, held, start = [], [], 0, at
                while at < batch.num_rows and held < 8_000_000:
                    text = texts[at].as_py()
                    raw = payload(text)
                    sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                    media.append(write_tiff([np.frombuffer(raw, np.uint8).reshape(-1, 64)], compression))
                    held += len(raw)
                    at += 1
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    [*keep, "n_bytes", "media"],
                )

    return df.select(*keep, text_col).mapInArrow(store, schema)


def op5_media(spark, sf_dir):  # noqa: ANN001, ANN201
    """Digest of all texts stored as TIFF pages and read back."""
    from twigline.llm.common import table

    stored = text_media(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    stored = stored.withColumns(
        {"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)}
    )
    pages = tiff_pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
