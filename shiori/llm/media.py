"""Media columns: raster images held in binary columns.

Netpbm (P1-P6) and BMP (1, 4, 8, 24 and 32 bit, uncompressed) bytes are decoded
to numpy arrays, resized by area with integral images, and turned into NPY tiles
and 64-bit difference hashes.  :func:`text_media` stores any bytes losslessly as
the samples of such an image: the images are written to the shared folder, read
back, decoded and measured, and their tiles are written there in turn.

Sums over areas are whole numbers (grey values in thousandths, edges in fractions
of a pixel), so tiles and hashes hang on no rounding.  An image is taken in bands
of rows; beside its samples, memory holds a few numbers for each of its rows.

Edge cases: a null text is the empty text; every payload is padded to a positive
multiple of 192 bytes, so the empty text is one row of 64 blank RGB pixels.
Equal texts get equal values; repeated rows stay repeated.  Columns of the input
other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.common import release, written

#: Bytes of a row of pixels: 64 pixels of three samples.
ROW_BYTES = 192
TILE = (8, 9)  # rows, columns: a difference hash compares 8 pairs in each of 8 rows
#: Weights of red, green and blue in grey, in thousandths.
LUMA = (299, 587, 114)
#: Rows of pixels that are summed at a time; rows and bytes of a batch that is handed on.
BAND, BATCH_ROWS, BATCH_BYTES = 1024, 512, 4 << 20

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for (h, w) and P6 for (h, w, 3) arrays of uint8."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP of an (h, w, 3) array of uint8."""
    h, w = pixels.shape[:2]
    pad = -(w * 3) % 4
    rows = np.zeros((h, w * 3 + pad), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    head = b"BM" + (54 + rows.size).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = b"".join(v.to_bytes(n, "little") for v, n in ((40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (rows.size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)))
    return head + info + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 to uint8 or uint16 samples; bitmaps become 0 (black) and 255 (white)."""
    kind, at, fields = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("truncated Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top = fields[2] if len(fields) > 2 else 1
    planes = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*\n|[^01]", b"", data[at:]), np.uint8)[: w * h] - 48
        out = (1 - bits) * np.uint8(255)
    elif kind in (b"P2", b"P3"):
        values = re.sub(rb"#[^\n]*(\n|$)", b" ", data[at:]).split()[: w * h * planes]
        out = np.array(values, np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, -(-w // 8) * h, at + 1).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    elif kind in (b"P5", b"P6"):
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * planes, at + 1)
    else:
        raise ValueError("not a Netpbm image")
    if out.size != w * h * planes:
        raise ValueError("truncated Netpbm image")
    return out.reshape((h, w, 3) if planes == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP with 1, 4, 8, 24 or 32 bits a pixel to (h, w, 3) uint8."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    at, head = (int.from_bytes(data[i : i + 4], "little") for i in (10, 14))
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    colours = int.from_bytes(data[46:50], "little") or 1 << bits
    table = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack((rows >> 4, rows & 15), axis=2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    return table[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m + 1 edges of m equal parts of n pixels: whole pixels, and the rest in m-ths of one."""
    at = np.arange(m + 1, dtype=np.int64) * n
    return at // m, at % m


def _between(total: np.ndarray, m: int) -> np.ndarray:
    """Differences of an integral (n + 1 rows) at the edges of m equal parts, times m."""
    n = len(total) - 1
    whole, rest = _edges(n, m)
    at = total[whole]
    return np.diff(m * at + rest.reshape(-1, *[1] * (total.ndim - 1)) * (total[np.minimum(whole + 1, n)] - at), axis=0)


def area_sums(pixels: np.ndarray, shape: tuple[int, int], grey=lambda x: x) -> np.ndarray:
    """Sums over the source area of each target pixel, times rows and columns of ``shape``, by an integral image in bands."""
    h, w = pixels.shape[:2]
    kind = np.int64 if pixels.dtype.kind in "ui" else np.float64
    rows = np.zeros((h + 1, shape[1]), kind)
    for at in range(0, h, BAND):
        band = grey(pixels[at : at + BAND])
        total = np.zeros((w + 1, len(band)), kind)
        np.cumsum(band.T, axis=0, dtype=kind, out=total[1:])
        rows[at + 1 : at + 1 + len(band)] = _between(total, shape[1]).T
    return _between(np.cumsum(rows, axis=0), shape[0])


def area_resize(pixels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mean over the (fractional) source area of each target pixel."""
    return area_sums(pixels, shape) / (pixels.shape[0] * pixels.shape[1])


def luma(pixels: np.ndarray) -> np.ndarray:
    """Grey values in thousandths."""
    wide = pixels.astype(np.int64)
    return wide @ np.array(LUMA) if wide.ndim == 3 else wide * 1000


def tile_and_hash(pixels: np.ndarray) -> tuple[bytes, str]:
    """NPY bytes of the 8 x 9 grey tile, and its difference hash as 16 hex digits."""
    sums, area = area_sums(pixels, TILE, luma), 1000 * pixels.shape[0] * pixels.shape[1]
    tile = np.minimum((2 * sums + area) // (2 * area), 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue(), np.packbits(sums[:, 1:] > sums[:, :-1]).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    """The bytes, padded with 32 to a positive multiple of 192."""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())


def _batches(rows: Iterator[tuple], names: list[str], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """Rows of (bytes held, values) as batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=False)], names=names)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, form: str = "ppm") -> DataFrame:
    """doc_id, n_bytes and ``media``: every text's payload as the samples of an image (``ppm`` or ``bmp``)."""
    encoder = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                    raw = text.as_py() or b""
                    media = encoder(np.frombuffer(payload_of(raw), np.uint8).reshape(-1, ROW_BYTES // 3, 3))
                    yield len(media), (doc.as_py(), len(raw), media)

        yield from _batches(rows(), ["doc_id", "n_bytes", "media"], (pa.int64(), pa.int64(), pa.binary()))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def measured(stored: DataFrame, *, with_media: bool = False) -> DataFrame:
    """What the images of ``stored`` (doc_id, n_bytes, media) give when they are decoded: SCHEMA, and ``media`` if asked for."""
    schema = SCHEMA + (", media binary" if with_media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, n, media in zip(*batch.columns, strict=True):
                    media = media.as_py()
                    pixels = decode(media)
                    back = np.ascontiguousarray(pixels).data
                    tile, feature = tile_and_hash(pixels)
                    row = (doc.as_py(), n.as_py(), back.nbytes, hashlib.sha256(back).hexdigest(), zlib.crc32(bytes(back.cast("B")[-16:])), len(media), hashlib.sha256(media).hexdigest(), feature, tile)
                    yield len(media), (*row, media) if with_media else row

        yield from _batches(rows(), [x.split()[0] for x in schema.split(", ")], KINDS)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, form: str = "ppm", with_bytes: bool = True) -> DataFrame:
    """Every text as an image column: stored in the shared folder, read back, hashed and tiled.

    With ``with_bytes`` the columns ``media`` (the stored image) and ``tile``
    (NPY) come along; else only what is derived from them.  No shuffle; memory
    is one Arrow batch and one image.
    """
    stored = written(encode_texts(df, id_col, text_col, form=form), "media-images")
    tiles = written(measured(stored, with_media=with_bytes), "media-tiles")
    release(stored)
    out = tiles.withColumn("tile_sha256", F.sha2("tile", 256))
    return out if with_bytes else out.drop("tile")
