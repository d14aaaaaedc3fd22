"""Media columns: Netpbm and BMP files in binary columns, as numpy arrays.

``with_media`` stores payloads as images in a binary column; ``describe`` reads
such a column back and computes features.  ``decode`` reads PGM (P2, P5), PPM
(P3, P6) and uncompressed 8- and 24-bit BMP; ``encode`` writes PGM, PPM and BMP
without loss.  ``area_resize`` averages over areas by an integral image, with
fractions of border pixels; ``dhash`` compares neighbours of a 9 x 8
area-resized luma; ``npy_tile`` is a small tile in NPY form.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Formats of stored payloads; a payload's CRC-32 chooses.
KINDS = ("pgm", "ppm", "bmp")
#: Bytes that payloads are padded to a multiple of: 24 x 24 samples, or 192 pixels of three.
UNIT, WIDTH, PAD = 576, 24, 255
#: Luma weights of Rec. 601 (fixed values).
LUMA = np.array([0.299, 0.587, 0.114])
#: Rows of a picture that are summed at once.
STRIP = 1 << 14
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode(a: np.ndarray, kind: str = "pgm") -> bytes:
    """An array of shape (h, w) or (h, w, 3), of 8-bit samples, as a pgm, ppm or bmp file."""
    h, w = a.shape[:2]
    if kind in ("pgm", "ppm"):
        if (a.ndim == 3) != (kind == "ppm"):
            raise ValueError(f"{kind} cannot hold shape {a.shape}")
        return b"P%d\n%d %d\n255\n" % (6 if kind == "ppm" else 5, w, h) + np.ascontiguousarray(a, np.uint8).tobytes()
    if kind != "bmp":
        raise ValueError(f"unknown format {kind}")
    depth, row = (24, w * 3) if a.ndim == 3 else (8, w)
    rows = np.zeros((h, (row + 3) // 4 * 4), np.uint8)
    rows[:, :row] = (a[::-1, :, ::-1] if a.ndim == 3 else a[::-1]).reshape(h, row)
    table = b"" if depth == 24 else b"".join(bytes([i, i, i, 0]) for i in range(256))
    at = 54 + len(table)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, w, h, 1, depth, 0, rows.size, 2835, 2835, len(table) // 4, 0) + table + rows.tobytes()


def decode(b: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP file; ValueError where it is neither, empty, cut short, or holds samples out of range."""
    if b[:2] == b"BM":
        return _decode_bmp(b)
    if b[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    at, head = 2, []
    for _ in range(3):
        if not (m := _TOKEN.match(b, at)):
            raise ValueError("header is cut short")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = head
    if not 0 < top < 256:
        raise ValueError("samples are not of 8 bits")
    if min(w, h) < 1:
        raise ValueError("the picture has no pixels")
    shape = (h, w, 3) if b[1:2] in b"36" else (h, w)
    n = math.prod(shape)
    if b[1:2] in b"56":
        at += 1
        if len(b) < at + n:
            raise ValueError("samples are cut short")
        a = np.frombuffer(b, np.uint8, n, at)
    else:
        a = np.array([int(x) for x in b[at:].split(maxsplit=n)[:n]], object)
        if len(a) < n:
            raise ValueError("samples are cut short")
        if min(a) < 0 or max(a) > top:
            raise ValueError("samples are out of range")
    if a.max() > top:
        raise ValueError("samples are out of range")
    return a.astype(np.uint8).reshape(shape)


def _decode_bmp(b: bytes) -> np.ndarray:
    if len(b) < 54:
        raise ValueError("header is cut short")
    at, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", b, 10)
    used = struct.unpack_from("<I", b, 46)[0]
    if packed or depth not in (8, 24):
        raise ValueError("only uncompressed 8 and 24 bits are read")
    if w < 1 or not h:
        raise ValueError("the picture has no pixels")
    row, up = w * depth // 8, h > 0
    h, wide = abs(h), (w * depth // 8 + 3) // 4 * 4
    if len(b) < at + h * wide:
        raise ValueError("samples are cut short")
    a = np.frombuffer(b, np.uint8, h * wide, at).reshape(h, wide)[:, :row]
    a = a[::-1] if up else a
    if depth == 24:
        return a.reshape(h, w, 3)[:, :, ::-1]
    if used > 256 or 14 + head + (used or 256) * 4 > len(b):
        raise ValueError("the palette is cut short")
    table = np.frombuffer(b, np.uint8, (used or 256) * 4, 14 + head).reshape(-1, 4)
    if a.max() >= len(table):
        raise ValueError("samples lie outside the palette")
    gray = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
    return table[a, 0] if gray else table[a][:, :, 2::-1]


def _integral(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The wanted rows (ascending, from 0) of the integral image, summed in strips so that only they are held."""
    out = np.zeros((len(rows), a.shape[1] + 1, *a.shape[2:]))
    last = out[0].copy()
    for top in range(0, a.shape[0], STRIP):
        s = np.cumsum(a[top : top + STRIP], 0, dtype=np.float64)
        np.cumsum(s, 1, out=s)
        s += last[1:]
        lo, hi = np.searchsorted(rows, (top + 1, top + len(s) + 1))
        out[lo:hi, 1:] = s[rows[lo:hi] - top - 1]
        last[1:] = s[-1]
    return out


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each of h x w equal areas, from an integral image read between its points where areas cut pixels."""

    def cells(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        edges = np.arange(n + 1) * (size / n)
        lo = np.minimum(edges.astype(np.int64), size - 1)
        return lo, edges - lo

    (y, fy), (x, fx) = cells(h, a.shape[0]), cells(w, a.shape[1])
    rows = np.unique(np.concatenate((y, y + 1)))
    s = _integral(a, rows)
    at = np.searchsorted(rows, y)
    fy, fx = (f.reshape(-1, *[1] * (s.ndim - 1 - k)) for k, f in enumerate((fy, fx)))
    s = s[at] * (1 - fy) + s[at + 1] * fy
    s = s[:, x] * (1 - fx) + s[:, x + 1] * fx
    return np.diff(np.diff(s, axis=0), axis=1) * (h * w / (a.shape[0] * a.shape[1]))


def luma(a: np.ndarray) -> np.ndarray:
    return a @ LUMA if a.ndim == 3 else a


def dhash(a: np.ndarray) -> str:
    """64 bits as 16 hex digits: of each row of an 8 x 9 resize, whether a cell is brighter than the next."""
    g = np.round(area_resize(luma(a), 8, 9), 6)
    return np.packbits((g[:, :-1] > g[:, 1:]).ravel()).tobytes().hex()


def npy_tile(a: np.ndarray, side: int = 8) -> bytes:
    """An area-resized tile of ``side`` squared, rounded to 8 bits, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(a, side, side) + 0.5).clip(0, 255).astype(np.uint8))
    return out.getvalue()


def text_payload(text: str | None) -> tuple[int, bytes]:
    """(unpadded size, UTF-8 bytes padded with 255 to a positive multiple of UNIT)."""
    b = (text or "").encode()
    return len(b), b + bytes([PAD]) * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))


def store_payload(payload: bytes, kind: str = "pgm") -> bytes:
    """A payload as the samples of an image of WIDTH columns (ppm, bmp: pixels of three samples)."""
    a = np.frombuffer(payload, np.uint8)
    return encode(a.reshape(-1, WIDTH) if kind == "pgm" else a.reshape(-1, WIDTH, 3), kind)


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def with_media(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """key, n_bytes (unpadded), kind, media (binary): each row's whole text as an image file.

    One row per input row, null keys and repeated rows included; a null text is
    empty and gives one unit of padding; an empty table gives no rows.  Kind and
    bytes depend on the text alone.  Other columns are not read.
    """
    src = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                n, kind, media = [], [], []
                for t in part.column(1).to_pylist():
                    size, payload = text_payload(t)
                    n.append(size)
                    kind.append(kinds[zlib.crc32(payload) % len(kinds)])
                    media.append(store_payload(payload, kind[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(kind, pa.string()), pa.array(media, pa.binary())], names=[key, "n_bytes", "kind", "media"])

    return src.mapInArrow(run, f"{_fields(src, [key])}, n_bytes long, kind string, media binary")


def describe(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes", "kind"), with_tile: bool = False) -> DataFrame:
    """The ``keep`` columns, then what the image files in ``media`` hold.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 32 bytes) of the
    samples in reading order, media_bytes and media_sha256 of the file, width,
    height, feature (``dhash``) and tile_sha256 (of ``npy_tile``); with
    ``with_tile`` also tile (binary).  One row per input row.  A null file gives
    nulls; a broken one too, with what is wrong in ``error`` (null elsewhere), the
    last column.  Equal files, equal values.
    """
    src = df.select(media, *keep)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "tile_sha256", *["tile"] * with_tile, "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.binary()] * with_tile, pa.string()]
    said = ["long", "string", "long", "long", "string", "int", "int", "string", "string", *["binary"] * with_tile, "string"]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def one(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * len(names)
        try:
            a = decode(file)
        except ValueError as e:  # one broken file must not end the job
            return (*(None,) * (len(names) - 1), f"{type(e).__name__}: {e}")
        back, tile = a.tobytes(), npy_tile(a)
        row = (len(back), sha(back), zlib.crc32(back[-32:]), len(file), sha(file), a.shape[1], a.shape[0], dhash(a), sha(tile))
        return (*row, tile, None) if with_tile else (*row, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*[one(x.as_py()) for x in b.column(0)])) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep, *names])

    return src.mapInArrow(run, ", ".join([_fields(src, list(keep)), *(f"{n} {k}" for n, k in zip(names, said))]))


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS, with_tile: bool = False) -> DataFrame:
    """``describe`` of ``with_media``: each row's whole text stored as an image, read back and described; a clashing column of ``df`` does no harm."""
    return describe(with_media(df, key, text, kinds), keep=(key, "n_bytes", "kind"), with_tile=with_tile)
