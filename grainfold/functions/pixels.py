"""Pictures as numpy arrays: measures, resampling, adjustment, compositing, PNG and EXIF.

Arrays are (h, w) or (h, w, c) of 8-bit samples in RGB(A) order.  Two luma
conventions are named apart: LUMA_VIDEO for adjustment, LUMA_GRAY for hashes
and quality.
"""

from __future__ import annotations

import struct
import zlib
from datetime import datetime, timezone

import numpy as np

#: Luma weights (fixed values): Rec. 601 and Rec. 709.
LUMA_VIDEO, LUMA_GRAY = np.array([0.299, 0.587, 0.114]), np.array([0.2126, 0.7152, 0.0722])
WORK_SIDE = 1024
HIGH, LOW = 250, 5


def half_up(x: np.ndarray | float):
    """Rounded half away from zero."""
    return np.trunc(x + np.copysign(0.5, x))


def gray(a: np.ndarray) -> np.ndarray:
    if a.ndim == 2:
        return a
    return np.clip(half_up(a[:, :, :3].astype(np.float64) @ LUMA_GRAY), 0, 255).astype(np.uint8)


# ---- resampling: separable kernels, widened when shrinking --------------------------------------


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


KERNELS = {"triangle": (_triangle, 1.0), "lanczos3": (_lanczos3, 3.0)}


def _along(a: np.ndarray, size: int, kernel: str) -> np.ndarray:
    """Resamples axis 0."""
    f, support = KERNELS[kernel]
    n = a.shape[0]
    scale = max(n / size, 1.0)
    reach = int(np.ceil(support * scale)) + 1
    centre = (np.arange(size) + 0.5) * (n / size)
    first = np.floor(centre).astype(int) - reach
    idx = first[:, None] + np.arange(2 * reach + 1)[None, :]
    w = f((idx + 0.5 - centre[:, None]) / scale) * ((idx >= 0) & (idx < n))
    w /= w.sum(1, keepdims=True)
    idx = idx.clip(0, n - 1)
    out = np.zeros((size, *a.shape[1:]))
    for k in range(idx.shape[1]):
        out += a[idx[:, k]] * w[:, k].reshape(-1, *[1] * (a.ndim - 1))
    return out


def resample(a: np.ndarray, w: int, h: int, kernel: str = "lanczos3") -> np.ndarray:
    """The picture at w x h; the same array where the size is unchanged."""
    if w <= 0 or h <= 0:
        raise ValueError("size must be positive")
    if a.shape[:2] == (h, w):
        return a
    x = _along(a.astype(np.float64), h, kernel)
    x = np.swapaxes(_along(np.swapaxes(x, 0, 1), w, kernel), 0, 1)
    return np.clip(half_up(x), 0, 255).astype(np.uint8)


def work_copy(a: np.ndarray, side: int = WORK_SIDE) -> np.ndarray:
    """Gray, its longer side reduced to ``side`` where it is longer."""
    h, w = a.shape[:2]
    if max(h, w) > side:
        k = side / max(h, w)
        a = resample(a, max(1, int(half_up(w * k))), max(1, int(half_up(h * k))), "triangle")
    return gray(a)


# ---- measures ------------------------------------------------------------------------------------


def dhash(a: np.ndarray) -> int:
    """64 bits, as a signed value: bit 8 y + x is set where a cell of a 9 x 8 copy is brighter than the next."""
    g = gray(resample(a, 9, 8, "triangle")).astype(int)
    bits = (g[:, :-1] > g[:, 1:]).ravel()
    v = sum(1 << i for i in np.flatnonzero(bits).tolist())
    return v - (1 << 64) if v >> 63 else v


def sharpness(g: np.ndarray) -> float:
    """Variance of the Laplacian over the interior; 0 for fewer than three rows or columns."""
    if min(g.shape) < 3:
        return 0.0
    x = g.astype(np.float64)
    lap = 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
    return max(0.0, float((lap * lap).mean() - lap.mean() ** 2))


def quality(a: np.ndarray) -> dict[str, float]:
    """sharpness_raw, clipped_highlights_pct, clipped_shadows_pct, mean_luma, contrast."""
    g = work_copy(a)
    if not g.size:
        return dict.fromkeys(("sharpness_raw", "clipped_highlights_pct", "clipped_shadows_pct", "mean_luma", "contrast"), 0.0)
    return {
        "sharpness_raw": sharpness(g), "clipped_highlights_pct": 100.0 * float((g >= HIGH).mean()), "clipped_shadows_pct": 100.0 * float((g <= LOW).mean()),
        "mean_luma": float(g.mean()), "contrast": float(g.std()),
    }


# ---- adjustment and compositing ------------------------------------------------------------------


def adjust(a: np.ndarray, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, temperature: float = 0.0) -> np.ndarray:
    """Shift, contrast about the middle, saturation about luma, then red against blue; alpha stays."""
    if not (brightness or contrast or saturation or temperature):
        return a
    if a.ndim == 2:
        a = np.repeat(a[:, :, None], 3, 2)
    x = a[:, :, :3].astype(np.float64) / 255 + brightness
    x = (x - 0.5) * np.clip(1 + contrast, 0, 3) + 0.5
    y = (x @ LUMA_VIDEO)[:, :, None]
    x = y + (x - y) * np.clip(1 + saturation, 0, 3)
    x[:, :, 0] += 0.1 * temperature
    x[:, :, 2] -= 0.1 * temperature
    out = a.copy()
    out[:, :, :3] = half_up(np.clip(x, 0, 1) * 255)
    return out


def with_alpha(a: np.ndarray) -> np.ndarray:
    if a.ndim == 2:
        a = np.repeat(a[:, :, None], 3, 2)
    return a if a.shape[2] == 4 else np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], 2)


def blend(base: np.ndarray, over: np.ndarray, x: int, y: int, opacity: float = 1.0) -> np.ndarray:
    """``over`` (RGBA) laid straight onto ``base`` (RGBA) at (x, y), cut at the borders."""
    h, w = base.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + over.shape[1], w), min(y + over.shape[0], h)
    if x0 >= x1 or y0 >= y1:
        return base
    o = over[y0 - y : y1 - y, x0 - x : x1 - x].astype(np.float64)
    b = base[y0:y1, x0:x1].astype(np.float64)
    a = o[:, :, 3:] / 255 * min(max(opacity, 0.0), 1.0)
    mixed = np.concatenate([o[:, :, :3] * a + b[:, :, :3] * (1 - a), (a + b[:, :, 3:] / 255 * (1 - a)) * 255], 2)
    out = base.copy()
    out[y0:y1, x0:x1] = np.where(a > 0, np.clip(half_up(mixed), 0, 255), b)
    return out


def compose_logo(base: np.ndarray, logo: np.ndarray, spec) -> np.ndarray:
    """A logo (``geometry.Logo``) on a picture: scaled by the picture's width, its centre where it should be, wholly inside."""
    base, logo = with_alpha(base), with_alpha(logo)
    (bh, bw), (lh, lw) = base.shape[:2], logo.shape[:2]
    if 0 in (bh, bw, lh, lw):
        raise ValueError("a picture has no pixels")
    tw = int(min(max(half_up(bw * min(max(spec.scale, 0.001), 1.0)), 1), bw))
    th = int(min(max(half_up(tw * lh / lw), 1), bh))
    x = int(max(min(half_up(bw * min(max(spec.x, 0.0), 1.0) - tw / 2), bw - tw), 0))
    y = int(max(min(half_up(bh * min(max(spec.y, 0.0), 1.0) - th / 2), bh - th), 0))
    if spec.background_rgba:
        pad = int(half_up(tw * max(spec.background_padding, 0.0)))
        box = np.broadcast_to(np.array(spec.background_rgba, np.uint8), (th + 2 * pad, tw + 2 * pad, 4))
        base = blend(base, box, x - pad, y - pad)
    return blend(base, resample(logo, tw, th), x, y, spec.opacity)


def center_crop(a: np.ndarray, tw: int, th: int) -> np.ndarray:
    """Cut to the target's aspect about the centre, then resampled to exactly tw x th."""
    h, w = a.shape[:2]
    if min(tw, th, h, w) <= 0:
        raise ValueError("size must be positive")
    if w / h > tw / th:
        cw, ch = int(max(min(half_up(h * tw / th), w), 1)), h
    else:
        cw, ch = w, int(max(min(half_up(w / (tw / th)), h), 1))
    x, y = (w - cw) // 2, (h - ch) // 2
    return resample(a[y : y + ch, x : x + cw], tw, th)


def orient(a: np.ndarray, orientation: int) -> np.ndarray:
    """The picture upright, by its EXIF orientation; other values change nothing."""
    turns = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: np.rot90(x, 2).swapaxes(0, 1), 8: np.rot90}
    return turns.get(orientation, lambda x: x)(a)


# ---- files ---------------------------------------------------------------------------------------


def png(a: np.ndarray) -> bytes:
    """An 8-bit gray, RGB or RGBA picture as a PNG file."""
    kind = {2: 0, 3: 2, 4: 6}[2 if a.ndim == 2 else a.shape[2]]
    h, w = a.shape[:2]
    rows = np.zeros((h, a[0].size + 1), np.uint8)
    rows[:, 1:] = a.reshape(h, -1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def read_png(b: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing (gray, gray and alpha, RGB, RGBA, palette); ValueError where it is none."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, head, data, palette = 8, None, [], None
    while at + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("PNG file is cut short")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if not head or not data:
        raise ValueError("PNG file is cut short")
    w, h, depth, kind, _, _, laced = head
    if depth != 8 or laced or kind not in (0, 2, 3, 4, 6):
        raise ValueError("only plain 8-bit PNG files are read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from e
    if len(raw) < h * (w * n + 1):
        raise ValueError("PNG file is cut short")
    rows = raw[: h * (w * n + 1)].reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    up = np.zeros(w * n, np.uint8)
    for y in range(h):
        up = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], up, n)
    out = out.reshape(h, w, n)
    if kind == 3:
        return palette[out[:, :, 0]]
    if kind == 0:
        return out[:, :, 0]
    return np.concatenate([np.repeat(out[:, :, :1], 3, 2), out[:, :, 1:]], 2) if kind == 4 else out


def _unfilter(kind: int, row: np.ndarray, up: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + up
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), 0, dtype=np.uint8).ravel()
    out, src, above = bytearray(len(row)), row.tolist(), up.tolist()
    for i, v in enumerate(src):
        a, c = (out[i - n], above[i - n]) if i >= n else (0, 0)
        if kind == 3:
            p = (a + above[i]) // 2
        else:
            b = above[i]
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            p = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (v + p) & 255
    return np.frombuffer(bytes(out), np.uint8)


def raw_preview(b: bytes) -> bytes:
    """The longest JPEG inside a raw file: from each start mark to the next end mark, the first of equals."""
    best, at = b"", 0
    while (start := b.find(b"\xff\xd8", at)) >= 0:
        end = b.find(b"\xff\xd9", start + 2)
        if end < 0:
            break
        if end + 2 - start > len(best):
            best = b[start : end + 2]
        at = end + 2
    if not best:
        raise ValueError("no preview in the raw file")
    return best


def exif(b: bytes) -> dict[int, object]:
    """Orientation (0x0112), DateTime (0x0132) and DateTimeOriginal (0x9003) of a JPEG or TIFF; empty where unreadable."""
    try:
        i = b.find(b"Exif\x00\x00")
        t = b[i + 6 :] if i >= 0 else b
        order = {b"II": "<", b"MM": ">"}[t[:2]]
        found: dict[int, object] = {}

        def directory(at: int, depth: int = 0) -> None:
            (n,) = struct.unpack_from(order + "H", t, at)
            for k in range(n):
                tag, kind, count, value = struct.unpack_from(order + "HHII", t, at + 2 + 12 * k)
                if tag == 0x8769 and depth == 0:
                    directory(value, 1)
                elif tag == 0x0112 and kind == 3:
                    found[tag] = struct.unpack_from(order + "H", t, at + 10 + 12 * k)[0]
                elif tag in (0x0132, 0x9003) and kind == 2:
                    where = value if count > 4 else at + 10 + 12 * k
                    found[tag] = t[where : where + count]

        directory(struct.unpack_from(order + "I", t, 4)[0])
        return found
    except (KeyError, struct.error):
        return {}


def capture_time(b: bytes) -> datetime | None:
    """When the picture was taken, read as UTC; None where that is unknown or before 1970."""
    e = exif(b)
    v = e.get(0x9003, e.get(0x0132))
    try:
        t = datetime.strptime(bytes(v).decode("ascii").strip("\x00 "), "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc)
    except (TypeError, ValueError):
        return None
    return t if t.timestamp() >= 0 else None
