"""Baseline JPEG files as numpy arrays: a decoder and an encoder.

The decoder reads sequential Huffman files of 8-bit samples (gray, YCbCr or RGB
by the Adobe mark, any whole subsampling, restart intervals); it walks the code
bits in Python and does everything else on whole arrays.  The encoder writes
files without subsampling, with Huffman codes made for the picture.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Quantisation steps of luma and chroma at quality 50, row by row (fixed values of the standard, annex K).
LUMA_STEPS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_STEPS = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]
#: Natural place of the k-th coefficient: diagonals, odd ones downwards.
ZIGZAG = np.array([8 * y + x for d in range(15) for y, x in sorted(((y, d - y) for y in range(8) if 0 <= d - y < 8), reverse=d % 2 == 0)])
_COS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _ycc_to_rgb(a: np.ndarray) -> np.ndarray:
    y, cb, cr = (a[:, :, k] for k in range(3))
    return np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], 2)


def _rgb_to_ycc(a: np.ndarray) -> np.ndarray:
    r, g, b = (a[:, :, k].astype(np.float64) for k in range(3))
    return np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], 2)


# ---- decoding ------------------------------------------------------------------------------------


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits ahead: code length << 8 | symbol, or 0 where no code begins so."""
    table, code, k = [0] * (1 << 16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            if lo + (1 << (16 - length)) > 1 << 16 or k >= len(symbols):
                raise ValueError("JPEG Huffman table is broken")
            table[lo : lo + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return table


class _Bits:
    """The code bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        """At least 32 bits ahead; ones follow the end, a little."""
        part = self.data[self.at : self.at + 8]
        self.at += 8
        if self.at > len(self.data) + 64:
            raise ValueError("JPEG data is cut short")
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(part.ljust(8, b"\xff"), "big")
        self.n += 64


def _block(bits: _Bits, dc: list[int], ac: list[int], out: list[int], base: int, last: int) -> int:
    """One block's coefficients into ``out`` from ``base`` on, in zigzag order; returns its DC value."""
    if bits.n < 32:
        bits.fill()
    x = dc[bits.held >> (bits.n - 16) & 0xFFFF]
    size = x & 255
    if not x or size > 15:
        raise ValueError("JPEG data is broken")
    bits.n -= (x >> 8) + size
    v = bits.held >> bits.n & ((1 << size) - 1)
    last += v if size == 0 or v >> (size - 1) else v - (1 << size) + 1
    out[base] = last
    k, held, n = 1, bits.held, bits.n
    while k < 64:
        if n < 32:
            bits.n = n
            bits.fill()
            held, n = bits.held, bits.n
        x = ac[held >> (n - 16) & 0xFFFF]
        size = x & 15
        n -= x >> 8
        if size:
            k += x >> 4 & 15
            n -= size
            v = held >> n & ((1 << size) - 1)
            if k > 63:
                raise ValueError("JPEG data is broken")
            out[base + k] = v if v >> (size - 1) else v - (1 << size) + 1
            k += 1
        elif x & 255 == 0xF0:
            k += 16
        elif x:
            break
        else:
            raise ValueError("JPEG data is broken")
    bits.n = n
    return last


def _segments(b: bytes):
    """(mark, body, place after it) of each segment up to the scan."""
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("JPEG marks are broken")
        if b[at + 1] == 0xFF:
            at += 1
            continue
        mark, size = b[at + 1], struct.unpack_from(">H", b, at + 2)[0]
        if size < 2 or at + 2 + size > len(b):
            raise ValueError("JPEG file is cut short")
        yield mark, b[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size
    raise ValueError("JPEG file is cut short")


def _intervals(data: bytes) -> list[bytes]:
    """The scan's code bytes by restart interval, stuffed zeros taken out, up to the next other mark."""
    out, at, start = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        nxt = data[at + 1]
        if 0xD0 <= nxt <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        elif nxt not in (0, 0xFF):
            out.append(data[start:at])
            break
        at += 1 if nxt == 0xFF else 2
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def read_jpeg(b: bytes) -> np.ndarray:
    """The samples of a baseline JPEG: (h, w) gray or (h, w, 3); ValueError where it is none, cut short, or of another kind."""
    try:
        return _read(b)
    except (IndexError, struct.error) as e:
        raise ValueError("JPEG file is broken") from e


def _read(b: bytes) -> np.ndarray:
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    steps, tables, frame, every, adobe = {}, {}, None, 0, None
    for mark, body, end in _segments(b):
        if mark == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                n = 128 if wide else 64
                q = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8)
                if len(q) < 64:
                    raise ValueError("JPEG file is cut short")
                steps[body[at] & 15] = q.astype(np.float64)
                at += 1 + n
        elif mark == 0xC4:
            at = 0
            while at < len(body):
                counts = body[at + 1 : at + 17]
                n = sum(counts)
                tables[body[at]] = _lookup(counts, body[at + 17 : at + 17 + n])
                at += 17 + n
        elif mark in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not h or not w:
                raise ValueError("only 8-bit gray and colour JPEG files are read")
            frame = h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG files are read")
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            break
    if not frame:
        raise ValueError("JPEG file has no frame")
    h, w, parts = frame
    used = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if any(p[0] not in used or p[3] not in steps or used[p[0]] >> 4 not in tables or (used[p[0]] & 15) + 16 not in tables or not (1 <= p[1] <= 4 and 1 <= p[2] <= 4) for p in parts):
        raise ValueError("JPEG file lacks a table or a component's scan")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    hs, vs = max(p[1] for p in parts), max(p[2] for p in parts)
    if any(hs % p[1] or vs % p[2] for p in parts):
        raise ValueError("this subsampling is not read")
    mw, mh = -(-w // (8 * hs)), -(-h // (8 * vs))
    coded = [[0] * (mw * mh * p[1] * p[2] * 64) for p in parts]
    plan = [(c, p[1] * p[2], tables[used[p[0]] >> 4], tables[(used[p[0]] & 15) + 16]) for c, p in enumerate(parts)]
    todo, done, intervals = mw * mh, 0, iter(_intervals(b[end:]))
    while done < todo:
        data = next(intervals, None)
        if data is None:
            raise ValueError("JPEG data is cut short")
        bits, last = _Bits(data), [0] * len(parts)
        for unit in range(done, min(done + (every or todo), todo)):
            for c, n, dc, ac in plan:
                for k in range(n):
                    last[c] = _block(bits, dc, ac, coded[c], (unit * n + k) * 64, last[c])
        done = min(done + (every or todo), todo)
    planes = []
    for c, (_, hk, vk, q) in enumerate(parts):
        z = np.zeros((mw * mh * hk * vk, 64))
        z[:, ZIGZAG] = np.array(coded[c], np.float64).reshape(-1, 64) * steps[q]
        x = _COS.T @ z.reshape(-1, 8, 8) @ _COS + 128
        x = x.reshape(mh, mw, vk, hk, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(mh * vk * 8, mw * hk * 8)
        x = np.clip(np.round(x), 0, 255)
        planes.append(x.repeat(vs // vk, 0).repeat(hs // hk, 1)[:h, :w])
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    a = np.stack(planes, 2)
    return a.astype(np.uint8) if adobe == 0 else np.clip(np.round(_ycc_to_rgb(a)), 0, 255).astype(np.uint8)


# ---- encoding ------------------------------------------------------------------------------------


def _codes(freq: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Counts by length, symbols, and code and length of each symbol, for the frequencies of 256 symbols; no code is all ones or longer than 16."""
    heap = [(int(n), s, (s,)) for s, n in enumerate(freq) if n] + [(0, 256, (256,))]  # a stand-in takes the code of all ones
    depth = dict.fromkeys((s for _, _, m in heap for s in m), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, i, a), (m, j, c) = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a, *c):
            depth[s] += 1
        heapq.heappush(heap, (n + m, max(i, j), a + c))
    depth = {s: max(d, 1) for s, d in depth.items()}
    lengths = [0] * 300
    for d in depth.values():
        lengths[d] += 1
    for d in range(len(lengths) - 1, 16, -1):  # pairs of too long codes move under a shorter one
        while lengths[d]:
            up = next(k for k in range(d - 2, 0, -1) if lengths[k])
            for at, more in ((d, -2), (d - 1, 1), (up, -1), (up + 1, 2)):  # one after another: up + 1 may be d - 1
                lengths[at] += more
    order = sorted((s for s in depth if s < 256), key=lambda s: (depth[s], s))
    longest = max(d for d in range(17) if lengths[d])
    lengths[longest] -= 1  # the stand-in
    code, k = 0, 0
    value, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length in range(1, 17):
        for _ in range(lengths[length]):
            value[order[k]], size[order[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return bytes(lengths[1:17]), bytes(order), value, size


def _tokens(z: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, place, is DC, symbol, extra bits, number of them) of the coefficients (blocks x 64, zigzag order) of one component, in file order."""
    n = len(z)
    dc = np.diff(z[:, 0], prepend=0)
    blk, col = np.nonzero(z[:, 1:])
    col = col + 1
    val = z[blk, col]
    before = np.where(np.concatenate(([True], blk[1:] != blk[:-1])), 0, np.concatenate(([0], col[:-1]))) if len(blk) else np.empty(0, np.int64)
    gap = col - before - 1
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    bits = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    s_dc, s_ac = size(dc), size(val)
    zrl = gap // 16
    rep = np.repeat(np.arange(len(blk)), zrl)
    turn = np.arange(len(rep)) - np.repeat(np.cumsum(zrl) - zrl, zrl)
    last = np.zeros(n, np.int64)
    if len(blk):
        np.maximum.at(last, blk, col)
    eob = np.flatnonzero(last < 63)
    block = np.concatenate((np.arange(n), blk, blk[rep], eob))
    place = np.concatenate((np.zeros(n, np.int64), col * 32 + 31, before[rep] * 32 + 32 + turn, np.full(len(eob), 64 * 32)))
    sym = np.concatenate((s_dc, gap % 16 << 4 | s_ac, np.full(len(rep), 0xF0), np.zeros(len(eob), np.int64)))
    none = np.zeros(len(rep) + len(eob), np.int64)
    extra, count = np.concatenate((bits(dc, s_dc), bits(val, s_ac), none)), np.concatenate((s_dc, s_ac, none))
    by = np.lexsort((place, block))
    return block[by], (place == 0)[by], sym[by], extra[by], count[by]


def _packed(value: np.ndarray, size: np.ndarray) -> bytes:
    """Numbers of given bit sizes one after another, filled up with ones, 0xFF stuffed."""
    out, rest = [], np.empty(0, np.uint8)
    for at in range(0, len(value), 1 << 18):  # in parts, as every bit is a byte for a while
        v, s = value[at : at + (1 << 18)], size[at : at + (1 << 18)]
        ends = np.cumsum(s)
        left = np.repeat(ends, s) - np.arange(ends[-1] if len(ends) else 0) - 1
        rest = np.concatenate((rest, (np.repeat(v, s) >> left & 1).astype(np.uint8)))
        whole = len(rest) // 8 * 8
        out.append(np.packbits(rest[:whole]).tobytes())
        rest = rest[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate((rest, np.ones(8 - len(rest), np.uint8)))).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def scaled_steps(base: list[int], quality: int) -> np.ndarray:
    """Quantisation steps for a quality of 1 to 100, in natural order."""
    q = min(max(quality, 1), 100)
    k = 5000 / q if q < 50 else 200 - 2 * q
    return np.clip(np.floor((np.array(base) * k + 50) / 100), 1, 255)


def jpeg(a: np.ndarray, quality: int = 85) -> bytes:
    """An 8-bit gray or colour picture (alpha is dropped) as a baseline JPEG file without subsampling."""
    h, w = a.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError("JPEG cannot hold this size")
    full = _rgb_to_ycc(a[:, :, :3]) if a.ndim == 3 else a[:, :, None].astype(np.float64)
    full = np.pad(full, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge") - 128
    n, coloured = full.shape[2], full.shape[2] == 3
    steps = [scaled_steps(LUMA_STEPS, quality), scaled_steps(CHROMA_STEPS, quality)]
    streams = []
    for c in range(n):
        blocks = full[:, :, c].reshape(full.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        q = np.round((_COS @ blocks @ _COS.T).reshape(-1, 64) / steps[c > 0])
        streams.append(_tokens(q[:, ZIGZAG].astype(np.int64)))
    chunk = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8", chunk(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [chunk(0xDB, bytes([k]) + s[ZIGZAG].astype(np.uint8).tobytes()) for k, s in enumerate(steps[: 1 + coloured])]
    out.append(chunk(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, c > 0]) for c in range(n))))
    value, size = ([None] * n for _ in range(2))
    for k, own in enumerate(([0], [1, 2]) if coloured else ([0],)):
        for kind in (0, 1):  # DC, AC
            freq = sum(np.bincount(streams[c][2][streams[c][1] == (kind == 0)], minlength=256) for c in own)
            counts, symbols, code, length = _codes(freq)
            out.append(chunk(0xC4, bytes([kind << 4 | k]) + counts + symbols))
            for c in own:
                _, is_dc, sym, extra, bits = streams[c]
                v, s = code[sym] << bits | extra, length[sym] + bits
                value[c] = v if value[c] is None else np.where(is_dc == (kind == 0), v, value[c])
                size[c] = s if size[c] is None else np.where(is_dc == (kind == 0), s, size[c])
    out.append(chunk(0xDA, bytes([n]) + b"".join(bytes([c + 1, (c > 0) * 0x11]) for c in range(n)) + b"\0\x3f\0"))
    block = np.concatenate([s[0] * n + c for c, s in enumerate(streams)])
    by = np.argsort(block, kind="stable")
    out.append(_packed(np.concatenate(value)[by], np.concatenate(size)[by]))
    return b"".join([*out, b"\xff\xd9"])
