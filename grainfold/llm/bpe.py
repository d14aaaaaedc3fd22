"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each piece (a match of the pattern) starts as its bytes.  Leaf i of the tree
holds the rank of the pair that starts at byte position i, together with i, so
the root is the leftmost pair of the least rank.  A merge changes the leaf of
the merged pair, of its live left neighbour and of the right part that died:
three point updates, each logarithmic.  Short pieces are merged many at a time,
one tree per row of a numpy matrix; long pieces use the same tree in plain lists.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grainfold.llm.memory import tidy
from grainfold.llm.pieces import WordMemo

_FAR = np.int64(1) << 62
_WIDE = 128  #: pieces above this many bytes are merged one by one
_CODEC: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Encodes and decodes by a rank file (base64 token, rank per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get = self.ranks.get
        pairs = {}
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None:
                    pairs[a << 20 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.vals = np.array([pairs[int(k)] for k in self.keys], np.int64)
        self.memo = WordMemo(pattern, self._encode_pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.memo.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes | None] = [None] * len(raw)
        sizes: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if (r := self.ranks.get(b)) is not None:  # a piece that is a token is never merged
                out[i] = r.to_bytes(4, "little")
            elif len(b) > _WIDE:
                out[i] = np.array(self._merge_long(b), "<u4").tobytes()
            else:
                sizes.setdefault(1 << (len(b) - 1).bit_length(), []).append(i)
        for width, rows in sizes.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.vals[at], -1)

    def _merge_rows(self, raw: list[bytes], width: int) -> list[bytes]:
        n, w = len(raw), width
        shift, low = max(1, (w - 1).bit_length()), np.int64(w - 1)
        lens = np.fromiter(map(len, raw), np.int64, n)
        sym = np.zeros((n, w), np.int64)
        live = np.arange(w)[None, :] < lens[:, None]
        sym[live] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.minimum(np.arange(1, w + 1)[None, :], lens[:, None])
        prv = np.tile(np.arange(-1, w - 1), (n, 1))
        tree = np.full((n, 2 * w), _FAR, np.int64)
        r, c = np.nonzero(np.arange(w)[None, :] < lens[:, None] - 1)
        k = self._rank(sym[r, c], sym[r, c + 1])
        tree[r, w + c] = np.where(k >= 0, k << shift | c, _FAR)
        for lo in (1 << d for d in range(w.bit_length() - 2, -1, -1)):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        rows = np.flatnonzero(tree[:, 1] < _FAR)
        while len(rows):
            root = tree[rows, 1]
            pos, rank = root & low, root >> shift
            dead = nxt[rows, pos]
            after, before = nxt[rows, dead], prv[rows, pos]
            sym[rows, pos], nxt[rows, pos], live[rows, dead] = rank, after, False
            inside = after < lens[rows]
            ri, ai = rows[inside], after[inside]
            prv[ri, ai] = pos[inside]
            here = np.full(len(rows), _FAR, np.int64)
            k = self._rank(rank[inside], sym[ri, ai])
            here[inside] = np.where(k >= 0, k << shift | pos[inside], _FAR)
            self._put(tree, rows, w + pos, here)
            self._put(tree, rows, w + dead, _FAR)
            left = before >= 0
            rl, bl = rows[left], before[left]
            k = self._rank(sym[rl, bl], rank[left])
            self._put(tree, rl, w + bl, np.where(k >= 0, k << shift | bl, _FAR))
            rows = rows[tree[rows, 1] < _FAR]
        flat, ends = sym[live].astype("<u4").tobytes(), np.cumsum(live.sum(1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value) -> None:
        """Point update of one leaf in each row."""
        tree[rows, leaf] = value
        leaf = leaf >> 1
        while len(leaf) and leaf[0]:  # all leaves lie at one depth
            tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])
            leaf = leaf >> 1

    def _merge_long(self, b: bytes) -> list[int]:
        n, get = len(b), self.pairs.get
        w = 1 << (n - 1).bit_length()
        far = (1 << 62, 0)
        sym = self.byte_ids[np.frombuffer(b, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [far] * (2 * w)
        for i in range(n - 1):
            if (k := get(sym[i] << 20 | sym[i + 1])) is not None:
                tree[w + i] = (k, i)
        for i in range(w - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            i += w
            tree[i] = value
            i >>= 1
            while i:
                best = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == best:
                    break
                tree[i] = best
                i >>= 1

        def pair(i: int) -> tuple[int, int]:
            k = get(sym[i] << 20 | sym[nxt[i]]) if nxt[i] < n else None
            return far if k is None else (k, i)

        while tree[1] < far:
            rank, pos = tree[1]
            dead = nxt[pos]
            sym[pos], nxt[pos], sym[dead] = rank, nxt[dead], -1
            if nxt[pos] < n:
                prv[nxt[pos]] = pos
            put(dead, far)
            put(pos, pair(pos))
            if prv[pos] >= 0:
                put(prv[pos], pair(prv[pos]))
        return [s for s in sym if s >= 0]


def codec(path: str, pattern: str) -> Codec:
    """One codec per process and file."""
    if (path, pattern) not in _CODEC:
        _CODEC[path, pattern] = Codec(path, pattern)
    return _CODEC[path, pattern]


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, so that memory is bounded whatever a batch holds."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode_frame(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "bpe_ids") -> DataFrame:
    """Adds ``ids``: array of token ids of the whole text (null text: empty array).

    One row per input row, repeated rows included; a column of ``df`` with the
    name ``ids`` gives way to the new one.  An empty table gives no rows.
    """
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            for i, j in slices(texts):
                got = c.encode(texts[i:j])
                ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                col = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(got), "<i4")))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, col], names=[*b.schema.names, ids])

    return df.mapInArrow(tidy(run), schema)


def digest_frame(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns key, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, repeated rows and null keys included.  A null or empty
    text has 0 tokens and the digest of no bytes.  Special strings in a text are
    ordinary text.  Only ``key`` and ``text`` are read, so clashing names of other
    columns do no harm; ``keep`` names columns that pass through.
    """
    keep = keep or []
    src = df.select(key, text, *keep)
    fields = [src.schema[key], *(src.schema[k] for k in keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern), hashlib.sha256
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, enc, dec = [], [], []
            for i, j in slices(texts):
                for x in c.encode(texts[i:j]):
                    n.append(len(x) // 4)
                    enc.append(sha(x).hexdigest())
                    dec.append(sha(c.decode(x)).hexdigest())
            cols = [b.column(0), *(b.column(2 + k) for k in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())], names=[key, *keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(tidy(run), schema)
