"""Benchmark decontamination: fingerprints of item-sized windows, found through Hamming blocks.

A document's window of as many words as an item is compared with that item.
SimHash sums the bits of the window's 5-word shingles, weighted by how often
each occurs, and keeps the signs of 256 sums.  The index splits fingerprints
into 16 blocks of 16 bits: two within RADIUS differ by at most RADIUS // 16 bits
in one of them, so looking up every value that near, block by block, finds every
item within the radius.  What is found is verified exactly, by the weighted
Jaccard similarity of the two multisets of shingles.  Windows that share no
shingle with any item have similarity 0, so only windows around a shared shingle
are fingerprinted.

Words are runs of letters and digits, in lower case and composed form, so that
case, punctuation and line breaks hide nothing; letters of scripts written
without spaces (Han, kana) are words of their own.  An item of fewer than five
words is too short to tell a copy from chance: it is found only in documents
that consist of it.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.llm.memory import tidy
from grainfold.llm.shingles import mix, runs
from grainfold.plans.workspace import Workspace

LEAST = 0.8
#: Bits of a fingerprint, its blocks, and the bits of difference searched. At similarity 0.8 about 39 of 256 bits differ (deviation 6).
BITS, BLOCKS, RADIUS = 256, 16, 63
#: Characters of benchmark text that one broadcast holds; more of it takes more passes over the documents, one after another.
PASS_CHARS = 8 << 20
_WORDS = BITS // 64
_SHIFT = np.arange(64, dtype=np.uint64)
#: What a block may differ by: every pattern of at most RADIUS // BLOCKS bits.
FLIPS = np.array([sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), r)], np.uint16)

_OTHER = re.compile(r"[\W_]+")
_SINGLE = re.compile("([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])")


def word_runs(text: str | None) -> np.ndarray:
    """The shingle value at each word."""
    t = text or ""
    if not t.isascii():
        t = _SINGLE.sub(r" \1 ", unicodedata.normalize("NFKC", t))
    return runs(_OTHER.sub(" ", t.lower()))


def _signs(h: np.ndarray) -> np.ndarray:
    """A row of BITS values, +1 or -1, for each shingle."""
    words = np.stack([mix(h + np.uint64(77 + k)) for k in range(_WORDS)], 1)
    return ((words[:, :, None] >> _SHIFT) & np.uint64(1)).astype(np.int32).reshape(len(h), BITS) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (a row of four 64-bit words each) of rows of BITS sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingle values."""
    v, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = np.bincount(back[: len(a)], minlength=len(v)), np.bincount(back[len(a) :], minlength=len(v))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class HammingIndex:
    """Fingerprints by the values of their blocks; ``near`` finds all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = prints.view(np.uint16)
        self.items = np.argsort(blocks, axis=0, kind="stable")
        self.starts = np.stack([np.searchsorted(np.sort(blocks[:, b]), np.arange((1 << 16) + 1)) for b in range(BLOCKS)]).astype(np.int32)

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """(query * number of items + item), each once: the pairs that are near in some block."""
        out = [np.empty(0, np.int64)]
        for b in range(BLOCKS):
            values = queries.view(np.uint16)[:, b, None] ^ FLIPS
            lo = self.starts[b][values]
            size = self.starts[b][values.astype(np.int64) + 1] - lo
            q, f = np.nonzero(size)
            n = size[q, f]
            at = np.repeat(lo[q, f] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out.append(np.repeat(q, n) * len(self.prints) + self.items[at, b])
        return np.unique(np.concatenate(out))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) indices of all pairs within RADIUS bits."""
        if not len(self.prints) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, i = np.divmod(self.candidates(queries), len(self.prints))
        ok = np.bitwise_count(queries[q] ^ self.prints[i]).sum(1) <= RADIUS
        return q[ok], i[ok]


class Matcher:
    """The items, indexed; ``match`` gives the items whose text a document holds."""

    def __init__(self, items: list[tuple[int, str | None]], least: float = LEAST):
        self.least = least
        grams = [(i, word_runs(t)) for i, t in items]
        self.items = [(i, h) for i, h in grams if len(h)]
        self.index = HammingIndex(np.concatenate([_pack(_signs(h).sum(0)[None, :]) for _, h in self.items] or [np.empty((0, _WORDS), np.uint64)]))
        size = np.array([len(h) for _, h in self.items], np.int64)
        flat = np.concatenate([h for _, h in self.items] or [np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(self.items)), size)
        by = np.argsort(flat, kind="stable")
        self.size, self.values, self.owners = size, flat[by], owner[by]
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.values >> np.uint64(44)] = True
        self.windows = self.candidates = self.verified = 0

    def match(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item_id, similarity, word at which the window starts) of every item of similarity ``least`` or more; the best window, the first of equals."""
        h = word_runs(text)
        if not len(h) or not len(self.values):
            return []
        at = np.flatnonzero(self.marks[h >> np.uint64(44)])
        lo, hi = np.searchsorted(self.values, h[at]), np.searchsorted(self.values, h[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return []
        near: dict[int, list[int]] = {}  # window size: places of shared shingles
        for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
            for m in set(self.size[self.owners[a:b]].tolist()):
                near.setdefault(min(m, len(h)), []).append(p)
        best: dict[int, tuple[float, int]] = {}
        for m, places in sorted(near.items()):
            edge = np.zeros(len(h) - m + 2, np.int64)  # windows that hold one of the places
            p = np.array(places)
            np.add.at(edge, np.maximum(p - m + 1, 0), 1)
            np.add.at(edge, np.minimum(p, len(h) - m) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            for part in np.array_split(starts, -(-len(starts) // 1024)):
                self._windows(h, m, part, best)
        return [(self.items[k][0], round(v, 6), s) for k, (v, s) in sorted(best.items())]

    def _windows(self, h: np.ndarray, m: int, starts: np.ndarray, best: dict) -> None:
        prints = []
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > m) + 1):
            a = part[0]
            sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_signs(h[a : part[-1] + m]), 0, dtype=np.int32)))
            prints.append(_pack(sums[part - a + m] - sums[part - a]))
        w, k = self.index.near(np.concatenate(prints))
        fits = self.size[k] == m if m < len(h) else self.size[k] >= m
        w, k = w[fits], k[fits]
        self.windows, self.candidates = self.windows + len(starts), self.candidates + len(k)
        for s, i in zip(starts[w].tolist(), k.tolist()):
            v = similarity(h[s : s + m], self.items[i][1])
            self.verified += v >= self.least
            if v >= self.least and (i not in best or v > best[i][0]):
                best[i] = (v, s)


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, items: list, least: float) -> Matcher:
    """One matcher per process and lot; only the last lot's is kept."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(items, least)
    return _MATCHERS[name]


def _lots(benchmark: DataFrame, most: int) -> tuple[int, Iterator[list[tuple[int, str | None]]]]:
    """How many lots of bounded size the items take, and the lots, collected one after another; one item stays whole."""
    src = benchmark.select(F.col("item_id"), F.col("text"))
    chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= most else -(-2 * chars // most)
    lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    part = lambda k: src.where(lot == k) if n > 1 else src
    return n, ([tuple(r) for r in part(k).orderBy("item_id", "text").collect()] for k in range(n))


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, most: int = PASS_CHARS) -> DataFrame:
    """doc_id, item_id, similarity, start: a row per document and item whose text the document holds.

    Items and documents without a word match nothing; a null doc_id or item_id
    is carried; repeated rows give repeated results; equal items all match; of
    equally similar windows the first one counts.  A document shorter than an
    item is compared as a whole.  An empty table gives no rows.  Only ids and
    texts are read.
    """
    src = docs.select("doc_id", "text")
    kinds = [src.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start long"
    n, lots = _lots(benchmark, most)
    ws, out = Workspace(docs.sparkSession, "decontam"), None
    for k, items in enumerate(lots):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, shared.value, least)
            for b in batches:
                rows, ids = [], b.column(0).to_pylist()
                for d, t in zip(ids, b.column(1).to_pylist()):
                    rows += [(d, *x) for x in m.match(t)]
                cols = list(zip(*rows)) or [[], [], [], []]
                kind = [b.schema.field(0).type, None, pa.float64(), pa.int64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kind)], names=["doc_id", "item_id", "similarity", "start"])

        got = src.mapInArrow(tidy(run), schema)
        if n > 1:  # written, so that one lot at a time is broadcast
            got = ws.write(got, f"lot-{k}")
            shared.destroy()
        out = got if out is None else out.unionAll(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, most: int = PASS_CHARS) -> DataFrame:
    """The documents that hold no item (as ``find`` has it); all columns and rows else, no shuffle."""
    n, lots = _lots(benchmark, most)
    ws = Workspace(docs.sparkSession, "decontam")
    for k, items in enumerate(lots):
        shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            m = _matcher(name, shared.value, least)
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not m.match(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), T.StructType(docs.schema.fields))
        if n > 1:
            docs = ws.write(docs, f"lot-{k}")
            shared.destroy()
    return docs
