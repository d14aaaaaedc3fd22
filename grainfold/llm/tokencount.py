"""Token counts by rank-synchronous merging of ragged arrays.

All pieces that are new in a batch lie one after another in one flat array of
symbols.  Each round finds the lowest-ranked pair of every piece at once, merges
all its places in all pieces at once (every other place where they overlap, from
the left), and closes the gaps; pieces without a pair are done.  A merge can make
only pairs of higher rank, so this equals merging one place at a time.

A piece of more than LONG bytes would go through as many rounds as it has ranks,
each over its whole length.  It is merged by itself, rank by rank too, but from
lists of each rank's places: a round visits its own places and adds those of the
pairs it makes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.bpe import slices
from grainfold.llm.memory import tidy
from grainfold.llm.pieces import WordMemo

#: The pattern of the byte-level pre-tokenizer (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.int32(2**31 - 1)
#: Bytes from which a piece is merged by itself.
LONG = 1024
_COUNTERS: dict[str, "Counter"] = {}


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts the tokens of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        chars = _byte_chars()
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        new = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.order, self.new = key[order], order.astype(np.int32), new
        self.pair_of, self.rank_of = key, {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memo = WordMemo(PATTERN, self._count_pieces)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the strings of added tokens count one each, as the library has it by default."""
        if not any(s in t for s in self.special for t in texts):
            return [len(x) for x in self.memo.encode(texts)]
        out = []
        for t in texts:
            parts, found = [t], 0
            for s in self.special:
                cut = [x.split(s) for x in parts]
                found += sum(len(x) - 1 for x in cut)
                parts = [y for x in cut for y in x]
            out.append(found + sum(len(x) for x in self.memo.encode([p for p in parts if p])))
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def _count_pieces(self, pieces: list[str]) -> list[bytes]:
        """One byte per token of each piece."""
        out, at = [], 0
        raw = [p.encode() for p in pieces]
        if any(len(r) > LONG for r in raw):
            short = iter(self._count_pieces([p for p, r in zip(pieces, raw) if len(r) <= LONG]))
            return [bytes(self._merge_long(r)) if len(r) > LONG else next(short) for r in raw]
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (size == 0 or size + len(raw[end]) <= 1 << 20):
                size += len(raw[end])
                end += 1
            out += [bytes(int(n)) for n in self._merge(raw[at:end])]
            at = end
        return out

    def _merge_long(self, raw: bytes) -> int:
        """Symbols that are left of one piece; places that a merge has taken away are passed over when their rank comes."""
        if not self.rank_of:
            self.rank_of = {k: r for r, k in enumerate(self.pair_of.tolist())}
        start = self.byte_ids[np.frombuffer(raw, np.uint8)]
        rank = self._rank(start[:-1], start[1:])
        by = np.argsort(rank, kind="stable")
        ranks, cuts = np.unique(rank[by], return_index=True)
        places = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(by, cuts[1:])) if r < _NONE}
        sym, n = start.tolist(), len(start)
        ahead, back, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        todo = sorted(places)
        while todo:
            r = heapq.heappop(todo)
            a, b = divmod(int(self.pair_of[r]), 1 << 20)
            new = int(self.new[r])
            for i in sorted(places.pop(r)):
                j = ahead[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue
                k = ahead[i] = ahead[j]
                sym[i], sym[j], left = new, -1, left - 1
                if k < n:
                    back[k] = i
                for p, q in ((back[i], i), (i, k)):
                    if p >= 0 and q < n and (m := self.rank_of.get(sym[p] << 20 | sym[q])) is not None:
                        if m not in places:
                            places[m] = []
                            heapq.heappush(todo, m)
                        places[m].append(p)
        return left

    def _merge(self, raw: list[bytes]) -> np.ndarray:
        counts = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), counts)
        while len(sym) > 1:
            same = owner[:-1] == owner[1:]
            rank = np.full(len(sym), _NONE, np.int32)
            rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            counts[owner[starts]] = sizes
            going = np.repeat(least < _NONE, sizes)
            if not going.any():
                break
            hit = going & (rank == np.repeat(least, sizes))
            if (hit[:-1] & hit[1:]).any():  # the same symbol again and again: every other place
                idx = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), idx, 0))
                hit &= (idx - first) % 2 == 0
            sym[hit] = self.new[rank[hit]]
            stay = going & ~np.concatenate(([False], hit[:-1]))
            sym, owner = sym[stay], owner[stay]
        if len(sym) == 1:
            counts[owner[0]] = 1
        return counts


def counter(path: str) -> Counter:
    """One counter per process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row's whole text.

    One row per input row, repeated rows and null keys included; a null or empty
    text has no bytes and no tokens.  Other columns are not read.
    """
    src = df.select(key, text)
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [x for i, j in slices(texts) for x in c.count(texts[i:j])]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return src.mapInArrow(tidy(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
