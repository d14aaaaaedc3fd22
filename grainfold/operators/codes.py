"""Codes near each other: parts of both sides meet in tasks of a bounded size, without a row for each offer or candidate.

Codes of texts are far from evenly spread, so no key of an equi-join parts them,
and pairs may be a thousandth of all.  Both sides are packed into parts of a
bounded number of codes, every two parts meet in one task, and what leaves a task
is either its pairs, in batches, or the few of them that connect what they all
connect.  Nothing is copied for the meeting: tasks read the parts they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.plans.workspace import Workspace

#: Codes in a part of the left side at most, and in one of the right; pairs of parts that are wanted, if the longer side's would hold LEAST codes.
LEFT, RIGHT, WANTED, LEAST = 1 << 18, 1 << 18, 24, 1 << 11
#: Blocks that a code is cut into, pairs up to which parts are compared as they are, and pairs that are looked at or sent together.
CUTS, SMALL, STEP = 5, 1 << 24, 1 << 18

_PART = "part long, ids binary, codes binary"


def _parts(df: DataFrame, n: int, ws: Workspace, name: str) -> DataFrame:
    """``df`` (id, code) as ``n`` rows of packed ids and codes, one in each partition."""

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f["part"].iloc[:1], "ids": [f["id"].to_numpy(np.int64).tobytes()], "codes": [f["code"].to_numpy(np.int64).tobytes()]})

    packed = df.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(n))).groupBy("part").applyInPandas(pack, _PART)
    return ws.write(packed, name).repartitionById(n, F.col("part").cast("int"))


def _cut(n: int, m: int) -> tuple[int, int]:
    """Parts of the two sides, of n and m rows: such that the rows of the parts that meet, which bound the pairs that connect them, are few."""
    wanted = max(1, min(WANTED, -(-max(n, m) // LEAST)))
    least = max(1, -(-n // LEFT))
    cuts = [(k, max(1, -(-m // RIGHT), -(-wanted // k))) for k in range(least, max(least, wanted) + 1)]
    return min(cuts, key=lambda c: (c[0] * m + c[1] * n, c))


@cache
def _flips(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)], np.int64)


class Joined:
    """Labels of nodes by what the edges so far connect."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Takes in edges; the places of those that connected something."""
        kept, at = [], np.arange(len(a))
        while True:
            x, y = self.of[a[at]], self.of[b[at]]
            at, x, y = at[x != y], x[x != y], y[x != y]
            if not len(at):
                return np.concatenate(kept) if kept else at
            high, first = np.unique(np.maximum(x, y), return_index=True)  # each hangs under a lower one: no circle
            kept.append(at[first])
            up = np.arange(len(self.of))
            up[high] = np.minimum(x, y)[first]
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]


def _meetings(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Places in x and in y to compare, and the blocks (place, width) in which nearer pairs were met before.

    Codes within ``threshold`` differ in one of CUTS blocks by at most threshold // CUTS bits.
    """
    if len(x) * len(y) <= SMALL:
        yield np.arange(len(x)), np.arange(len(y)), []
        return
    ends = [64 * k // CUTS for k in range(CUTS + 1)]
    before = []
    for at, end in zip(ends, ends[1:]):
        width = end - at
        flips = _flips(width, threshold // CUTS)
        p, q = (((c >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for c in (x, y))
        px, qx = np.argsort(p, kind="stable"), np.argsort(q, kind="stable")
        ps, qs = (np.searchsorted(v, np.arange((1 << width) + 1)) for v in (p[px], q[qx]))
        for v in np.flatnonzero(np.diff(ps)):
            s = qs[v ^ flips]
            n = qs[(v ^ flips) + 1] - s
            yield px[ps[v] : ps[v + 1]], qx[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())], before
        before = [*before, (at, width)]


def _near(x: np.ndarray, y: np.ndarray, threshold: int, of: Joined | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of near pairs, each once; with ``of`` only of such as are not connected yet, as far as it is known."""
    for i, j, before in _meetings(x, y, threshold):
        sides = [(i, j)]
        if of is not None and len(i) * len(j) > STEP:  # what hangs together already needs no look at each other
            li, lj = of.of[i], of.of[len(x) + j]
            most = np.bincount(lj).argmax()
            sides = [(i[li == most], j[lj != most]), (i[li != most], j)]
        for i, j in sides:
            for k in range(0, len(j), STEP):
                jj = j[k : k + STEP]
                yy, rows = y[jj], max(1, STEP // len(jj))
                for m in range(0, len(i), rows):
                    ii = i[m : m + rows]
                    r, c = np.divmod(np.flatnonzero(np.bitwise_count(x[ii][:, None] ^ yy) <= threshold), len(jj))
                    a, b = ii[r], jj[c]
                    if len(a) and before:
                        d = x[a] ^ y[b]
                        new = np.ones(len(a), bool)
                        for at, width in before:
                            new &= np.bitwise_count((d >> np.uint64(at)) & np.uint64((1 << width) - 1)) > threshold // CUTS
                        a, b = a[new], b[new]
                    if len(a):
                        yield a, b


def near(left: DataFrame, right: DataFrame, threshold: int, joined: bool = False) -> DataFrame:
    """(a, b): ids of rows of ``left`` and ``right``, both (id, code) of longs in this order, whose codes differ in at most ``threshold`` bits; a row with a null has none.

    With ``joined``, which takes distinct ids a side, only pairs of these that connect all that they connect, seen
    as a graph between the two sides: at most the rows of a part for each part of the other side.
    """
    ws = Workspace(left.sparkSession, "codes")
    sides = [d.toDF("id", "code").select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).dropna() for d in (left, right)]
    sides = [ws.write(d, name) for d, name in zip(sides, ("left", "right"))]
    parts = _cut(*(d.count() for d in sides))
    x, y = (_parts(d, k, ws, f"{name}-parts") for d, k, name in zip(sides, parts, ("left", "right")))
    both = x.select(F.col("ids").alias("a"), F.col("codes").alias("x")).hint("shuffle_replicate_nl").crossJoin(y.select(F.col("ids").alias("b"), F.col("codes").alias("y")))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, x, b, y in f.itertuples(index=False):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                of, held, size = Joined(len(x) + len(y)) if joined else None, [], 0
                for i, j in _near(x, y, threshold, of):
                    held.append((i, j))
                    size += len(i)
                    if size > STEP:
                        yield from sent(a, b, held, len(x), of)
                        held, size = [], 0
                yield from sent(a, b, held, len(x), of)

    def sent(a: np.ndarray, b: np.ndarray, held: list, n: int, of: Joined | None) -> Iterator[pd.DataFrame]:
        if held:
            i, j = (np.concatenate(v) for v in zip(*held))
            if of is not None:
                k = of.add(i, n + j)
                i, j = i[k], j[k]
            for k in range(0, len(i), STEP):
                yield pd.DataFrame({"a": a[i[k : k + STEP]], "b": b[j[k : k + STEP]]})

    return both.mapInPandas(meet, "a long, b long")
