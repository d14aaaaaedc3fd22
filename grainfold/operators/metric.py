"""All pairs of vectors within a distance: cells around pivots, tiles of bounded size, and bounds on who can be whose partner.

Pivots from a bounded sample cut the rows into cells, each row to the pivot it
is nearest to; cells are dealt into tiles of about BLOCK rows or fewer, packed.
Every two tiles meet in some task, which reads the bundles of tiles it needs: no row is
copied for it.  Of the second tile only rows are compared that can have a partner
in the first's cell: not those further than the distance beyond the plane
between its pivot and any other, nor those whose angle to the pivot exceeds the
cell's widest one by more than the distance's angle (the triangle inequality on
the sphere).  How much is spared depends on the data: of unrelated vectors of
many dimensions and a wide distance nothing can be spared, and the tiles are then
compared in all pairs, evenly dealt.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.formulas import cosine
from grainfold.plans.workspace import Workspace

#: Rows that a cell should hold, pivots of one cut at least and at most, rows of a block's side.
CELL, LEAST_PIVOTS, MOST_PIVOTS, BLOCK = 1024, 8, 128, 2048
#: Room for rounding in the bounds, which only adds candidates.
SLACK = 1e-6
#: Bytes of candidate pairs that are looked at together, and rows that are sent together.
CHUNK, SENT = 1 << 24, 1 << 18
#: Bundles of tiles a side that are wanted, and bytes of vectors in one about: the square of their number is the number of tasks.
SIDES, BUNDLE = 24, 1 << 23

_PAIRS = "a long, b long, similarity double"
_TILE = ["cell", "part", "a", "n", "x", "d"]
_BUNDLE = "k int, cell array<string>, part array<int>, a binary, n binary, x binary, d array<int>, size array<int>"


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _in_reach(dots: np.ndarray, pivots: np.ndarray, least: float, wide: np.ndarray, j: int) -> np.ndarray:
    """Whether cell j may hold a partner of a row, from the rows' dot products with the pivots."""
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots[j], 0))
    far = np.sqrt(2 - 2 * least) + SLACK
    ok = np.arccos(np.clip(dots[:, j], -1, 1)) <= wide[j] + np.arccos(least) + SLACK
    return ok & ((dots - far * apart).max(1) - dots[:, j] <= SLACK)


def _sample(x: DataFrame, big: dict[str, int]) -> dict[str, np.ndarray]:
    """Pivots of each cell of ``big`` (cell to rows): about one a CELL rows, by a hash of the row's id, without copies."""
    if not big:
        return {}
    want = {c: min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-n // CELL))) for c, n in big.items()}
    share = F.create_map(*[v for c, n in big.items() for v in (F.lit(c), F.lit(min(1.0, 4.0 * want[c] / n)))])
    drawn = x.where(F.pmod(F.xxhash64(F.lit("pivot"), "a"), F.lit(1 << 40)) < F.element_at(share, F.col("cell")) * float(1 << 40))
    out: dict[str, list] = {c: [] for c in big}
    for r in drawn.dropDuplicates(["cell", "x"]).orderBy("cell", F.xxhash64(F.lit("pivot"), "a"), "a").select("cell", "x").toLocalIterator():
        if len(out[r["cell"]]) < want[r["cell"]]:
            out[r["cell"]].append(r["x"])
    return {c: _unit(np.array(v, np.float64)) for c, v in out.items() if len(v) > 1}


def _cells(x: DataFrame, pivots: dict[str, np.ndarray], least: dict[str, float], ws: Workspace) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """``x`` with its cells cut around ``pivots`` (``cell`` becomes ``cell/k``), written, and each new cell's widest angle by its parent and k."""
    known = x.sparkSession.sparkContext.broadcast(pivots)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, g in f.groupby("cell", sort=False):
                p = known.value.get(cell)
                if p is None:
                    yield g.assign(angle=0.0)
                    continue
                dots = _unit(_matrix(g["x"])) @ p.T
                k = dots.argmax(1)
                at = np.arccos(np.clip(dots[np.arange(len(k)), k], -1, 1))
                yield g.assign(cell=[f"{cell}/{j}" for j in k], angle=at)

    dealt = ws.write(x.mapInPandas(deal, "a long, x array<double>, n long, cell string, angle double"), "cells")
    wide = {c: np.full(len(p), -np.inf) for c, p in pivots.items()}  # a cell without rows needs no partners
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("w")).toLocalIterator():  # a row a cell: at most MOST_PIVOTS for each length
        parent, _, k = r["cell"].rpartition("/")
        if parent in wide:
            wide[parent][int(k)] = r["w"]
    return dealt.drop("angle"), wide


class Cells:
    """Rows in tiles of about BLOCK or fewer, by cell, and which rows of a cell may have partners in another."""

    def __init__(self, df: DataFrame, least: float, id: str, vector: str, weight: str | None = None):
        if not 0 < least <= 1:
            raise ValueError("least must be above 0 and at most 1")
        self.ws, self.least = Workspace(df.sparkSession, "metric"), least
        n = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
        e = df.select(F.col(id).cast("long").alias("a"), F.col(vector).cast("array<double>").alias("x"), n.alias("n"))
        bad = F.exists("x", lambda v: v.isNull() | F.isnan(v))
        e = e.where(F.col("a").isNotNull() & (F.size("x") > 0) & ~bad & F.exists("x", lambda v: v != 0))
        x = self.ws.write(e.withColumn("cell", F.size("x").cast("string")), "rows")
        norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
        sizes = x.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).collect()  # a row a length
        # the dot product of vectors no longer than m reaches ``least`` only if their cosine reaches least / m
        self.cos = {r["cell"]: min(least / max(r["m"], 1e-300), 1.0) for r in sizes}
        self.bytes = sum(8 * r["n"] * int(r["cell"]) for r in sizes)
        self.pivots = _sample(x, {r["cell"]: r["n"] for r in sizes if r["n"] > 1})
        x, self.wide = _cells(x, self.pivots, self.cos, self.ws)
        self.ws.drop("rows")
        # parts are dealt by hash to two thirds of BLOCK, so that few exceed it
        parts = F.ceil(F.count(F.lit(1)) * 3 / (2 * BLOCK)).cast("int")
        few = self.ws.write(x.groupBy("cell").agg(parts.alias("parts")), "parts")  # a row a cell
        self.rows = x.join(F.broadcast(few), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit("block"), "a"), F.col("parts")).cast("int")).drop("parts")
        self.parts = few

    def reach(self) -> Callable[[str, str, np.ndarray], np.ndarray]:
        """A function of (cell, own, vectors): which of the vectors, of cell ``own``, may have partners in ``cell``; it may run in tasks."""
        pivots, wide, cos = self.pivots, self.wide, self.cos

        def may(cell: str, own: str, y: np.ndarray) -> np.ndarray:
            if cell == own:
                return np.ones(len(y), bool)
            (top, _, j), (other, _, k) = cell.rpartition("/"), own.rpartition("/")
            if top != other or top not in pivots:  # other lengths
                return np.zeros(len(y), bool)
            return _in_reach(_unit(y) @ pivots[top].T, pivots[top], cos[top], wide[top], int(j))

        return may

    def tiles(self) -> tuple[DataFrame, DataFrame]:
        """Both sides of the comparison: bundles of packed tiles of about BUNDLE bytes or less, one in each partition, written once."""

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            m = _matrix(f["x"])
            return pd.DataFrame({"cell": f["cell"].iloc[:1], "part": f["part"].iloc[:1], "a": [f["a"].to_numpy(np.int64).tobytes()], "n": [f["n"].to_numpy(np.int64).tobytes()], "x": [m.tobytes()], "d": m.shape[1]})

        def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = pd.concat([*frames, pd.DataFrame(columns=_TILE)])
            if len(f):
                yield pd.DataFrame({"k": [TaskContext.get().partitionId()], **{c: [b"".join(f[c]) if c in "anx" else f[c].tolist()] for c in _TILE}, "size": [[len(v) // 8 for v in f["a"]]]})

        n = self.parts.agg(F.sum("parts")).first()[0] or 1
        many = max(min(SIDES, n), -(-self.bytes // BUNDLE))
        t = self.rows.groupBy("cell", "part").applyInPandas(pack, "cell string, part int, a binary, n binary, x binary, d int")
        t = self.ws.write(t.repartition(many).mapInPandas(bundle, _BUNDLE), "tiles").repartitionById(many, F.col("k"))
        return tuple(t.select(*[F.col(c).alias(f"{c}{k}") for c in t.columns]) for k in (1, 2))

    def compare(self, each: Callable, schema: str, last: Callable | None = None) -> DataFrame:
        """Rows of ``schema`` from ``each(ids, weights, vectors, ids, weights, vectors, same)`` of every two tiles that may hold partners, rows out of reach left out.

        Two bundles meet as one row, and their tiles are taken apart by the task,
        so that what is sent to Python grows with bundles, not with pairs of tiles.
        """
        t, u = self.tiles()
        both = t.hint("shuffle_replicate_nl").join(u, F.col("k1") <= F.col("k2"))
        may = self.reach()

        def opened(r: tuple, k: int) -> list[tuple]:
            """(cell, part, length, ids, weights, vectors) of each tile of a bundle, without copies."""
            a, n, x = (np.frombuffer(getattr(r, f"{c}{k}"), t) for c, t in (("a", np.int64), ("n", np.int64), ("x", np.float64)))
            size, d = (np.asarray(getattr(r, f"{c}{k}"), np.int64) for c in ("size", "d"))
            at, xs = np.cumsum(size)[:-1], np.cumsum(size * d)[:-1]
            return [(c, p, w, i, m, v.reshape(-1, w)) for c, p, w, i, m, v in zip(getattr(r, f"cell{k}"), getattr(r, f"part{k}"), d, np.split(a, at), np.split(n, at), np.split(x, xs))]

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for r in f.itertuples(index=False):
                    left, right = opened(r, 1), opened(r, 2)
                    for s in left:
                        for t in right:
                            if s[2] != t[2] or r.k1 == r.k2 and s[:2] > t[:2]:
                                continue
                            (cell, _, _, a, n, x), (own, _, _, b, m, y) = sorted((s, t), key=lambda v: v[:2])
                            ok = may(cell, own, y)
                            if ok.any():
                                yield from each(a, n, x, b[ok], m[ok], y[ok], s[:2] == t[:2])

        return both.mapInPandas(lambda f: meet(f) if last is None else last(meet(f)), schema)


def _reaching(c: Cells) -> Callable[[pd.DataFrame], Iterator[tuple[str, np.ndarray]]]:
    """A function of rows of ``c``: (cell, places of the rows that may have partners in it), for the cells up to the rows' own; it may run in tasks."""
    pivots, wide, cos = c.pivots, c.wide, c.cos

    def each(f: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
        for top, g in f.reset_index(drop=True).groupby(f["cell"].str.rpartition("/")[0].to_numpy(), sort=False):
            if top not in pivots:
                yield from ((own, at.to_numpy()) for own, at in g.groupby("cell").groups.items())
                continue
            p = pivots[top]
            names = sorted(f"{top}/{j}" for j in range(len(p)))
            g = g.sort_values("cell", kind="stable")
            step = max(CHUNK // (8 * len(p)), 1)
            for k in range(0, len(g), step):
                own, at = g["cell"].iloc[k : k + step].to_numpy(object), g.index[k : k + step].to_numpy()
                dots = _unit(_matrix(g["x"].iloc[k : k + step])) @ p.T
                for cell in names:
                    s, e = np.searchsorted(own, cell), np.searchsorted(own, cell, "right")
                    ok = _in_reach(dots[e:], p, cos[top], wide[top], int(cell.rpartition("/")[2]))
                    yield cell, np.concatenate([at[s:e], at[e:][ok]])

    return each


def _copies(c: Cells) -> DataFrame:
    """(b, cell, own, j): each row, of cell ``own`` and part j, once for every cell up to its own that may hold partners of it."""
    reaching = _reaching(c)

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cell, at in reaching(f):
                if len(at):
                    g = f.iloc[at]
                    yield pd.DataFrame({"b": g["a"], "cell": cell, "own": g["cell"], "j": g["part"]})

    return c.rows.mapInPandas(copy, "b long, cell string, own string, j int")


def _sides(c: Cells) -> DataFrame:
    """(cell, own, j, ny): the numbers of ``_copies``, added up in tasks without a row for a copy; a few rows of one key."""
    reaching = _reaching(c)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            cell, own, j = zip(*held)
            return pd.DataFrame({"cell": cell, "own": own, "j": j, "ny": list(held.values())})

        for f in frames:
            tile, names = pd.factorize(pd.MultiIndex.from_frame(f[["cell", "part"]]))
            for cell, at in reaching(f):
                n = np.bincount(tile[at], minlength=len(names))
                for k in np.flatnonzero(n).tolist():
                    held[(cell, *names[k])] += int(n[k])
                if len(held) > SENT:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return c.rows.mapInPandas(count, "cell string, own string, j int, ny long").groupBy("cell", "own", "j").agg(F.sum("ny").alias("ny"))


def _sizes(c: Cells) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of tiles, tiles, sides of tiles by the cells in their reach) with their numbers of rows, nx and ny; counts only."""
    tiles = c.ws.write(c.rows.groupBy("cell", F.col("part").alias("i")).agg(F.count(F.lit(1)).alias("nx")), "sizes")
    sides = c.ws.write(_sides(c), "sides")
    return c.ws.write(tiles.join(sides, "cell").where("cell <> own OR i <= j"), "pairs"), tiles, sides


def blocks(df: DataFrame, least: float, id: str = "ord", vector: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """(X, Y, n): what ``similar_pairs`` compares, without vectors, for looks at it: rows of the two sides with cell, own, i and j, and the number of blocks.

    A block is two tiles; X holds the first's rows (a), Y the second's (b, own:
    their cell) that may have partners in the first's cell.
    """
    c = Cells(df, least, id, vector)
    pairs, _, _ = _sizes(c)
    keys = pairs.select("cell", "own", "i", "j")
    x = c.rows.select("a", "cell", F.col("part").alias("i")).join(keys, ["cell", "i"])
    return x, _copies(c).join(keys, ["cell", "own", "j"]), pairs.count()


def _near(x: np.ndarray, y: np.ndarray, least: float, first: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, whether surely near): candidates of dot products of at least ``least``, a strip of x at a time; ``first`` says which pairs count where tiles are the same."""
    longest = [float(np.sqrt((m * m).sum(1).max())) for m in (x, y)]
    size = longest[0] * longest[1]
    small = max(longest) < 1e15 and least > 1e-20  # within the range of floats
    slack = (x.shape[1] + 8) * size * (2.0**-23 if small else 2.0**-52)
    p, q = (m.astype(np.float32 if small else np.float64) for m in (x, y))
    step = max(CHUNK // (8 * len(y)), 1)
    for k in range(0, len(x), step):
        s = p[k : k + step] @ q.T
        at = np.flatnonzero(s >= s.dtype.type(least - slack) - abs(np.spacing(s.dtype.type(least))))
        sure = s.ravel()[at] >= least + slack
        r, c = np.divmod(at, len(y))
        r += k
        if first is not None:
            keep = first[r] < first[c]
            r, c, sure = r[keep], c[keep], sure[keep]
        yield r, c, sure


def _dots(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products added up in order of position, as the expression ``cosine`` does."""
    step = max(CHUNK // (8 * x.shape[1]), 1)
    s = [np.cumsum(x[r[k : k + step]] * y[c[k : k + step]], axis=1)[:, -1] for k in range(0, len(r), step)]
    return np.concatenate(s) if s else np.array([], np.float64)


def similar_pairs(df: DataFrame, least: float, id: str = "ord", vector: str = "embedding") -> DataFrame:
    """(a, b, similarity), a < b: pairs of vectors whose dot product is at least ``least`` (above 0), exact.

    Vectors of one length are compared; they are meant to be unit ones, and longer
    ones only widen what is compared.  Rows whose id or vector is null, and vectors that are empty,
    all zero, or hold a null or NaN have no pairs.  Ids should be unique: rows
    of one id have no pair with each other.  Equal vectors are all paired.
    """

    def each(a, n, x, b, m, y, same) -> Iterator[pd.DataFrame]:
        for r, c, _ in _near(x, y, least, a if same else None):
            for k in range(0, len(r), SENT):
                i, j = r[k : k + SENT], c[k : k + SENT]
                s = _dots(x, y, i, j)
                ok = (s >= least) & (a[i] != b[j])
                i, j = a[i[ok]], b[j[ok]]
                yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "similarity": s[ok]})

    return Cells(df, least, id, vector).compare(each, _PAIRS)


def _met(df: DataFrame, least: float, id: str, vector: str, weight: str) -> DataFrame:
    """(a, met): the sum of ``weight`` over the rows that ``similar_pairs`` would pair a row with, added up in tasks without a row for each pair."""

    def each(a, n, x, b, m, y, same) -> Iterator[pd.DataFrame]:
        left, right = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for r, c, sure in _near(x, y, least, a if same else None):
            ok = sure | False
            doubt = np.flatnonzero(~sure)
            ok[doubt] = _dots(x, y, r[doubt], c[doubt]) >= least
            r, c = r[ok], c[ok]
            np.add.at(left, r, m[c])
            np.add.at(right, c, n[r])
        for ids, sums in ((a, left), (b, right)):
            yield pd.DataFrame({"a": ids[sums > 0], "met": sums[sums > 0]})

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size > 4 * SENT:
                held = [pd.concat(held).groupby("a", as_index=False)["met"].sum()]
                size = len(held[0])
                if size > 2 * SENT:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield pd.concat(held).groupby("a", as_index=False)["met"].sum()

    return Cells(df, least, id, vector, weight).compare(each, "a long, met long", last).groupBy("a").agg(F.sum("met").alias("met"))


def similar_classes(df: DataFrame, least: float, id: str = "ord", vector: str = "embedding") -> DataFrame:
    """(id, head, links): the class of equal vectors that a row is in, by its least id, and with how many rows ``similar_pairs`` would pair it.

    Only heads are compared, so that copies cost no pairs, and links are counted
    where they are found, so that no row is made for a pair.  A row without a
    usable vector has a null head and no links.
    """
    ws = Workspace(df.sparkSession, "classes")
    rows = ws.write(df.select(F.col(id).cast("long").alias(id), F.col(vector).cast("array<double>").alias("v")), "rows")
    usable = F.col(id).isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    heads = ws.write(rows.where(usable).groupBy("v").agg(F.min(id).alias("head"), F.count(F.lit(1)).alias("n")), "heads")  # written, so that a hot vector's join can be split
    met = _met(heads, least, "head", "v", "n").withColumnRenamed("a", "head")
    own = F.when(cosine(F.col("v"), F.col("v")) >= least, F.col("n") - 1).otherwise(0)
    counted = ws.write(heads.join(met, "head", "left").select("v", "head", (F.coalesce("met", F.lit(0)) + own).alias("links")), "counted")
    return rows.join(counted, "v", "left").select(id, "head", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def block_report(df: DataFrame, least: float, id: str = "ord", vector: str = "embedding") -> DataFrame:
    """One row of what ``similar_pairs`` compares: rows, copies (rows, once for each cell in their reach), blocks, compared pairs, share_of_all pairs, largest_share of a block."""
    pairs, rows, copies = _sizes(Cells(df, least, id, vector))
    row = rows.agg(F.sum("nx").alias("rows")).join(copies.agg(F.sum("ny").alias("copies")))
    each = F.when((F.col("cell") == F.col("own")) & (F.col("i") == F.col("j")), F.col("nx") * (F.col("nx") - 1) / 2).otherwise(F.col("nx") * F.col("ny")).cast("long")
    made = pairs.agg(F.count(F.lit(1)).alias("blocks"), F.sum(each).alias("compared"), F.max(each).alias("largest"))
    n = F.col("rows").cast("double")
    return row.join(made).select("rows", "copies", "blocks", "compared", (F.col("compared") / (n * n / 2)).alias("share_of_all"), (F.col("largest") / F.col("compared")).alias("largest_share"))


def code_vector(code: Column) -> Column:
    """A 64-bit code as a unit vector; codes that differ in d bits have the dot product 1 - d / 32."""
    bit = lambda k: F.call_function("shiftrightunsigned", code, k).bitwiseAND(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(bit(k) == 1, F.lit(0.125)).otherwise(F.lit(-0.125)))
