"""Near-duplicate groups: perceptual codes, the Hamming and time join, and group numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

from grainfold.functions.formulas import hamming, pack_bits
from grainfold.operators import codes
from grainfold.plans.components import connected_components
from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace, dropped_shuffles

THRESHOLD, WINDOW_S = 10, 30
#: Places and widths of the blocks that a 64-bit code is split into for the join within full time buckets.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Rows of a time bucket up to which they are compared with each other; a larger bucket joins by code blocks too.
BUCKET_MOST = 256
#: Cells that the tokens of a text fall into, and bytes of texts that are split together.
CELLS, CHUNK = 72, 1 << 22


def _cells(words: pa.Array) -> np.ndarray:
    """The cell of each word: the first two bytes of its MD5, modulo 72."""
    words = words.dictionary_encode()
    of = [int.from_bytes(md5(w).digest()[:2], "big") % CELLS for w in words.dictionary.cast(pa.binary()).to_pylist()]
    return np.array(of, np.int64)[words.indices.to_numpy()]


def _cell_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """How many tokens of each text fall into each cell, a row for each text, for as many texts at a time as hold CHUNK bytes (or for one)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        tok = pc.split_pattern(texts[at:end], " ")
        rows = np.repeat(np.arange(end - at), pc.list_value_length(tok).to_numpy())
        yield np.bincount(rows * CELLS + _cells(tok.flatten()), minlength=(end - at) * CELLS).reshape(-1, CELLS)
        at = end


def _listed(counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * CELLS, counts.astype(np.int32).ravel())


def _packed(counts: np.ndarray) -> pa.Array:
    """``pack_bits`` of each row of counts."""
    grid = counts.reshape(len(counts), 8, 9)
    bits = np.packbits((grid[:, :, :-1] > grid[:, :, 1:]).reshape(len(counts), 64), axis=1, bitorder="little")
    return pa.array(bits.view("<i8").ravel())


def text_grid_hash(p: DataFrame) -> DataFrame:
    """(ord, perceptual_hash): the stand-in perceptual code of a row's text.

    Each token falls into one of 9 x 8 cells; a bit says whether a cell holds
    more tokens than the next.  Tokens are counted, and codes made, where their
    text is read, so nothing is shuffled.  Rows of one ord add up: only where
    there are such, which is looked up first, each text moves as one small array.
    """

    def mapped(name: str, kind: DataType, made: Callable[[np.ndarray], pa.Array]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = 0
                for counts in _cell_counts(b.column(1)):
                    yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(counts)], made(counts)], ["ord", name])
                    at += len(counts)

        return p.select("ord", F.lower(F.coalesce("text", F.lit(""))).alias("low")).mapInArrow(run, StructType([p.schema["ord"], StructField(name, kind)]))

    with dropped_shuffles(p.sparkSession):
        once = p.groupBy("ord").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
    if once:
        return mapped("perceptual_hash", LongType(), _packed)
    counts = mapped("cells", ArrayType(IntegerType()), _listed)
    each = counts.groupBy("ord").agg(F.collect_list("cells").alias("each"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.aggregate("each", F.lit(0).cast("long"), lambda s, x: s + F.get(x, k)))
    return each.select("ord", F.explode(F.array(grid)).alias("grid")).select("ord", pack_bits(F.col("grid")).alias("perceptual_hash"))


def same_shot(a: str, b: str, threshold: int = THRESHOLD, window_s: int | None = WINDOW_S) -> Column:
    """The duplicate predicate over two aliased rows: codes near, and times near where both are known."""
    near = hamming(F.col(f"{a}.perceptual_hash"), F.col(f"{b}.perceptual_hash")) <= threshold
    if window_s is None:
        return near
    ta, tb = F.col(f"{a}.capture_s"), F.col(f"{b}.capture_s")
    return near & (ta.isNull() | tb.isNull() | (F.abs(ta - tb) <= window_s))


def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _offers(c: Column, radius: int) -> Column:
    """array of (k, b): the blocks of a code, each with every value within ``radius`` bits of it."""

    def block(k: int) -> Column:
        at, width = BLOCKS[k]
        own = F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = F.split(F.lit(",".join(map(str, _flips(width, radius)))), ",").cast("array<bigint>")  # folds to one literal, which plans faster than one each
        return F.transform(flips, lambda f: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(f).alias("b")))

    return F.concat(*[block(k) for k in range(len(BLOCKS))])


def _split(threshold: int) -> tuple[int, int]:
    """What the two sides of a block join may flip, so that blocks within threshold // BLOCKS meet."""
    r = threshold // len(BLOCKS)
    return r - r // 2, r // 2


def near_codes(left: DataFrame, right: DataFrame, threshold: int = THRESHOLD, joined: bool = False) -> DataFrame:
    """(l, r): pairs of codes within ``threshold`` bits, from columns l and r of distinct codes; with ``joined`` only pairs enough to connect what all of them connect.

    Codes of short texts are near very many others, so the pairs grow with the
    square of the table: what only asks what hangs together should take ``joined``.
    """
    pairs = codes.near(left.select("l", F.col("l").alias("code")), right.select("r", F.col("r").alias("code")), threshold, joined)
    return pairs.select(F.col("a").alias("l"), F.col("b").alias("r"))


def timed_pairs(p: DataFrame, threshold: int = THRESHOLD, window_s: int = WINDOW_S, most: int = BUCKET_MOST) -> DataFrame:
    """(src, dst), src < dst: duplicate pairs of rows that both have a time, by an equi-join on time buckets.

    Buckets are window_s + 1 seconds wide, so a partner is in the same one or the
    next.  In buckets of more than ``most`` rows, partners also share a block of
    the code: codes within T differ in some block by at most T // 3 bits, and either side offers its
    blocks with some bits flipped, so that a burst is not compared with itself
    row by row.
    """
    t = p.where("capture_s IS NOT NULL AND perceptual_hash IS NOT NULL").select("ord", "perceptual_hash", "capture_s", F.floor(F.col("capture_s") / (window_s + 1)).alias("z"))
    ahead = t.select("ord", "perceptual_hash", "capture_s", F.explode(F.array(F.col("z"), F.col("z") - 1)).alias("z"))
    full = ahead.groupBy(F.col("z").alias("f")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("f")
    full = Workspace(p.sparkSession, "buckets").write(full, "full")
    near = (F.floor(F.col("b.capture_s") / (window_s + 1)) > F.col("a.z")) | (F.col("a.ord") < F.col("b.ord"))

    def meet(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        hit = a.hint("merge").alias("a").join(b.alias("b"), on & near).where(same_shot("a", "b", threshold, window_s))
        return hit.select(F.least("a.ord", "b.ord").alias("src"), F.greatest("a.ord", "b.ord").alias("dst"))

    sparse = [x.join(full, F.col("z") == F.col("f"), "left_anti") for x in (t, ahead)]
    dense = [x.join(full, F.col("z") == F.col("f")).drop("f").withColumn("x", F.explode(_offers(F.col("perceptual_hash"), r))).select("*", "x.k", "x.b") for x, r in zip((t, ahead), _split(threshold))]
    same_block = (F.col("a.z") == F.col("b.z")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.b") == F.col("b.b"))
    return meet(*sparse, F.col("a.z") == F.col("b.z")).unionAll(meet(*dense, same_block).distinct())


def untimed_pairs(p: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(src, dst), src < dst: all duplicate pairs in which a row has no time.  For reports; groups do not need it."""
    rows = p.where("perceptual_hash IS NOT NULL")
    free = rows.where("capture_s IS NULL")
    of = lambda d: d.select("ord", F.col("perceptual_hash").alias("code"))
    timed = codes.near(of(free), of(rows.where("capture_s IS NOT NULL")), threshold)
    both = codes.near(of(free), of(free), threshold).where("a < b")
    return timed.unionAll(both).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def hamming_pairs(p: DataFrame, threshold: int = THRESHOLD, window_s: int = WINDOW_S) -> DataFrame:
    """(src, dst): every pair of rows that the duplicate predicate links."""
    return timed_pairs(p, threshold, window_s).unionAll(untimed_pairs(p, threshold))


def group_links(p: DataFrame, threshold: int = THRESHOLD, window_s: int | None = WINDOW_S) -> DataFrame:
    """(src, dst): links that connect what the duplicate predicate connects, without all pairs of a group.

    A row without time links by its code alone, so all rows whose codes are near
    that of one such row hang together: near codes are joined by as few pairs as
    connect them, and rows are tied to an untimed row near their code.  Timed rows with one code and one time are tied to the least of them.
    """
    rows = p.where("perceptual_hash IS NOT NULL").select("ord", "perceptual_hash", F.lit(None).cast("long").alias("capture_s") if window_s is None else F.col("capture_s"))
    free = rows.where("capture_s IS NULL").groupBy(F.col("perceptual_hash").alias("l")).agg(F.min("ord").alias("head"))
    near = near_codes(free.select("l"), rows.select(F.col("perceptual_hash").alias("r")).distinct(), threshold, joined=True)
    ws = Workspace(p.sparkSession, "near")
    near = ws.write(near.join(free, "l"), "near")
    first = near.groupBy("r").agg(F.min("head").alias("first"))
    ties = near.join(first, "r").select(F.col("head").alias("src"), F.col("first").alias("dst"))
    hung = rows.join(first, F.col("perceptual_hash") == F.col("r")).select(F.col("ord").alias("src"), F.col("first").alias("dst"))
    out = ties.unionAll(hung)
    if window_s is not None:  # kinds of links are written one after the other, so that their shuffles don't add up
        out = ws.write(out.where("src <> dst"), "untimed")
        timed = rows.where("capture_s IS NOT NULL")
        heads = ws.write(timed.groupBy("perceptual_hash", "capture_s").agg(F.min("ord").alias("ord"), F.max("ord").alias("last")), "heads")
        h = heads.where("ord <> last").select("perceptual_hash", "capture_s", F.col("ord").alias("head"))
        same = timed.join(h, ["perceptual_hash", "capture_s"]).select(F.col("ord").alias("src"), F.col("head").alias("dst"))
        out = out.unionAll(ws.write(same.where("src <> dst"), "same")).unionAll(ws.write(timed_pairs(heads.drop("last"), threshold, window_s), "timed"))
    return out.where("src <> dst")


def duplicate_groups(p: DataFrame, threshold: int = THRESHOLD, window_s: int | None = WINDOW_S) -> DataFrame:
    """(ord, duplicate_group) of rows in groups of two or more, numbered from 0 by each group's first row.

    Groups are numbered by their rank among the groups' first rows: the sort is
    over groups, not rows.  ``p`` is read several times: pass a written table.
    """
    ws = Workspace(p.sparkSession, "groups")
    cc = connected_components(group_links(p, threshold, window_s), ws)
    heads = cc.where("node = component").select("component")
    numbers = running(heads, [F.col("component")], ws, "numbers").withColumnRenamed("component", "head")
    return cc.join(numbers, F.col("component") == F.col("head")).select(F.col("node").alias("ord"), (F.col("__upto") - 1).cast("int").alias("duplicate_group"))


def add_groups(p: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds duplicate_group (null outside groups)."""
    g = groups.select(F.col("ord").alias("__o"), "duplicate_group")
    return p.join(g, F.col("ord") == F.col("__o"), "left").drop("__o")


def exact_duplicates(p: DataFrame) -> DataFrame:
    """(content_hash, copies, first_ord) of contents that occur more than once."""
    return p.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("ord").alias("first_ord")).where("copies > 1")


GRID_SQL = """
tok AS (SELECT ord, unnest(string_split(lower(coalesce(text, '')), ' ')) AS t FROM photos),
cells AS (SELECT ord, ('0x' || substr(md5(t), 1, 4))::INT % 72 AS c, count(*) AS k FROM tok GROUP BY 1, 2),
hashed AS (
  SELECT o.ord, sum(CASE WHEN coalesce(x.k, 0) > coalesce(y.k, 0) THEN (1::HUGEINT << b.b) ELSE 0 END)::HUGEINT AS h
  FROM (SELECT DISTINCT ord FROM photos) o CROSS JOIN (SELECT unnest(range(0, 64))::INT AS b) b
  LEFT JOIN cells x ON x.ord = o.ord AND x.c = 9 * (b.b // 8) + b.b % 8
  LEFT JOIN cells y ON y.ord = o.ord AND y.c = 9 * (b.b // 8) + b.b % 8 + 1
  GROUP BY o.ord)
"""
PAIRS_SQL = """
shots AS (SELECT p.ord, p.capture_s, h.h FROM photos p JOIN hashed h ON h.ord = p.ord),
pairs AS (
  SELECT a.ord AS src, b.ord AS dst FROM shots a JOIN shots b ON a.ord < b.ord
  WHERE bit_count(xor(a.h, b.h)) <= 10 AND (a.capture_s IS NULL OR b.capture_s IS NULL OR abs(a.capture_s - b.capture_s) <= 30))
"""
GROUPS_SQL = """
sym AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
reach AS (SELECT DISTINCT src AS ord, src AS t FROM sym UNION SELECT sym.dst, reach.t FROM reach JOIN sym ON sym.src = reach.ord),
comps AS (SELECT ord, min(t) AS comp FROM reach GROUP BY ord),
grouped AS (SELECT ord, (dense_rank() OVER (ORDER BY comp) - 1)::INT AS duplicate_group FROM comps)
"""
