"""People from face embeddings: cosine pairs, leader clustering in one pass or two phases, nearest centroid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.formulas import cosine
from grainfold.operators.metric import similar_pairs
from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace

SAME_PERSON = 0.5


class Leaders:
    """Centroids of the people seen so far; each row joins the nearest above the threshold, or starts a new one.

    Centroids of one length lie in one array that grows by doubling, so that a
    row meets them in one product; a centroid of another length is no match.
    """

    def __init__(self, threshold: float = SAME_PERSON):
        self.threshold, self.persons, self.by_size = threshold, 0, {}

    def assign(self, e: np.ndarray | None) -> int | None:
        if e is None or not len(e):
            return None
        centroids, counts, ids = self.by_size.get(len(e), (np.empty((8, len(e))), [], []))
        n = len(ids)
        if n:
            sims = centroids[:n] @ e
            k = int(sims.argmax())  # the first of equals
            if sims[k] > self.threshold:
                c = (centroids[k] * counts[k] + e) / (counts[k] + 1)
                norm = float(np.sqrt(c @ c))
                centroids[k] = c / norm if norm > 1e-12 else c
                counts[k] += 1
                return ids[k]
        if n == len(centroids):
            centroids = np.concatenate([centroids, np.empty_like(centroids)])
        centroids[n] = e
        counts.append(1)
        ids.append(self.persons)
        self.by_size[len(e)] = centroids, counts, ids
        self.persons += 1
        return ids[-1]


def cluster_persons(df: DataFrame, threshold: float = SAME_PERSON, batch: str | None = None) -> DataFrame:
    """(batch,) ord, person_id: leader clustering of ``embedding`` in the order of ``ord``, batch by batch.

    The result depends on the order, so one batch is one pass; rows stream
    through sorted, and only the centroids are held.  Batches run in parallel.
    A null or empty embedding has no person.
    """
    b = F.col(batch).cast("string") if batch else F.lit("")
    rows = df.select(b.alias("batch"), "ord", "embedding").repartition("batch").sortWithinPartitions("batch", "ord")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, None
        for f in frames:
            out = []
            for name, e in zip(f["batch"], f["embedding"]):
                if leaders is None or name != now:
                    now, leaders = name, Leaders(threshold)
                out.append(leaders.assign(None if e is None else np.asarray(e, np.float64)))
            yield pd.DataFrame({"batch": f["batch"], "ord": f["ord"], "person_id": pd.array(out, "Int32")})

    got = rows.mapInPandas(run, "batch string, ord long, person_id int")
    return got if batch else got.drop("batch")


def cosine_pairs(df: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): pairs of unit embeddings of at least ``least``, exact, by ``metric.similar_pairs``."""
    return similar_pairs(df, least)


#: Rows of a block of ``cluster_persons_two_phase``, and blocks at least.
BLOCK_ROWS, LEAST_BLOCKS = 100_000, 8


def person_block(n: int) -> Column:
    """The block of a row of ``ord`` among ``n`` rows."""
    return F.pmod(F.xxhash64("ord"), F.lit(max(LEAST_BLOCKS, -(-n // BLOCK_ROWS)))).cast("int")


def _joined(leaders: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """(ord, head) of the leaders that join another: the greedy choice of heads, in rounds over all links at once.

    In each round the leaders that no undecided one precedes are heads, and what
    is linked with them is taken; the others wait.  The number of rounds is that
    of the longest chain of such waits, about the logarithm of the leaders where their
    order is as good as random.
    """
    size = lambda c: leaders.select(F.col("ord").alias(c), F.col("rows").alias(f"n{c}"))
    both = links.join(size("a"), "a").join(size("b"), "b")
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    turn = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    links = ws.write(both.select(turn("a", "b").alias("p"), turn("b", "a").alias("s"), "similarity"), "links")
    wait, taken, k = links.select("p", "s"), None, 0
    while not wait.isEmpty():
        waiting = wait.select("s").distinct()
        heads = ws.write(wait.select("p").distinct().join(waiting, F.col("p") == F.col("s"), "left_anti"), f"heads-{k}")
        now = ws.write(wait.join(heads, "p", "left_semi").select(F.col("s").alias("t")).distinct(), f"taken-{k}")
        taken = now if taken is None else taken.unionAll(now)
        rest = wait.join(now, F.col("p") == F.col("t"), "left_anti").join(now, F.col("s") == F.col("t"), "left_anti")
        wait, k = ws.write(rest, f"wait-{k}"), k + 1
    if taken is None:
        return leaders.select("ord", F.col("ord").alias("head")).limit(0)
    taken = ws.write(taken, "taken")
    ends = links.select(F.col("p").alias("head"), F.col("s").alias("ord"), "similarity").unionAll(links.select(F.col("s").alias("head"), F.col("p").alias("ord"), "similarity"))
    mine = ends.join(taken, F.col("ord") == F.col("t"), "left_semi").join(taken, F.col("head") == F.col("t"), "left_anti")
    return mine.groupBy("ord").agg((-F.max(F.struct("similarity", (-F.col("head")).alias("h")))["h"]).alias("head"))


def cluster_persons_two_phase(df: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """(ord, person_id): leader clustering in blocks, whose leaders are then merged; no task sees all rows.

    The rule: rows are dealt to blocks by a hash of ``ord``; each block is
    clustered in the order of ``ord`` as by ``cluster_persons``.  Leaders (the last
    centroids) are linked where their similarity is above ``threshold`` (which
    must be above 0).  Taken by the number of their rows, the largest first, and
    by their first row, a leader that is linked with no earlier head is a head;
    any other joins the linked head most similar to it, the first row deciding
    equals.  So nothing is chained: every leader of a person is linked with its head.
    Persons are numbered from 0 by the first row of their head.  The result is
    not that of one pass, as blocks see other rows first.  A null or empty
    embedding has no person; ids should be unique and not null.
    """
    ws = Workspace(df.sparkSession, "persons")
    rows = ws.write(df.select(F.col("ord").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding")), "rows")
    has = rows.where(F.size("embedding") > 0)
    dealt = has.withColumn("block", person_block(has.count())).repartition("block").sortWithinPartitions("block", "ord")

    def leaders(now: int, found: Leaders, first: dict[int, int]) -> pd.DataFrame:
        at = {ids[k]: list(c[k]) for c, _, ids in found.by_size.values() for k in range(len(ids))}
        rows = {ids[k]: counts[k] for _, counts, ids in found.by_size.values() for k in range(len(ids))}
        return pd.DataFrame({"block": now, "person": list(at), "ord": [first[k] for k in at], "rows": [rows[k] for k in at], "centroid": list(at.values())})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found, first = None, None, {}
        for f in frames:
            for block, g in f.groupby("block"):  # rows come sorted by it
                if block != now:
                    if now is not None:
                        yield leaders(now, found, first)
                    now, found, first = block, Leaders(threshold), {}
                who = [found.assign(np.asarray(e, np.float64)) for e in g["embedding"]]
                for k, o in zip(who, g["ord"]):
                    first.setdefault(k, o)
                yield pd.DataFrame({"block": block, "person": who, "ord": g["ord"].to_numpy(), "rows": 1, "centroid": None})
        if now is not None:
            yield leaders(now, found, first)

    seen = ws.write(dealt.mapInPandas(run, "block int, person int, ord long, rows long, centroid array<double>"), "blocks")
    found, members = seen.where("centroid IS NOT NULL"), seen.where("centroid IS NULL").select("block", "person", "ord")
    links = similar_pairs(found, threshold, vector="centroid").where(F.col("similarity") > threshold)
    joined = _joined(found.select("ord", "rows"), links, ws)
    named = ws.write(found.select("block", "person", "ord").join(joined, "ord", "left").select("block", "person", F.coalesce("head", "ord").alias("head")), "named")
    numbers = running(named.select("head").distinct(), [F.col("head")], ws, "numbers").select("head", (F.col("__upto") - 1).cast("int").alias("person_id"))
    who = members.join(named.join(numbers, "head"), ["block", "person"]).select("ord", "person_id")
    return who.unionAll(rows.where("embedding IS NULL OR size(embedding) = 0").select("ord", F.lit(None).cast("int").alias("person_id")))


def nearest_centroid(df: DataFrame, centroids: list[tuple[int, list[float]]], threshold: float = SAME_PERSON) -> DataFrame:
    """(ord, person_id, similarity): the centroid (of a list that the caller bounds) most like each row, if above the threshold."""
    cand = [F.struct(cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in c])).alias("s"), F.lit(-k).alias("k")) for k, c in centroids]
    best = F.array_max(F.array(*cand))
    hit = best["s"] > F.lit(threshold)
    return df.select("ord", F.when(hit, -best["k"]).alias("person_id"), F.when(hit, best["s"]).alias("similarity"))
