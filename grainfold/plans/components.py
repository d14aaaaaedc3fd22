"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each
round hangs every node under the least neighbour it knows; minima are taken by
partial aggregation, so a hub with a huge number of neighbours sends one row per
map task.  Edges meet those minima by node and salt: a hub's edges are dealt to
SALTS tasks, and since neither side of such a join comes from an aggregation on
its keys, adaptive execution may split a task further.  Only hubs, of which there
are fewer than HUBS, have more than one salt, so minima are not copied for all
nodes.  Each half of a round is written, as its rows are read several times.  Rounds
end once every node hangs under a root.  Nothing is collected but two flags and a
number of edges per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.plans.workspace import Workspace, dropped_shuffles


#: Tasks that the edges of a hub are dealt to, and so copies of its minimum; a hub has more than 1 / HUBS of all edges.
SALTS, HUBS = 8, 1000


def _with_least(e: DataFrame, end: str, how: str, most: int) -> DataFrame:
    """The edges with m: the least smaller neighbour of the node at ``end``, which is a hub if more than ``most`` edges have it there."""
    hubs = e.groupBy(F.col(end).alias("h")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("h")
    own = lambda df, node: df.join(F.broadcast(hubs), F.col(node) == F.col("h"), "left")
    low = own(e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), "n")
    low = low.select("n", "m", F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in range(SALTS)]))).alias("t"))
    salted = own(e, end).select("u", "v", F.when(F.col("h").isNull(), F.lit(0)).otherwise(F.pmod(F.hash("u", "v"), F.lit(SALTS))).alias("s"))
    return salted.join(low, (F.col(end) == F.col("n")) & (F.col("s") == F.col("t")), how).select("u", "v", "m")


def _large_star(e: DataFrame, most: int) -> DataFrame:
    """Larger neighbours of every node move to the least node it knows (u > v in every edge, so only v has any)."""
    return _with_least(e, "v", "left", most).select("u", F.coalesce("m", "v").alias("v"))


def _small_star(e: DataFrame, most: int) -> DataFrame:
    """A node's smaller neighbours, and itself, move to the least of them."""
    e = _with_least(e, "u", "inner", most)
    moved = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))  # in one pass, as e is not written
    return e.select(moved.alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()


def _settled(e: DataFrame) -> bool:
    """Whether every node hangs under exactly one node that hangs under none."""
    one = F.lit(1)
    ends = e.select(F.col("u").alias("n"), one.alias("up"), F.lit(0).alias("down")).unionAll(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), one.alias("down")))
    with dropped_shuffles(e.sparkSession):
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, ws: Workspace, src: str = "src", dst: str = "dst", name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the least node reachable.

    Edges are undirected; self-loops, repeats and null ends are ignored (a node
    that has only such edges is not returned).  An empty table gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cur = ws.write(e, f"{name}-0")
    for k in range(1, max_rounds + 1):
        if _settled(cur):
            break
        most = max(1, cur.count() // HUBS)
        large = ws.write(_large_star(cur, most), f"{name}-large")
        ws.drop(f"{name}-{k - 1}")
        cur = ws.write(_small_star(large, most), f"{name}-{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ws.drop(f"{name}-large")
    pairs = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
