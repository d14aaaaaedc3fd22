"""Groups of near duplicates that grow by batches, without comparing known photos with each other again.

Kept below a root are three kinds of tables, of which a pointer names those in use:

* heads (perceptual_hash, capture_s, ord, label): the first photo of each code and
  time that occurs.  Photos alike in both are in one group, so heads are all that
  later photos need to meet.
* members (ord, label): every photo with the group it was put in when it came.
* merged (label, component): groups that later photos joined to others.

Parts of heads and members are added and never written again; merged holds only
groups that were joined, and is what a batch rewrites.  A batch compares its
photos with each other and with the heads, and builds components over its photos
and the groups they touch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators import grouping
from grainfold.operators.grouping import BUCKET_MOST, THRESHOLD, WINDOW_S
from grainfold.plans.components import connected_components
from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace, replace_file

HEADS = "perceptual_hash long, capture_s long, ord long, label long"
MEMBERS, MERGED = "ord long, label long", "label long, component long"


def _hung(free: DataFrame, heads: DataFrame, threshold: int, ws: Workspace, name: str) -> DataFrame:
    """(src, dst) that connect heads with the untimed ones of near codes: ``free`` (l, head) has one row a code, ``heads`` (ord, perceptual_hash).

    What is near one code hangs together, so codes are joined by as few pairs as
    connect them, and a head is tied to the least of the untimed heads it is joined with.
    """
    near = ws.write(grouping.near_codes(free.select("l"), heads.select(F.col("perceptual_hash").alias("r")).distinct(), threshold, joined=True).join(free, "l"), name)
    first = near.groupBy("r").agg(F.min("head").alias("first"))
    ties = near.join(first, "r").select(F.col("head").alias("src"), F.col("first").alias("dst"))
    return ties.unionAll(heads.join(first, F.col("perceptual_hash") == F.col("r")).select(F.col("ord").alias("src"), F.col("first").alias("dst")))


def _timed(new: DataFrame, old: DataFrame, threshold: int, window_s: int, ws: Workspace) -> DataFrame:
    """(src, dst): pairs of a new and a known timed head that the predicate links, met in buckets of time, and in blocks of the code where a bucket is full."""
    z = F.floor(F.col("capture_s") / (window_s + 1))
    a = new.select("ord", "perceptual_hash", "capture_s", F.explode(F.array(z - 1, z, z + 1)).alias("z"))
    b = old.select("ord", "perceptual_hash", "capture_s", z.alias("z"))
    full = ws.write(b.groupBy(F.col("z").alias("f")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BUCKET_MOST).select("f"), "full")

    def meet(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        hit = x.hint("merge").alias("a").join(y.alias("b"), on).where(grouping.same_shot("a", "b", threshold, window_s))
        return hit.select(F.col("a.ord").alias("src"), F.col("b.ord").alias("dst"))

    sparse = [x.join(full, F.col("z") == F.col("f"), "left_anti") for x in (a, b)]
    dense = [
        x.join(full, F.col("z") == F.col("f"), "left_semi").withColumn("x", F.explode(grouping._offers(F.col("perceptual_hash"), r))).select("*", "x.k", "x.b")
        for x, r in zip((a, b), grouping._split(threshold))
    ]
    return meet(*sparse, ["z"]).unionAll(meet(*dense, ["z", "k", "b"]).distinct())


class GroupIndex:
    """The kept groups of one collection.  One writer at a time; readers see a batch wholly or not at all."""

    def __init__(self, spark: SparkSession, root: str, threshold: int = THRESHOLD, window_s: int | None = WINDOW_S):
        self.spark, self.root, self.threshold, self.window_s = spark, root.rstrip("/"), threshold, window_s

    def _state(self) -> dict[str, list[str]]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return {"heads": [], "members": [], "merged": []}
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT").first()[0])

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def _kept(self, df: DataFrame, name: str, v: str) -> str:
        df.write.parquet(f"{self.root}/{name}-{v}")
        return f"{name}-{v}"

    def add(self, photos: DataFrame) -> None:
        """Takes in photos (ord, perceptual_hash, capture_s); ``ord`` must be new, also within the batch.

        Photos without a code are in no group and are not kept.  An empty batch
        changes nothing.  A batch that fails leaves the groups as they were, and
        may be given again.
        """
        state, ws, v = self._state(), Workspace(self.spark, "increment"), uuid.uuid4().hex
        time = F.lit(None).cast("long") if self.window_s is None else F.col("capture_s").cast("long")
        new = ws.write(photos.where("perceptual_hash IS NOT NULL").select(F.col("ord").cast("long").alias("ord"), F.col("perceptual_hash").cast("long").alias("perceptual_hash"), time.alias("capture_s")), "new")
        if new.isEmpty():
            return
        known = self._read(state["heads"], HEADS)
        heads = ws.write(new.groupBy("perceptual_hash", "capture_s").agg(F.min("ord").alias("ord")), "heads")
        links = ws.write(grouping.group_links(new, self.threshold, self.window_s), "links")
        if state["heads"]:
            links = links.unionAll(self._links(heads, known, ws))
        merged = self._read(state["merged"], MERGED)
        group = known.select(F.col("ord").alias("__o"), "label").join(merged, "label", "left").select("__o", F.coalesce("component", "label").alias("__g"))
        ends = ws.write(links.select(F.explode(F.array("src", "dst")).alias("n")).distinct(), "ends")
        group = ws.write(group.join(ends, F.col("__o") == F.col("n"), "left_semi"), "touched")
        for end in ("src", "dst"):
            links = links.join(group, F.col(end) == F.col("__o"), "left").withColumn(end, F.coalesce("__g", end)).drop("__o", "__g")
        cc = ws.write(connected_components(links, ws), "cc")

        labelled = ws.write(new.join(cc, F.col("ord") == F.col("node"), "left").select("ord", "perceptual_hash", "capture_s", F.coalesce("component", "ord").alias("label")), "labelled")
        alike = (F.col("h.perceptual_hash") == F.col("k.perceptual_hash")) & F.col("h.capture_s").eqNullSafe(F.col("k.capture_s"))
        first = labelled.join(heads.select("ord"), "ord", "left_semi").alias("h").join(known.alias("k"), alike, "left_anti").select("perceptual_hash", "capture_s", "ord", "label")
        moved = cc.where("node <> component").join(group.select("__g").distinct(), F.col("node") == F.col("__g"), "left_semi")
        moved = ws.write(moved.select(F.col("node").alias("label"), "component"), "moved")
        if not moved.isEmpty():
            m = moved.select(F.col("label").alias("__l"), F.col("component").alias("__c"))
            after = merged.join(m, F.col("component") == F.col("__l"), "left").select("label", F.coalesce("__c", "component").alias("component"))
            state["merged"] = [self._kept(after.unionAll(moved), "merged", v)]
        state["heads"] = [*state["heads"], self._kept(first, "heads", v)]
        state["members"] = [*state["members"], self._kept(labelled.select("ord", "label"), "members", v)]
        replace_file(self.spark, f"{self.root}/CURRENT", json.dumps(state).encode())

    def _links(self, heads: DataFrame, known: DataFrame, ws: Workspace) -> DataFrame:
        """(src, dst) between heads of a batch and known ones; each kind is written by a plan of its own."""
        free = [x.where("capture_s IS NULL").select(F.col("perceptual_hash").alias("l"), F.col("ord").alias("head")) for x in (heads, known)]
        out = ws.write(_hung(free[0], known, self.threshold, ws, "near-new"), "hung-new").unionAll(ws.write(_hung(free[1], heads, self.threshold, ws, "near-known"), "hung-known"))
        if self.window_s is not None:
            out = out.unionAll(ws.write(_timed(heads.where("capture_s IS NOT NULL"), known.where("capture_s IS NOT NULL"), self.threshold, self.window_s, ws), "timed"))
        return out.where("src <> dst")

    def components(self) -> DataFrame:
        """(ord, component) of every kept photo, alone or not; component is the least ord of its group."""
        state = self._state()
        members, merged = self._read(state["members"], MEMBERS), self._read(state["merged"], MERGED)
        return members.join(merged, "label", "left").select("ord", F.coalesce("component", "label").alias("component"))

    def groups(self) -> DataFrame:
        """(ord, duplicate_group) as ``grouping.duplicate_groups`` of all photos taken in would give them: groups of two or more, numbered by their first photo."""
        ws, of = Workspace(self.spark, "increment"), self.components()
        heads = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("component").alias("head"))
        numbers = running(heads, [F.col("head")], ws, "numbers")
        return of.join(numbers, F.col("component") == F.col("head")).select("ord", (F.col("__upto") - 1).cast("int").alias("duplicate_group"))
