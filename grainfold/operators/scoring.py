"""Scores, ranks, group winners and proposed rejects of a measured batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import formulas as X
from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace


def midpoint_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds (rows with a value at most this one - 1/2) / rows, between 0 and 1; a null value gets 1/2.

    Values are counted first and numbered within ranges, so no task sees all
    rows, nor all values.
    """
    ws = Workspace(df.sparkSession, "percentile")
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running(counts, [F.col("__v")], ws, "values", "__c")
    total = upto.agg(F.max("__upto")).first()[0] or 1
    ranks = upto.select("__v", X.clamp((F.col("__upto") - X.num(0.5)) / X.num(total)).alias("__r"))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").withColumn(out, F.coalesce("__r", X.num(0.5))).drop("__v", "__r")


def own_scores(p: DataFrame, w: X.Weights = X.Weights()) -> DataFrame:
    """Adds exposure, resolution, aesthetic and face_bonus, which need no other row."""
    q, f = F.col("quality"), F.col("faces")
    return p.withColumns({
        "exposure": X.exposure(q["clipped_highlights_pct"], q["clipped_shadows_pct"], q["mean_luma"]), "resolution": X.resolution(F.col("width"), F.col("height")),
        "aesthetic": X.aesthetic(F.col("aesthetic_mean")), "face_bonus": X.face_bonus(f["count"], f["largest_face_frac"], f["main_face_centered"], w.face_bonus),
    })


def sub_scores(p: DataFrame, w: X.Weights = X.Weights()) -> DataFrame:
    """Adds sharpness and ``own_scores``."""
    return own_scores(midpoint_percentile(p.withColumn("__s", F.col("quality.sharpness_raw")), "__s", "sharpness").drop("__s"), w)


def score(p: DataFrame, w: X.Weights = X.Weights()) -> DataFrame:
    """``sub_scores`` and composite_score."""
    return rescore(sub_scores(p, w), w)


def rescore(p: DataFrame, w: X.Weights) -> DataFrame:
    """composite_score from stored sub-scores with other weights; nothing else changes."""
    return p.withColumn("composite_score", X.composite(*(F.col(c) for c in ("sharpness", "exposure", "resolution", "aesthetic", "face_bonus")), w))


def best_of(p: DataFrame, group: str, score: str = "composite_score", ord: str = "ord") -> DataFrame:
    """(group, best ord) of each group that is not null: highest score, earliest of equals."""
    return p.where(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(ord, F.struct(F.col(score), -F.col(ord))).alias("best"))


def mark_winners(p: DataFrame, group: str = "duplicate_group") -> DataFrame:
    """Adds is_group_winner: true for each group's best row, false elsewhere.  ``p`` is read twice: pass a written table."""
    best = best_of(p, group).select(F.col("best").alias("__b"), F.lit(True).alias("__w"))
    return p.join(best, F.col("ord") == F.col("__b"), "left").withColumn("is_group_winner", F.coalesce("__w", F.lit(False))).drop("__b", "__w")


def pre_reject(p: DataFrame) -> DataFrame:
    """Adds status: Reject where blurred, badly exposed or a group's loser, else Undecided."""
    bad = (F.col("sharpness") < X.num(0.20)) | (F.col("exposure") < X.num(0.25)) | (F.col("duplicate_group").isNotNull() & ~F.col("is_group_winner"))
    return p.withColumn("status", F.when(bad, "Reject").otherwise("Undecided"))


def override_status(p: DataFrame, chosen: DataFrame) -> DataFrame:
    """Statuses from (path, status) in place of proposed ones, for all rows of a path."""
    c = chosen.select(F.col("path").alias("__p"), F.col("status").alias("__s"))
    return p.join(c, F.col("path") == F.col("__p"), "left").withColumn("status", F.coalesce("__s", "status")).drop("__p", "__s")


def keep_for_processing(queue: DataFrame, analysed: DataFrame | None, with_undecided: bool = True) -> DataFrame:
    """Queue rows to process: all without an analysis, else those kept (or undecided)."""
    if analysed is None:
        return queue
    good = ["Keep", "Undecided"] if with_undecided else ["Keep"]
    return queue.join(analysed.where(F.col("status").isin(good)).select("path").distinct(), "path", "left_semi")


def recommend(p: DataFrame, nets: DataFrame) -> DataFrame:
    """(network_id, ord, path, composite_score, fit, recommendation) of every photo for every format in ``nets`` (a handful of rows)."""
    n = F.broadcast(nets.select(F.col("id").alias("network_id"), "aspect_ratio", "suggested_width", "suggested_height"))
    fit = X.format_fit(F.col("width"), F.col("height"), F.col("aspect_ratio"), F.col("suggested_width"), F.col("suggested_height"))
    both = p.crossJoin(n).withColumn("fit", fit).withColumn("recommendation", X.recommendation(F.col("fit"), F.col("composite_score")))
    return both.select("network_id", "ord", "path", "composite_score", "fit", "recommendation")


def top_n(r: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each format by recommendation, then order, with their rank."""
    w = Window.partitionBy("network_id").orderBy(F.desc("recommendation"), "ord")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recommendation_order(r: DataFrame) -> DataFrame:
    """Adds rank, from 1, of every row within its format by recommendation, then order.

    All formats are numbered in one pass over ranges, and each rank counts from
    its format's first number: a format with all rows is not one task.
    """
    ws = Workspace(r.sparkSession, "recommended")
    rows = running(r, [F.col("network_id"), F.col("recommendation").desc_nulls_last(), F.col("ord")], ws, "rows")
    first = ws.write(rows.groupBy(F.col("network_id").alias("__n")).agg(F.min("__upto").alias("__from")), "first")
    return rows.join(first, F.col("network_id") == F.col("__n")).withColumn("rank", F.col("__upto") - F.col("__from") + 1).drop("__n", "__from", "__upto")


def ranked(p: DataFrame, score: str = "composite_score", ord: str = "ord", carry: str | None = None) -> DataFrame:
    """Adds rank, from 1, of every row by score (highest first, nulls last), then order; and with ``carry`` previous: that column in the row before.

    Rows are numbered within ranges of (score, ord), so no task sorts all of
    them, and a score that many rows share is split by order.
    """
    ws = Workspace(p.sparkSession, "ranks")
    out = running(p, [F.col(score).desc_nulls_last(), F.col(ord)], ws, "ranked", carry=carry).withColumnRenamed("__upto", "rank")
    return out.withColumnRenamed("__previous", "previous") if carry else out
