"""The whole analysis of a folder: scan, cache, measure, persons, groups, scores, proposals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions.formulas import Weights
from grainfold.operators import cache, grouping, persons, scoring
from grainfold.operators.geometry import VIDEOS, is_kind
from grainfold.plans.workspace import Workspace
from grainfold.sources import images


@dataclass(frozen=True)
class Settings:
    threshold: int = grouping.THRESHOLD
    window_s: int | None = grouping.WINDOW_S
    weights: Weights = Weights()
    model_version: int = 0
    person_threshold: float = persons.SAME_PERSON


#: What the models measure.
MODELLED = ("aesthetic", "faces", "embedding")


def _key():
    return cache.cache_key(F.col("path"), F.unix_seconds("modified"), F.col("file_size"))


def _remodelled(entries: DataFrame, files: DataFrame, engines) -> DataFrame:
    """Cached rows of another model's, one a key, with what this one measures; without models that is null.  A file that fails now keeps nulls."""
    rows = entries.drop("schema_version", "model_version").dropDuplicates(["cache_key"])
    if not engines:
        return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in MODELLED})
    again = files.join(rows.select("cache_key"), "cache_key", "left_semi").repartition("cache_key").drop("cache_key")
    got = images.measure(again, engines, models_only=True).select(_key().alias("cache_key"), *MODELLED)
    return rows.drop(*MODELLED).join(got, "cache_key")


def analyze(spark: SparkSession, roots: list[str], s: Settings = Settings(), table: cache.CacheTable | None = None, engines=None) -> tuple[DataFrame, DataFrame]:
    """(photos, errors): measured (or taken from the cache), grouped, scored photos with proposals, and the files that failed.

    Videos are not analysed.  Ranks, groups and proposals are made anew for the
    whole batch; measures of files that did not change come from ``table``, all
    of them where the model is the same, those without a model where it is not.
    Only files that are to be measured are opened, each by the task that does it.
    """
    ws = Workspace(spark, "analyze")
    files = images.scan(spark, roots, with_content=False).where(~is_kind(F.col("path"), VIDEOS))
    files = ws.write(files.withColumn("cache_key", _key()), "files")
    old = table.read() if table else None
    todo, have = files, []
    if old is not None:
        entries = old.where(F.col("schema_version") == cache.SCHEMA_VERSION)
        tiers = ws.write(cache.hit_tiers(files.select("cache_key").distinct(), entries, s.model_version), "tiers")
        tier = lambda t: tiers.where(F.col("tier") == t).select("cache_key")
        have.append(entries.where(F.col("model_version") == s.model_version).join(tier("full"), "cache_key").drop("schema_version", "model_version"))
        todo = files.join(tier("miss"), "cache_key")
        have.append(ws.write(_remodelled(entries.join(tier("partial"), "cache_key"), files, engines), "partial"))
    fresh = ws.write(images.measure(todo.repartition("cache_key").drop("cache_key"), engines).withColumn("cache_key", _key()), "fresh")
    good = fresh.where("error IS NULL").drop("error")
    for part in have[1:]:
        good = good.unionByName(part, allowMissingColumns=True)
    if table:
        table.put(good.withColumn("schema_version", F.lit(cache.SCHEMA_VERSION)).withColumn("model_version", F.lit(s.model_version)))
    p = ws.write(good if not have else good.unionByName(have[0], allowMissingColumns=True), "measured")
    p = p.withColumn("capture_s", F.unix_seconds("capture_time")).withColumn("aesthetic_mean", F.col("aesthetic.mean"))
    who = persons.cluster_persons(p, s.person_threshold).select(F.col("ord").alias("__o"), "person_id")
    p = p.join(who, F.col("ord") == F.col("__o"), "left").drop("__o")
    p = grouping.add_groups(p, grouping.duplicate_groups(p, s.threshold, s.window_s))
    return scoring.pre_reject(scoring.mark_winners(scoring.score(p, s.weights))), fresh.where("error IS NOT NULL").select("path", "error")
