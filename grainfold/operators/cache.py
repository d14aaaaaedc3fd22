"""The analysis cache: keys, hit tiers, upserts, and resuming a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.plans.workspace import replace_file

SCHEMA_VERSION = 1


def cache_key(path: Column, mtime_s: Column, size: Column) -> Column:
    """SHA-256 (hex) of path, whole seconds of the modification time, and size; the parts are kept apart."""
    return F.sha2(F.concat_ws("\x1f", path, mtime_s.cast("string"), size.cast("string")), 256)


def hit_tiers(now: DataFrame, cache: DataFrame, model_version: int, schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """``now`` with tier: full (schema and model as cached), partial (schema only: model fields are computed anew) or miss.

    ``cache`` has cache_key, schema_version and model_version; of several
    entries of one key the best counts.
    """
    c = cache.groupBy(F.col("cache_key").alias("__k")).agg(
        F.bool_or((F.col("schema_version") == schema_version) & (F.col("model_version") == model_version)).alias("__full"),
        F.bool_or(F.col("schema_version") == schema_version).alias("__part"),
    )
    tier = F.when(F.col("__full"), "full").when(F.col("__part"), "partial").otherwise("miss")
    return now.join(c, F.col("cache_key") == F.col("__k"), "left").withColumn("tier", tier).drop("__k", "__full", "__part")


def upsert(cache: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("cache_key", "model_version")) -> DataFrame:
    """``cache`` with ``fresh`` rows in place of those of the same keys."""
    return cache.join(fresh.select(*keys).distinct(), list(keys), "left_anti").select(cache.columns).unionByName(fresh)


class CacheTable:
    """A cache as versions of a Parquet table; readers follow a pointer that is swapped once a version is whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def read(self) -> DataFrame | None:
        v = self.current()
        return None if v is None else self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{v}")

    def put(self, fresh: DataFrame, keys: tuple[str, ...] = ("cache_key", "model_version")) -> None:
        old, v = self.read(), f"v-{uuid.uuid4().hex}"
        (fresh if old is None else upsert(old, fresh, keys)).write.parquet(f"{self.root}/{v}")
        replace_file(self.spark, f"{self.root}/CURRENT", v.encode())


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of a batch that are neither done nor failed, in order of appearance left to ``ord``."""
    return files.join(manifest.where(F.col("state").isin("ok", "error")).select("path"), "path", "left_anti")


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, (path, error) of the others)."""
    return results.where("error IS NULL"), results.where("error IS NOT NULL").select("path", "error")


def batch_metrics(results: DataFrame) -> DataFrame:
    """One row: processed, ok, failed, images, videos, percent, from (path, ok, is_video) and the number of ``results``."""
    ok, video = F.count_if("ok"), F.count_if("is_video")
    m = results.agg(F.count(F.lit(1)).alias("processed"), ok.alias("ok"), F.count_if(~F.col("ok")).alias("failed"), video.alias("v"))
    return m.select(
        "processed", "ok", "failed", F.greatest(F.col("ok") - F.col("v"), F.lit(0).cast("long")).alias("images"), F.least("v", "ok").alias("videos"),
        F.least(F.lit(100).cast("long"), F.when(F.col("processed") > 0, F.round(F.col("ok") * 100.0 / F.col("processed")).cast("long")).otherwise(0)).alias("percent_ok"),
    )


def plan_moves(photos: DataFrame, subfolder: str = "rejects") -> DataFrame:
    """(ord, path, new_path) of rejects: into ``subfolder`` beside each file; nothing is deleted, and none is moved twice."""
    parent, name = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1), F.regexp_extract("path", r"([^/\\]*)$", 1)
    moved = F.concat(F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/"))), F.lit(f"{subfolder}/"), name)
    return photos.where("status = 'Reject'").where(~parent.endswith(f"/{subfolder}")).select("ord", "path", moved.alias("new_path"))
