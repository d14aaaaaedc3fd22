"""Selections of photos: toggling, sending to the queue, merging results, and zipping by order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggle(selected: Column, path: Column) -> Column:
    """A list of paths with one path added if it was not there, removed if it was."""
    return F.when(F.array_contains(selected, path), F.array_except(selected, F.array(path))).otherwise(F.array_union(selected, F.array(path)))


def to_queue(queue: DataFrame, selection: DataFrame) -> DataFrame:
    """Queue rows whose path is selected; the whole queue where nothing is selected."""
    if selection.isEmpty():
        return queue
    return queue.join(selection.select("path").distinct(), "path", "left_semi")


def done_paths(completed: DataFrame, failed: DataFrame) -> DataFrame:
    """The union of two sets of paths."""
    return completed.select("path").union(failed.select("path")).distinct()


def merge_results(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and fresh rows together; a column that one side lacks is null there."""
    return cached.unionByName(fresh, allowMissingColumns=True)


def zip_by_order(left: DataFrame, right: DataFrame, ord: str = "ord") -> DataFrame:
    """Rows of two tables side by side where their order number is equal; unmatched left rows stay."""
    r = right.withColumnRenamed(ord, "__o")
    return left.join(r, left[ord] == F.col("__o"), "left").drop("__o")


def counts(photos: DataFrame) -> DataFrame:
    """One row: photos, rejects, groups, grouped photos."""
    return photos.agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(F.col("status") == "Reject").alias("rejects"),
        F.count_distinct("duplicate_group").alias("groups"), F.count("duplicate_group").alias("grouped"),
    )


def preview_key(path: Column, mtime_s: Column, size: Column) -> Column:
    return F.concat_ws("|", path, mtime_s.cast("string"), size.cast("string"))
