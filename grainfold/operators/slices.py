"""Slices of a stored ranking: ranked rows in parts of equal size, so that a view of rows a to b opens one or two of them.

Ranks run from 1 without gaps, so the part of a rank follows by division; a
small table of each part's best and worst score finds the place of a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PART = 100_000


class Ranking:
    """A ranking stored below ``root``; ``part`` rows a part."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, part: int, score: str):
        self.spark, self.root, self.schema, self.part, self.score = spark, root.rstrip("/"), schema, part, score

    @classmethod
    def store(cls, ranked: DataFrame, root: str, part: int = PART, score: str = "composite_score") -> Ranking:
        """Stores rows that have ``rank`` (from 1, unique, without gaps), highest ``score`` first and nulls last, as ``scoring.ranked`` gives them.

        A part is written by one task, as one folder; no task holds a part more
        than its share.  An empty ranking stores nothing and has empty slices.
        """
        at = F.floor((F.col("rank") - 1) / part)
        got = cls(ranked.sparkSession, root, ranked.schema, part, score)
        dealt = ranked.withColumn("__part", at).repartition("__part").sortWithinPartitions("__part", "rank")
        dealt.write.partitionBy("__part").mode("overwrite").parquet(f"{got.root}/rows")
        rows = got.spark.read.schema(StructType([*got.schema.fields, StructField("__part", LongType())])).parquet(f"{got.root}/rows")
        ends = rows.groupBy("__part").agg(F.max(score).alias("best"), F.min(score).alias("worst"), F.count(score).alias("scored"))
        ends.coalesce(1).write.mode("overwrite").parquet(f"{got.root}/ends")
        return got

    def _parts(self, numbers: list[int]) -> DataFrame:
        """The rows of some parts; those that are not there have none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [p for p in (f"{self.root}/rows/__part={k}" for k in numbers) if fs.exists(path(p))]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def slice(self, first: int, last: int) -> DataFrame:
        """Rows of rank ``first`` to ``last``, both included, in no order; ranks beyond the end have no rows, and last < first gives none.  Only their parts are opened."""
        first = max(first, 1)
        numbers = range((first - 1) // self.part, (last - 1) // self.part + 1) if last >= first else range(0)
        return self._parts(list(numbers)).where(F.col("rank").between(first, last))

    def above(self, score: float) -> int:
        """How many rows have a higher score, and so the rank before that score's first row; rows without a score are below all.

        Whole parts count by their ends; only the part that the score lies in is opened.
        """
        kind = self.schema[self.score].dataType.simpleString()
        ends = self.spark.read.schema(f"__part long, best {kind}, worst {kind}, scored long").parquet(f"{self.root}/ends")
        whole = ends.where((F.col("worst") > score)).agg(F.sum("scored")).first()[0] or 0
        split = [r[0] for r in ends.where((F.col("worst") <= score) & (F.col("best") > score)).select("__part").collect()]  # the scores fall from part to part, so there is one at most
        return whole + (self._parts(split).where(F.col(self.score) > score).count() if split else 0)
