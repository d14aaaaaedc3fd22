"""Thumbnails kept by content key, up to a size: the least recently used go first.

The kept table is a version of Parquet files that a pointer names, so readers
see a change wholly or not at all.  Keys hold path, time, size and side, so a
file that changed is made anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.cache import CacheTable, cache_key
from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace, replace_file
from grainfold.sources.render import thumbnails

KEPT = "key string, path string, thumb string, bytes long, used long"
#: Most bytes of thumbnails kept, unless told otherwise.
CAPACITY = 4 << 30


class Thumbnails:
    """The kept thumbnails below ``root``; one writer at a time.

    ``make`` gives (path, thumb) of (path, modified, file_size): the thumbnail, or
    null where there is none to be had.  A null is kept too, so that a broken file
    is not tried again until it changes.
    """

    def __init__(self, spark: SparkSession, root: str, side: int = 256, capacity: int = CAPACITY, make: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.side, self.capacity = spark, root.rstrip("/"), side, capacity
        self.make = make or (lambda files: thumbnails(files, side))
        self.table = CacheTable(spark, root)

    def kept(self) -> DataFrame:
        """key, path, thumb, bytes, used of what is kept."""
        got = self.table.read()
        return self.spark.createDataFrame([], KEPT) if got is None else got

    def get(self, files: DataFrame, now: int) -> DataFrame:
        """(path, thumb, hit) of files (path, modified, file_size), which count as used at ``now`` (any number that grows).

        Those that are kept are not opened.  The others are made, and join the
        kept ones as far as the capacity goes, which never changes what is
        returned.  Repeated files come back once; of a null path nothing does.
        """
        ws = Workspace(self.spark, "thumbs")
        key = cache_key(F.col("path"), F.unix_seconds("modified"), F.col("file_size"))
        keyed = files.where("path IS NOT NULL").select("path", "modified", "file_size", F.concat_ws("-", key, F.lit(self.side)).alias("key"))
        asked = ws.write(keyed.dropDuplicates(["key"]), "asked")
        old = self.kept()
        hits = asked.select("key").join(old, "key").select("key", "path", "thumb", "bytes", F.lit(now).cast("long").alias("used"), F.lit(True).alias("hit"))
        lacking = asked.join(old.select("key"), "key", "left_anti")
        made = self.make(lacking.select("path", "modified", "file_size")).join(lacking.select("path", "key"), "path")
        size = F.length(F.coalesce("thumb", F.lit(""))).cast("long") + F.length("key")
        fresh = made.select("key", "path", "thumb", size.alias("bytes"), F.lit(now).cast("long").alias("used"), F.lit(False).alias("hit"))
        got = ws.write(hits.unionAll(fresh), "got")
        rest = old.join(got.select("key"), "key", "left_anti")
        self._keep(rest.unionByName(got.drop("hit")), ws)
        return got.select("path", "thumb", "hit")

    def _keep(self, rows: DataFrame, ws: Workspace) -> None:
        """Keeps the last used rows whose sizes add up to the capacity at most, and removes the version before."""
        upto = running(rows, [F.col("used").desc(), F.col("key")], ws, "sizes", "bytes")
        old, v = self.table.current(), f"v-{uuid.uuid4().hex}"
        upto.where(F.col("__upto") <= self.capacity).drop("__upto").write.parquet(f"{self.root}/{v}")
        replace_file(self.spark, f"{self.root}/CURRENT", v.encode())
        if old:
            self._remove(old)

    def _remove(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> int:
        """Forgets all that is kept, and says how many thumbnails that were; nulls do not count."""
        old = self.table.current()
        if old is None:
            return 0
        n = self.kept().where("thumb IS NOT NULL").count()
        self._remove("CURRENT")
        self._remove(old)
        return n
