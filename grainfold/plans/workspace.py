"""Intermediate tables in the folder that all executors share.

Iterative plans cut their lineage by writing a Parquet table and reading it
again.  The folder comes from ``spark.checkpoint.dir``; a machine-local folder
is used only when that is unset and the session is a local one (tests).

What was shuffled for such a table is of no use once it is written, but Spark
keeps it until the driver happens to collect its garbage, so the shuffles of a
long plan would add up on disk: they are removed with each table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which an execution removes its shuffle files when it ends.
DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Whatever is executed within removes its shuffle files when it ends.  For results that are read once: frames run anew shuffle anew."""
    before = spark.conf.get(DROPS_SHUFFLES, None)
    spark.conf.set(DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROPS_SHUFFLES)
        else:
            spark.conf.set(DROPS_SHUFFLES, before)


def shared_root(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="grainfold-")
    conf_dir = f"file://{root}"
    spark.sparkContext._conf.set("spark.checkpoint.dir", conf_dir)
    return conf_dir


def replace_file(spark: SparkSession, path: str, body: bytes) -> None:
    """Writes a small file in one step: under another name, then renamed over the old one, which readers see until then."""
    fc_type, fs = spark._jvm.org.apache.hadoop.fs.FileContext, spark._jvm.org.apache.hadoop.fs
    at, tmp = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    out = at.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(body))
    out.close()
    rename = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fc_type.getFileContext(at.toUri(), conf).rename(tmp, at, how)


class Workspace:
    """Named tables of one plan, below the shared folder; removed when the application ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/grainfold/{tag}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._jpath(self.path))

    def _jpath(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._jpath(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, with the lineage cut."""
        at = f"{self.path}/{name}"
        with dropped_shuffles(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        self._fs().delete(self._jpath(f"{self.path}/{name}"), True)
