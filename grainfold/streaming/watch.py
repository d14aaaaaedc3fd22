"""Watched folders as streams, with progress events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from grainfold.operators.geometry import IMAGES, RAWS, VIDEOS, is_kind
from grainfold.sources.images import measure

BINARY = "path string, modificationTime timestamp, length long, content binary"
#: Spark's file source passes over files a week older than the newest one, unless told otherwise.
ANY_AGE = "36500d"


def arrivals(spark: SparkSession, folder: str, with_content: bool = True, lateness: str = "1 hour") -> DataFrame:
    """A stream of media files that appear below ``folder``: ord, path, file_size, modified (and content).

    Empty files are passed over: writers should move whole files into place.  A
    path that comes again within ``lateness`` of its arrival is dropped.  Files
    may be of any age: neither the watermark nor the source goes by their times,
    so the source remembers every path of the folder.
    """
    df = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFileAge", ANY_AGE).load(folder)
    df = df.where(is_kind(F.col("path"), (*IMAGES, *RAWS, *VIDEOS)) & (F.col("length") > 0))
    cols = [F.xxhash64("path").alias("ord"), "path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")]
    df = df.select(*cols, *(["content"] if with_content else []))
    df = df.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", lateness)
    return df.dropDuplicatesWithinWatermark(["path"]).drop("arrived")


def process_arrivals(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls ``each(batch, id)`` for every micro-batch; ``once`` takes what is there and stops.

    What was done is kept in ``checkpoint``, so a restart goes on where it ended;
    ``each`` should be safe to repeat for one id.
    """
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def measure_to(table: str) -> Callable[[DataFrame, int], None]:
    """A batch function that measures photos into a Parquet folder per batch, and so may be repeated."""

    def each(batch: DataFrame, batch_id: int) -> None:
        measure(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return each


class Progress(StreamingQueryListener):
    """Keeps the row counts of micro-batches, and how streams ended."""

    def __init__(self):
        self.rows: list[tuple[int, int]] = []
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.append((event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)


def event_rates(spark: SparkSession, path: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """A stream of arrival counts by type and time window, over event files with ts and event_type."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over what is there, and returns its full result, as written to ``table``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/{batch_id}")

    q = stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{table}/{last}")

