"""Committed outputs of batches: staged files, a manifest, cancelling, progress, and moves that can be repeated.

A part of a batch is written in two steps.  A data source's tasks write files
below a folder of their own attempt, with a list of them; the commit names the
attempts that count.  A job then moves those files to their places and writes
the manifest's rows, in tasks, and may be repeated at any point: what is placed
already is found to be so.  Before the commit nothing shows, and an abort
removes what was staged.

Below ``root``: ``_staging/<part>``, ``_commits/<part>.json``, ``_manifest/part=<part>`` and the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from grainfold.operators import cache
from grainfold.operators.geometry import VIDEOS, is_kind
from grainfold.plans.workspace import Workspace
from grainfold.sources.folders import open_fs
from grainfold.sources.render import TAKEN

MANIFEST = "path string, crop_id string, out_path string, state string, error string, size long"
_LISTED = "path string, crop_id string, out_path string, ok boolean, error string, size long, staged string"
#: Rows that an attempt's list holds in memory before it is written to a file.
LIST_ROWS = 50_000


@dataclass
class Staged(WriterCommitMessage):
    """The folder of one task's attempt."""

    folder: str


class StagingWriter(DataSourceWriter):
    """Writes ``bytes`` as files of an attempt's folder, and commits by one small file that names the attempts."""

    def __init__(self, root: str, part: str):
        self.root, self.part = root.rstrip("/"), part

    def write(self, rows: Iterator[Row]) -> Staged:
        import pyarrow as pa
        import pyarrow.parquet as pq

        folder = f"{self.root}/_staging/{self.part}/{uuid.uuid4().hex}"
        fs, at = open_fs(folder)
        fs.create_dir(f"{at}/list")
        listed, lists = [], 0

        def flush() -> None:
            nonlocal listed, lists
            names = [c.split()[0] for c in _LISTED.split(", ")]
            types = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
            schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, _LISTED.split(", "))])
            pq.write_table(pa.Table.from_pylist([dict(zip(names, r)) for r in listed], schema), f"{at}/list/{lists}.parquet", filesystem=fs)
            listed, lists = [], lists + 1

        for k, r in enumerate(rows):
            staged, size = None, None
            if r["ok"]:
                staged, size = f"{folder}/{k}", len(r["bytes"])
                with fs.open_output_stream(f"{at}/{k}", compression=None) as s:
                    s.write(bytes(r["bytes"]))
            listed.append((r["path"], r["crop_id"], r["out_path"], bool(r["ok"]), r["error"], size, staged))
            if len(listed) >= LIST_ROWS:
                flush()
        flush()
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, at = open_fs(f"{self.root}/_commits")
        fs.create_dir(at)
        tmp = f"{at}/{self.part}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(tmp, compression=None) as s:
            s.write(json.dumps([m.folder for m in messages if m is not None]).encode())
        fs.move(tmp, f"{at}/{self.part}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        remove(f"{self.root}/_staging/{self.part}")


class StagedFiles(DataSource):
    """A sink of rendered pictures (``render.RESULT``); options root and part."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["root"], self.options["part"])


def remove(folder: str) -> None:
    """Removes a folder, if it is there."""
    import pyarrow.fs as pafs

    fs, at = open_fs(folder)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)


def place(src: str, dst: str, size: int | None = None) -> str | None:
    """Moves a file, by copying where it cannot be renamed; the error, or None.  Safe to repeat after any interruption.

    Where ``dst`` is whole and ``src`` gone, it was done before; where both are,
    ``src`` takes the place of ``dst``.
    """
    import pyarrow.fs as pafs

    try:
        (fs, a), (to, b) = open_fs(src), open_fs(dst)
        have, there = fs.get_file_info(a), to.get_file_info(b)
        if have.type == pafs.FileType.NotFound:
            if there.type == pafs.FileType.File and (size is None or there.size == size):
                return None
            raise FileNotFoundError(f"{src} is not there")
        to.create_dir(b.rpartition("/")[0])
        try:
            fs.move(a, b)
        except OSError:
            if fs.get_file_info(a).type == pafs.FileType.NotFound:  # another attempt was quicker
                return place(src, dst, size) if size is not None else None
            tmp = f"{b}.{uuid.uuid4().hex}.tmp"
            pafs.copy_files(a, tmp, source_filesystem=fs, destination_filesystem=to)
            to.move(tmp, b)
            fs.delete_file(a)
    except Exception as e:  # noqa: BLE001  one bad file must not end the batch
        return f"{type(e).__name__}: {e}"
    return None


def _exists(folder: str) -> bool:
    import pyarrow.fs as pafs

    fs, at = open_fs(folder)
    return fs.get_file_info(at).type != pafs.FileType.NotFound


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """MANIFEST rows of all placed parts below ``root``, with part; none where there are none."""
    at = f"{root.rstrip('/')}/_manifest"
    if not _exists(at):
        return spark.createDataFrame([], f"{MANIFEST}, part string")
    return spark.read.schema(f"{MANIFEST}, part string").parquet(at)


def stage(rendered: DataFrame, root: str, part: str) -> None:
    """Writes ``render.RESULT`` rows as one part and commits it; a part that is committed is left as it is.

    A failing job leaves no file.  ``part`` is a name without slashes; null
    paths are kept as rows, and rows whose ``ok`` is not true write no file.
    """
    if _exists(f"{root.rstrip('/')}/_commits/{part}.json"):
        return
    remove(f"{root.rstrip('/')}/_staging/{part}")  # of a driver that was lost
    rendered.sparkSession.dataSource.register(StagedFiles)
    cols = ("path", "crop_id", "out_path", "bytes", "ok", "error")
    rendered.select(*cols).write.format("staged_files").option("root", root).option("part", part).mode("append").save()


def publish(spark: SparkSession, root: str, part: str) -> DataFrame:
    """Moves the files of a committed part to their places, writes its manifest, and returns its rows.  May be repeated.

    Rows of the part that share an output, and rows whose output the manifest
    has as another source's, are errors; their files are not placed.
    """
    root = root.rstrip("/")
    at = f"{root}/_manifest/part={part}"
    if not _exists(f"{at}/_SUCCESS"):
        fs, commit = open_fs(f"{root}/_commits/{part}.json")
        with fs.open_input_stream(commit) as s:
            folders = json.loads(s.read())
        lists = [f"{f}/list" for f in folders]
        listed = spark.read.schema(_LISTED).parquet(*lists) if lists else spark.createDataFrame([], _LISTED)
        ok = listed.where("ok")
        source = lambda d: F.xxhash64(d["path"], F.coalesce(d["crop_id"], F.lit("")))
        twice = ok.groupBy("out_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("out_path")
        old = manifest(spark, root).where((F.col("state") == "ok") & (F.col("part") != part))
        others = ok.select("out_path", source(ok).alias("s")).join(old.select("out_path", source(old).alias("o")), "out_path").where("s != o").select("out_path")
        taken = Workspace(spark, "outputs").write(twice.unionAll(others).distinct().withColumnRenamed("out_path", "__taken"), "taken")
        rows = listed.join(taken, F.col("out_path") == F.col("__taken"), "left")
        rows = rows.withColumn("clash", F.col("__taken").isNotNull() & F.col("ok")).drop("__taken")

        def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                states, errors = [], []
                for r in f.itertuples():
                    error = r.error if not r.ok else TAKEN if r.clash else place(r.staged, f"{root}/{r.out_path}", int(r.size))
                    states.append("ok" if r.ok and error is None else "error")
                    errors.append(error)
                yield f[["path", "crop_id", "out_path"]].assign(state=states, error=errors, size=f["size"].astype("Int64"))

        rows.mapInPandas(move, MANIFEST).write.mode("overwrite").parquet(at)
        remove(f"{root}/_staging/{part}")
    return spark.read.schema(MANIFEST).parquet(at)


def recover(spark: SparkSession, root: str) -> list[str]:
    """Publishes the parts that were committed and not placed, and returns their names; what was never committed is removed."""
    import pyarrow.fs as pafs

    root = root.rstrip("/")

    def names(d: str) -> list[str]:
        fs, at = open_fs(f"{root}/{d}")
        return [x.base_name for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))]

    committed = sorted(n[: -len(".json")] for n in names("_commits") if n.endswith(".json"))
    open_parts = [p for p in committed if not _exists(f"{root}/_manifest/part={p}/_SUCCESS")]
    for p in open_parts:
        publish(spark, root, p)
    for p in names("_staging"):
        remove(f"{root}/_staging/{p}")
    return open_parts


#: Kinds of a batch's events.
EVENTS = ("batch_started", "batch_resumed", "progress", "file_done", "file_failed", "batch_cancelled", "batch_done")


class Batch:
    """A batch of files through ``make`` (files to ``render.RESULT`` rows) into ``root``, in parts, with events; it can be cancelled and resumed.

    A part holds about ``part_files`` files, chosen by a hash of the path.  Files
    that the manifest below ``root`` has as done or failed are passed over, so
    running a batch again goes on where it ended.  ``cancel`` may be called from another thread: it
    ends the running jobs, which leaves committed parts and removes the others'
    files.  One batch at a time may run on a root.  Every run has its own id in the events and in the names of its parts.
    """

    def __init__(self, spark: SparkSession, root: str, make: Callable[[DataFrame], DataFrame], part_files: int = 100_000):
        self.spark, self.root, self.make, self.part_files = spark, root.rstrip("/"), make, part_files
        self.run_id = uuid.uuid4().hex[:12]
        self.tag = f"batch-{self.run_id}"
        self.cancelled = False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, files: DataFrame) -> str:
        """Processes ``files`` (path and what ``make`` needs; a path once), and returns "done" or "cancelled"."""
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            recover(self.spark, self.root)
            before = manifest(self.spark, self.root)
            todo = cache.pending(files, before)
            n, resumed = todo.count(), not before.isEmpty()
            parts = max(1, -(-n // self.part_files))
            self._say([("batch_resumed" if resumed else "batch_started", None, 0, n, None)])
            done = 0
            for k in range(parts):
                if self.cancelled:
                    break
                some = todo.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k)
                name = f"{self.run_id}-{k:06d}"
                stage(self.make(some), self.root, name)
                rows = publish(self.spark, self.root, name)
                done += rows.select("path").distinct().count()
                self._say([("progress", None, done, n, None)])
        except Exception:
            if not self.cancelled:
                raise
        finally:
            sc.removeJobTag(self.tag)
        if self.cancelled:
            recover(self.spark, self.root)
        self._say([("batch_cancelled" if self.cancelled else "batch_done", None, None, None, None)])
        return "cancelled" if self.cancelled else "done"

    _SAID = "kind string, path string, done long, total long, error string"

    def _say(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame(rows, self._SAID).withColumns({"run_id": F.lit(self.run_id), "at": F.current_timestamp()})
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/_events")


def events(spark: SparkSession, root: str) -> DataFrame:
    """kind (one of EVENTS), run_id, path, is_video, done, total, error, at: what batches below ``root`` said, and an event a file, from the manifest.

    A file is done if all its outputs are, else failed, with one of its errors.
    """
    at = f"{root.rstrip('/')}/_events"
    said = f"{Batch._SAID}, run_id string, at timestamp"
    told = spark.read.schema(said).parquet(at) if _exists(at) else spark.createDataFrame([], said)
    m = manifest(spark, root).withColumn("run_id", F.substring_index("part", "-", 1))
    each = m.groupBy("run_id", "path").agg(F.max("error").alias("error"), F.bool_and(F.col("state") == "ok").alias("ok"))
    none = lambda t: F.lit(None).cast(t)
    files = each.select(F.when(F.col("ok"), "file_done").otherwise("file_failed").alias("kind"), "path", none("long").alias("done"), none("long").alias("total"), "error", "run_id", none("timestamp").alias("at"))
    return told.unionByName(files).withColumn("is_video", F.when(F.col("path").isNotNull(), is_kind(F.col("path"), VIDEOS)))


def move_rejects(photos: DataFrame, log: str, subfolder: str = "rejects") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(photos with the paths of moved ones rewritten, log rows, report): moves the rejects beside their folders.

    ``log`` is a folder of this move alone.  Intents are written first, then the
    files are moved in tasks (copied and removed where they cannot be renamed), then what came of it; calling it again with
    the same ``log`` after an interruption ends in the same state.  A target that is there before the intent is an error, as are rejects
    that share a target.  Log: (ord, path, new_path, error).  Report: considered, moved, failed; rejects that
    are in ``subfolder`` already are considered and neither moved nor failed.  Photos without a path stay.
    """
    spark, log = photos.sparkSession, log.rstrip("/")
    intents, done = f"{log}/intent", f"{log}/done"
    if not _exists(f"{intents}/_SUCCESS"):
        plan = cache.plan_moves(photos, subfolder).where("path IS NOT NULL")
        each = plan.groupBy("new_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("new_path").alias("__twice"))
        each = Workspace(spark, "moves").write(each, "twice")
        plan = plan.join(each, F.col("new_path") == F.col("__twice"), "left").select("ord", "path", "new_path", F.when(F.col("__twice").isNotNull(), TAKEN).alias("error"))

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(error=[e if e is not None else f"FileExistsError: {b} is there already" if _exists(b) else None for e, b in zip(f["error"], f["new_path"])])

        plan.mapInPandas(look, "ord long, path string, new_path string, error string").write.mode("overwrite").parquet(intents)
    if not _exists(f"{done}/_SUCCESS"):

        def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(error=[e if e is not None else place(a, b) for e, a, b in zip(f["error"], f["path"], f["new_path"])])

        spark.read.parquet(intents).mapInPandas(move, "ord long, path string, new_path string, error string").write.mode("overwrite").parquet(done)
    out = spark.read.schema("ord long, path string, new_path string, error string").parquet(done)
    moved = out.where("error IS NULL").select(F.col("ord").alias("__o"), "new_path")
    rewritten = photos.join(moved, F.col("ord") == F.col("__o"), "left").withColumn("path", F.coalesce("new_path", "path")).drop("__o", "new_path")
    counts = out.agg(F.count_if(F.col("error").isNull()).alias("moved"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    report = photos.agg(F.count_if(F.col("status") == "Reject").alias("considered")).join(counts)
    return rewritten, out, report
