"""Files of a watched folder as versions: modified files come again, and files that are being written are waited for."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grainfold.operators.geometry import IMAGES, RAWS, VIDEOS, is_kind
from grainfold.sources.folders import _uri, open_fs

#: Versions that one task reads.
PART_ROWS = 10_000


class Part(InputPartition):
    """Lines of one file of the log."""

    def __init__(self, log: str, first: int, last: int):
        self.log, self.first, self.last = log, first, last


class VersionReader(DataSourceStreamReader):
    """New versions (path, time, size) of the files below a folder; the offset counts the files of a log of them.

    A version is seen when a listing shows a path with another time or size than
    before.  What a listing brings is written to the log, one file, before the
    offset moves, so that a batch can be read again and a restarted stream knows
    what it has seen.  As Spark's own file source does, the driver lists the folder and remembers its
    paths: two 64-bit hashes a file.
    """

    def __init__(self, folder: str, log: str):
        self.folder, self.log = folder, log.rstrip("/")
        self.seen: dict[int, int] | None = None
        self.files = 0

    def _restore(self) -> None:
        import pyarrow.fs as pafs

        fs, at = open_fs(self.log)
        fs.create_dir(at)
        self.seen = {}
        known = {x.base_name: x.path for x in fs.get_file_info(pafs.FileSelector(at))}
        while f"{self.files:09d}.jsonl" in known:
            with fs.open_input_stream(known[f"{self.files:09d}.jsonl"], compression=None) as s:
                for line in s.read().splitlines():
                    path, t, size = json.loads(line)
                    self.seen[hash64(path)] = hash64(f"{t}/{size}")
            self.files += 1

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        import pyarrow.fs as pafs

        if self.seen is None:
            self._restore()
        fs, at = open_fs(self.folder)
        fresh = []
        for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
            if x.type == pafs.FileType.File:
                path = _uri(self.folder, at, x.path)
                key, version = hash64(path), hash64(f"{x.mtime_ns}/{x.size}")
                if self.seen.get(key) != version:
                    fresh.append((key, version, json.dumps([path, x.mtime_ns, x.size])))
        if fresh:
            fs, at = open_fs(self.log)
            tmp = f"{at}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(tmp, compression=None) as s:
                s.write("\n".join(f[2] for f in fresh).encode())
            fs.move(tmp, f"{at}/{self.files:09d}.jsonl")
            self.files += 1
            self.seen.update({k: v for k, v, _ in fresh})
        return {"files": self.files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for k in range(start["files"], end["files"]):
            log = f"{self.log}/{k:09d}.jsonl"
            n = len(_lines(log))
            out += [Part(log, a, min(a + PART_ROWS, n)) for a in range(0, n, PART_ROWS)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        import datetime

        for line in _lines(partition.log)[partition.first : partition.last]:
            path, t, size = json.loads(line)
            yield path, size, datetime.datetime.fromtimestamp(t / 1e9, datetime.timezone.utc)


def hash64(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _lines(log: str) -> list[bytes]:
    fs, at = open_fs(log)
    with fs.open_input_stream(at, compression=None) as s:
        return s.read().splitlines()


class VersionSource(DataSource):
    """A stream of path, file_size, modified; options folder and log."""

    @classmethod
    def name(cls) -> str:
        return "media_versions"

    def schema(self) -> str:
        return "path string, file_size long, modified timestamp"

    def streamReader(self, schema) -> VersionReader:
        return VersionReader(self.options["folder"], self.options["log"])


def versions(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """A stream of the versions of media files below ``folder``: path, file_size, modified.

    A file that is written again under its path comes again, also after a restart
    from the checkpoint.  ``log`` is a folder of this stream alone, outside ``folder``, that
    goes with its checkpoint.  Files that vanish bring nothing; empty files come too.
    """
    spark.dataSource.register(VersionSource)
    df = spark.readStream.format("media_versions").option("folder", folder).option("log", log).load()
    return df.where(is_kind(F.col("path"), (*IMAGES, *RAWS, *VIDEOS)))


def whole_files(stream: DataFrame, quiet_s: float = 1.0, most_s: float = 5.0) -> DataFrame:
    """path, file_size, modified, stable: each file of ``versions`` once it has not changed for ``quiet_s`` seconds.

    A file that goes on changing comes after ``most_s`` seconds with ``stable``
    false, as does one that is still empty then.  State is held for waiting
    files alone: it goes when a file comes, and a later change starts anew.
    Times are those of processing, so waits end with the next batch at the earliest.
    """
    held = "file_size long, modified timestamp, since double, changed double"

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = time.time()
        if state.hasTimedOut:
            size, modified, since, changed = state.get
        else:
            since = state.get[2] if state.exists else now
            rows = pd.concat(frames)
            last = rows.loc[rows["modified"].idxmax()]
            size, modified, changed = int(last["file_size"]), last["modified"].to_pydatetime(), now
        stable = size > 0 and now - changed >= quiet_s
        if stable or now - since >= most_s:  # also where news come in every batch, as then no wait ends
            if state.exists:
                state.remove()
            yield pd.DataFrame({"path": [key[0]], "file_size": [size], "modified": [modified], "stable": [bool(stable)]})
            return
        if not state.hasTimedOut:
            state.update((size, modified, since, changed))
        ends = since + most_s if size == 0 else min(changed + quiet_s, since + most_s)
        state.setTimeoutDuration(max(int((ends - now) * 1000), 1))

    out = "path string, file_size long, modified timestamp, stable boolean"
    return stream.groupBy("path").applyInPandasWithState(wait, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout)
