"""Folders of files as a data source: listed by tasks, a part of the tree each, without opening a file."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

#: The driver looks into folders, level by level, until it has so many parts to deal out or has gone so deep.
PARTS, DEPTH = 64, 3


def open_fs(path: str):
    """(file system, path in it) of a URI or local path."""
    import pyarrow.fs as pafs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def read_file(path: str) -> bytes:
    """The whole content of a URI or local path."""
    fs, at = open_fs(path)
    with fs.open_input_stream(at, compression=None) as s:
        return s.read()


class Tree(InputPartition):
    """A folder, with or without what lies in folders below it; or one file."""

    def __init__(self, uri: str, deep: bool):
        self.uri, self.deep = uri, deep


class FolderReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots, self.tests = roots, []

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of path, time and size are tested while listing; others are left to Spark."""
        ops = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__", StringStartsWith: "startswith"}
        for f in filters:
            if type(f) in ops and f.attribute[0] in ("path", "modified", "file_size") and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], ops[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Tree]:
        import pyarrow.fs as pafs

        level, out = list(dict.fromkeys(self.roots)), []
        for _ in range(DEPTH):
            if not level or len(level) + len(out) >= PARTS:
                break
            below = []
            for uri in level:
                fs, at = open_fs(uri)
                out.append(Tree(uri, False))
                if fs.get_file_info(at).type == pafs.FileType.Directory:
                    below += [_uri(uri, at, x.path) for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.Directory]
            level = below
        return [*out, *(Tree(u, True) for u in level)] or [Tree("", False)]

    def read(self, tree: Tree) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        if not tree.uri:
            return
        fs, at = open_fs(tree.uri)
        own = fs.get_file_info(at)
        found = [own] if own.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=tree.deep))
        for x in found:
            row = {"path": _uri(tree.uri, at, x.path), "file_size": x.size, "modified": x.mtime}
            if x.type == pafs.FileType.File and all(getattr(row[c], op)(v) for c, op, v in self.tests):
                yield tuple(row.values())


def _uri(root: str, at: str, path: str) -> str:
    """``path`` of a file system as a URI of the form that Spark's file sources give."""
    if root.startswith(("file:", "/")):
        return f"file:{path}"
    return root[: len(root.rstrip("/")) - len(at.rstrip("/"))] + path if root.rstrip("/").endswith(at.rstrip("/")) else path


class FolderSource(DataSource):
    """path, file_size, modified of the files below ``roots`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "media_folders"

    def schema(self) -> str:
        return "path string, file_size long, modified timestamp"

    def reader(self, schema) -> FolderReader:
        return FolderReader(json.loads(self.options["roots"]))


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, file_size, modified of every file below ``roots`` (files, folders; each file once).

    Tasks list a part of the tree each, and only names, sizes and times are read.
    A root that does not exist ends in an error; an empty list gives no rows.
    """
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("media_folders").option("roots", json.dumps(list(roots))).load()
    return df.dropDuplicates(["path"]) if len(roots) > 1 else df
