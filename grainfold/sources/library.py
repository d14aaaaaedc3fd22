"""Small files beside a batch: presets, logos, counters, models.  All on the driver, through the file system that Spark knows."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import SparkSession

from grainfold.operators.geometry import NO_NAME, Preset
from grainfold.plans.workspace import replace_file
from grainfold.sources.presets import to_json


def sanitize(name: str, empty: str = NO_NAME) -> str:
    """Letters, digits, ``_`` and ``-``; anything else becomes ``_``."""
    return "".join(c if c.isalnum() or c in "_-" else "_" for c in name) or empty


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _write(self, name: str, body: bytes) -> None:
        replace_file(self.spark, f"{self.root}/{name}", body)

    def _read(self, name: str) -> bytes | None:
        fs, p = self._at(name)
        if not fs.exists(p):
            return None
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{name}").first()["content"])

    def _delete(self, name: str) -> bool:
        fs, p = self._at(name)
        return bool(fs.delete(p, False))

    def save_preset(self, p: Preset) -> str:
        name = f"presets/{sanitize(p.name)}.json"
        self._write(name, to_json(p).encode())
        return name

    def delete_preset(self, name: str) -> bool:
        return self._delete(f"presets/{sanitize(name)}.json")

    def add_logo(self, file_name: str, body: bytes) -> str:
        """Stores a logo and returns its id: the name, the milliseconds, the extension."""
        stem, _, ext = file_name.rpartition(".")
        logo = f"{sanitize(stem)}_{int(time.time() * 1000)}.{ext.lower()}"
        self._write(f"logos/{logo}", body)
        return logo

    def logo(self, logo_id: str) -> bytes | None:
        return self._read(f"logos/{logo_id}")

    def delete_logo(self, logo_id: str) -> bool:
        return self._delete(f"logos/{logo_id}")

    def logos(self) -> list[str]:
        fs, p = self._at("logos")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def add_metrics(self, m: dict[str, int], enabled: bool = True) -> dict[str, int]:
        """Adds counters to the stored ones, where counting is on, and returns the sums."""
        have = json.loads(self._read("metrics.json") or b"{}")
        if enabled:
            have = {k: have.get(k, 0) + m.get(k, 0) for k in {*have, *m} - {"first_seen"}} | {"first_seen": have.get("first_seen", int(time.time()))}
            self._write("metrics.json", json.dumps(have).encode())
        return have

    def clear_metrics(self) -> bool:
        return self._delete("metrics.json")

    def find_model(self, name: str, folders: list[str]) -> str | None:
        """The first folder's file of this name that exists."""
        for f in folders:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{f.rstrip('/')}/{name}")
            if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
                return f"{f.rstrip('/')}/{name}"
        return None

    def model_version(self, models: list[str]) -> int:
        """A number from the paths, sizes and times of model files; 0 without models."""
        if not models:
            return 0
        h = hashlib.sha256()
        for m in sorted(models):
            p = self.spark._jvm.org.apache.hadoop.fs.Path(m)
            s = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
            h.update(f"{m}\x1f{s.getLen()}\x1f{s.getModificationTime()}\n".encode())
        return int.from_bytes(h.digest()[:4], "little") & 0x7FFFFFFF
