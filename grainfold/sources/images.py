"""Folders of pictures as tables, and the measuring stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.functions import jpeg, pixels
from grainfold.operators.geometry import IMAGES, RAWS, VIDEOS, is_kind
from grainfold.sources.catalog import MEASURE
from grainfold.sources.folders import listing, read_file

#: Decoders by file kind, tried on the content. Others are registered where a codec is at hand.
DECODERS: dict[bytes, Callable] = {b"\x89PNG": pixels.read_png, b"\xff\xd8\xff": jpeg.read_jpeg}


def register_decoder(magic: bytes, decode: Callable) -> None:
    """``decode(bytes) -> array`` for files that begin with ``magic``.  On a cluster, call it in a module that workers import."""
    DECODERS[magic] = decode


def shown(content: bytes, path: str) -> bytes:
    """The picture file itself: a raw file's embedded preview, else the content; ValueError where the kind is unknown."""
    ext = path.rpartition(".")[2].lower()
    if ext in RAWS:
        return pixels.raw_preview(content)
    if ext not in IMAGES:
        raise ValueError(f"unsupported format: {ext}")
    return content


def decode(content: bytes, path: str):
    """The upright picture; ValueError where the file is of an unknown kind or broken."""
    content = shown(content, path)
    for magic, read in DECODERS.items():
        if content.startswith(magic):
            return pixels.orient(read(content), pixels.exif(content).get(0x0112, 1) if magic != b"\x89PNG" else 1)
    raise ValueError(f"no decoder for {path}")


def drawn(texts: DataFrame, columns: int = 32) -> DataFrame:
    """ord, path, file_size, modified, content: each text's bytes as a gray PNG, where there are no pictures to read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            body = []
            for t in f["text"]:
                b = (t or "").encode()
                b += bytes(max(1, -(-len(b) // columns)) * columns - len(b))
                body.append(pixels.png(np.frombuffer(b, np.uint8).reshape(-1, columns)))
            yield pd.DataFrame({"ord": f["ord"], "path": [f"drawn/{i}.png" for i in f["ord"]], "file_size": [len(b) for b in body], "modified": pd.Timestamp(0, tz="UTC"), "content": body})

    return texts.select("ord", "text").mapInPandas(run, "ord long, path string, file_size long, modified timestamp, content binary")


def scan(spark: SparkSession, roots: list[str], with_content: bool = True) -> DataFrame:
    """ord, path, file_size, modified (and content) of the media files below files and folders, ordered by path.

    ``ord`` is made from the path, so that it does not depend on how files are
    listed: it orders as a hash does, the same in every run.  Without contents
    no file is opened, and tasks list the folders.
    """
    if with_content:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).withColumnsRenamed({"length": "file_size", "modificationTime": "modified"})
        df = df.dropDuplicates(["path"]) if len(roots) > 1 else df
    else:
        df = listing(spark, roots)
    df = df.where(is_kind(F.col("path"), (*IMAGES, *RAWS, *VIDEOS)))
    return df.select(F.xxhash64("path").alias("ord"), "path", "file_size", "modified", *(["content"] if with_content else []))


def measure(files: DataFrame, engines: Callable[[], dict[str, Callable]] | None = None, models_only: bool = False) -> DataFrame:
    """One row per file, as MEASURE; a file that fails has its ``error`` and no measures.

    Files without a ``content`` column are opened by the task that measures them,
    so that contents are never shuffled.  With ``models_only`` the measures that
    need no model are left null.

    ``engines`` is called once per worker process and may give ``aesthetic``
    (picture -> (mean, std_dev)), ``faces`` (picture -> (count, frac, centered))
    and ``embedding`` (picture -> list).  An engine that is missing leaves its
    columns null.  Pixels do not leave the stage.
    """

    held = "content" in files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ai = engines() if engines else {}
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                row = {"ord": r.ord, "path": r.path, "file_size": r.file_size, "modified": r.modified, "error": None}
                try:
                    content = r.content if held else read_file(r.path)
                    a = decode(content, r.path)
                    if not models_only:
                        row |= {
                            "width": a.shape[1], "height": a.shape[0], "capture_time": pixels.capture_time(shown(content, r.path)), "content_hash": hashlib.sha256(content).digest(),
                            "perceptual_hash": pixels.dhash(a), "quality": pixels.quality(a),
                        }
                    if "aesthetic" in ai:
                        row["aesthetic"] = dict(zip(("mean", "std_dev"), ai["aesthetic"](a)))
                    if "faces" in ai:
                        row["faces"] = dict(zip(("count", "largest_face_frac", "main_face_centered"), ai["faces"](a)))
                    if "embedding" in ai:
                        row["embedding"] = list(ai["embedding"](a))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            names = ["ord", "path", "file_size", "modified", "width", "height", "capture_time", "content_hash", "perceptual_hash", "quality", "aesthetic", "faces", "embedding", "error"]
            out = pd.DataFrame(rows, columns=names)
            for c in ("content_hash", "quality", "aesthetic", "faces", "embedding"):  # None, not NaN, where there is nothing
                out[c] = pd.Series([x.get(c) for x in rows], dtype=object)
            for c in ("width", "height"):
                out[c] = pd.array([x.get(c) for x in rows], "Int32")
            out["perceptual_hash"] = pd.array([x.get("perceptual_hash") for x in rows], "Int64")
            out["capture_time"] = pd.to_datetime(pd.Series([x.get("capture_time") for x in rows], dtype=object), utc=True)
            yield out

    return files.mapInPandas(run, MEASURE)


def onnx_engines(models: dict[str, str]) -> Callable[[], dict[str, Callable]]:
    """Engines from ONNX files: ``aesthetic``, ``faces``, ``embedding`` -> path; one that cannot be loaded is left out."""

    def load() -> dict[str, Callable]:
        import numpy as np
        import onnxruntime as ort

        out: dict[str, Callable] = {}

        def session(name: str):
            try:
                return ort.InferenceSession(models[name], providers=["CPUExecutionProvider"])
            except Exception:  # noqa: BLE001  a missing model is no error of the batch
                return None

        def tensor(a, side: int, channels_first: bool, mid: float, scale: float):
            x = pixels.resample(pixels.with_alpha(a)[:, :, :3], side, side, "triangle").astype(np.float32)
            x = (x - mid) / scale
            return (x.transpose(2, 0, 1) if channels_first else x)[None]

        def first(s, x):
            return np.asarray(s.run(None, {s.get_inputs()[0].name: x})[0], np.float64)

        if "aesthetic" in models and (s := session("aesthetic")):

            def rate(a, s=s):
                p = first(s, tensor(a, 224, True, 127.5, 127.5)).ravel()[:10]
                if len(p) < 10:
                    raise ValueError("rating model gives fewer than ten outputs")
                p = p / p.sum() if p.sum() > 0 else np.full(10, 0.1)
                i = np.arange(1, 11)
                mean = float(i @ p)
                return mean, float(np.sqrt(((i - mean) ** 2) @ p))

            out["aesthetic"] = rate
        if "faces" in models and (s := session("faces")):

            def boxes(a, s=s):
                x = first(s, tensor(a, 320, True, 127.5, 127.5))
                if x.shape[-1] < 5:
                    return np.empty((0, 4))
                x = x.reshape(-1, x.shape[-1])
                x = x[x[:, 4] >= 0.6]
                b = np.stack([(x[:, 0] + x[:, 2]) / 2, (x[:, 1] + x[:, 3]) / 2, abs(x[:, 2] - x[:, 0]), abs(x[:, 3] - x[:, 1])], 1)
                return b[(b[:, 2] > 0) & (b[:, 3] > 0)]

            def faces(a):
                b = boxes(a)
                if not len(b):
                    return 0, 0.0, 0.0
                cx, cy, w, h = b[len(b) - 1 - int((b[:, 2] * b[:, 3])[::-1].argmax())]
                away = float(np.hypot(cx - 0.5, cy - 0.5))
                return len(b), float(min(max(w * h, 0), 1)), float(min(max(1 - min(away / 0.707, 1), 0), 1))

            out["faces"] = faces
            if "embedding" in models and (e := session("embedding")):

                def embed(a, e=e):
                    b = boxes(a)
                    if not len(b):
                        return []
                    cx, cy, w, h = b[len(b) - 1 - int((b[:, 2] * b[:, 3])[::-1].argmax())]
                    hh, ww = a.shape[:2]
                    x0, x1 = (int(min(max((cx + d * w * 1.25 / 2) * ww, 0), ww)) for d in (-1, 1))
                    y0, y1 = (int(min(max((cy + d * h * 1.25 / 2) * hh, 0), hh)) for d in (-1, 1))
                    face = a[min(y0, hh - 1) : max(y1, min(y0, hh - 1) + 1), min(x0, ww - 1) : max(x1, min(x0, ww - 1) + 1)]
                    v = first(e, tensor(face, 112, False, 127.5, 128.0)).ravel()
                    n = float(np.sqrt(v @ v))
                    return (v / n if n > 1e-12 else v).astype(np.float32).tolist()

                out["embedding"] = embed
        return out

    return load
