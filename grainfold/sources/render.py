"""Rendering and writing pictures: resize, adjust, logos, texts, encode, crops, files."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import jpeg, pixels
from grainfold.operators import geometry
from grainfold.plans.workspace import Workspace
from grainfold.sources.images import decode

RESULT = "path string, crop_id string, out_path string, width int, height int, bytes binary, ok boolean, error string"
#: Encoders by output format; WebP and text need libraries that are registered where they are at hand.
ENCODERS: dict[str, Callable] = {"Png": lambda a, quality: pixels.png(a), "Jpeg": jpeg.jpeg}
RASTER: dict[str, Callable] = {}


class Unavailable(RuntimeError):
    """A codec or font engine that is not installed here."""


def register_encoder(fmt: str, encode: Callable) -> None:
    """``encode(array, quality) -> bytes`` for an output format."""
    ENCODERS[fmt] = encode


def register_text_raster(draw: Callable) -> None:
    """``draw(text, pixel_size, rgba) -> RGBA array`` for text marks."""
    RASTER["text"] = draw


def encode(a, fmt: str, quality: int) -> bytes:
    if fmt not in ENCODERS:
        raise Unavailable(f"no encoder for {fmt} is installed")
    if fmt == "Jpeg" and a.ndim == 3:
        a = a[:, :, :3]
    return ENCODERS[fmt](a, min(max(quality, 0), 100))


def _target(w: int, h: int, r: geometry.Resize) -> tuple[int, int]:
    """``geometry.target_size`` for one picture."""
    px = lambda v: max(int(pixels.half_up(v)), 1)
    want_w, want_h = max(r.width or w, 1), max(r.height or h, 1)
    if r.mode == "Percentage":
        p = max(1.0 if r.percentage is None else r.percentage, 0.0)
        tw, th = px(w * p), px(h * p)
    elif r.mode == "Exact" and not r.keep_aspect_ratio:
        tw, th = want_w, want_h
    else:
        k = min(want_w / w, want_h / h)
        tw, th = px(w * k), px(h * k)
    if not r.allow_upscale and (tw > w or th > h):
        k = min(w / tw, h / th)
        tw, th = px(tw * k), px(th * k)
    return tw, th


def compose(a, p: geometry.Preset, logos: dict[str, object], name: str | None = None):
    """A picture through resize, adjustment, logos in order, and texts in order."""
    a = pixels.resample(a, *_target(a.shape[1], a.shape[0], p.resize))
    d = p.adjust
    a = pixels.adjust(a, d.brightness, d.contrast, d.saturation, d.temperature)
    for spec in p.logos:
        if spec.id not in logos:
            raise KeyError(f"logo not found: {spec.id}")
        a = pixels.compose_logo(a, logos[spec.id], spec)
    for t in p.texts:
        if t.text.strip():
            a = _text(a, t, name)
    return a


def _text(a, t: geometry.TextMark, name: str | None):
    if "text" not in RASTER:
        raise Unavailable("no text engine is installed")
    from datetime import datetime, timezone

    text = t.text.replace("{date}", datetime.now(timezone.utc).strftime("%Y-%m-%d"))
    text = text if name is None else text.replace("{filename}", name)
    base = pixels.with_alpha(a)
    h, w = base.shape[:2]
    size = max(8.0, w * min(max(t.font_size, 0.005), 0.5))
    mark = RASTER["text"](text, size, t.rgba)
    x = int(max(min(pixels.half_up(w * min(max(t.x, 0.0), 1.0) - mark.shape[1] / 2), w - mark.shape[1]), 0))
    y = int(max(min(pixels.half_up(h * min(max(t.y, 0.0), 1.0) - mark.shape[0] / 2), h - mark.shape[0]), 0))
    if t.background_rgba:
        pad = int(pixels.half_up(size * max(t.background_padding, 0.0)))
        import numpy as np

        box = np.broadcast_to(np.array(t.background_rgba, np.uint8), (mark.shape[0] + 2 * pad, mark.shape[1] + 2 * pad, 4))
        base = pixels.blend(base, box, x - pad, y - pad)
    return pixels.blend(base, mark, x, y, t.opacity)


TAKEN = "several outputs have this path"


def _clashes(files: DataFrame, outs: list[Column]) -> DataFrame:
    """(path, taken): the output paths of each file that other outputs have too; made of paths alone, and written."""
    ws = Workspace(files.sparkSession, "render")
    each = files.select(F.col("path").alias("__path"), F.explode(F.array(*outs)).alias("__out"))
    twice = ws.write(each.groupBy("__out").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__out"), "twice")
    return ws.write(each.join(twice, "__out").groupBy("__path").agg(F.collect_set("__out").alias("taken")), "taken")


def render(files: DataFrame, p: geometry.Preset, logos: dict[str, bytes] | None = None) -> DataFrame:
    """RESULT rows of (path, content): the principal file and one per crop, all from one decode.

    Logos (their files) are few and travel once.  A file that fails gives one
    row with ``ok`` false; the others go on.  Outputs that would share a path
    are errors, all of them, and nothing is overwritten.  Which they are is found
    from paths; contents are shuffled only where that list is too long to broadcast.
    """
    shared = files.sparkSession.sparkContext.broadcast(logos or {})
    outs = [geometry.output_path(F.col("path"), p.output), *[geometry.output_path(F.col("path"), p.output, F.lit(c.id)) for c in p.crops]]
    cols = [o.alias("main" if k == 0 else f"crop_{k - 1}") for k, o in enumerate(outs)]
    files = files.join(_clashes(files, outs), F.col("path") == F.col("__path"), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {k: decode(v, f"{k}.png") for k, v in shared.value.items()}
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                taken = set() if r["taken"] is None else set(r["taken"])
                try:
                    name = r["path"].replace("\\", "/").rpartition("/")[2].rpartition(".")[0]
                    whole = compose(decode(r["content"], r["path"]), p, known, name)
                    made = [(None, r["main"], whole)]
                    made += [(c.id, r[f"crop_{k}"], pixels.center_crop(whole, c.width, c.height)) for k, c in enumerate(p.crops)]
                    for c, o, a in made:
                        if o in taken:
                            rows.append((r["path"], c, o, None, None, None, False, TAKEN))
                        else:
                            rows.append((r["path"], c, o, a.shape[1], a.shape[0], encode(a, p.output.format, p.output.quality), True, None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    rows = [x for x in rows if x[0] != r["path"]]
                    rows.append((r["path"], None, r["main"], None, None, None, False, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "crop_id", "out_path", "width", "height", "bytes", "ok", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content", "taken", *cols).mapInPandas(run, RESULT)


def write_files(rendered: DataFrame, root: str) -> DataFrame:
    """Writes rendered pictures below ``root`` (a URI all executors share) and returns (path, crop_id, out_path, ok, error), lazily.

    A file is written under another name and moved into place.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for f in frames:
            oks, errors = [], []
            for out, body, ok, error in zip(f["out_path"], f["bytes"], f["ok"], f["error"]):
                if ok:
                    try:
                        at = f"{base}/{out}"
                        fs.create_dir(at.rpartition("/")[0])
                        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
                        with fs.open_output_stream(tmp, compression=None) as s:
                            s.write(body)
                        fs.move(tmp, at)
                    except OSError as e:
                        ok, error = False, str(e)
                oks.append(bool(ok))
                errors.append(error)
            yield pd.DataFrame({"path": f["path"], "crop_id": f["crop_id"], "out_path": f["out_path"], "ok": oks, "error": errors})

    return rendered.mapInPandas(run, "path string, crop_id string, out_path string, ok boolean, error string")


def move_files(plan: DataFrame) -> DataFrame:
    """Moves the files of ``cache.plan_moves`` (URIs or local paths); (ord, path, new_path, ok, error).  Run it once, on purpose."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for f in frames:
            errors = []
            for a, b in zip(f["path"], f["new_path"]):
                try:
                    fs, src = pafs.FileSystem.from_uri(a)
                    _, dst = pafs.FileSystem.from_uri(b)
                    if fs.get_file_info(dst).type != pafs.FileType.NotFound:
                        raise FileExistsError(f"{b} is there already")
                    fs.create_dir(dst.rpartition("/")[0])
                    fs.move(src, dst)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad file must not end the batch
                    errors.append(f"{type(e).__name__}: {e}")
            yield f.assign(ok=[e is None for e in errors], error=errors)

    return plan.mapInPandas(run, "ord long, path string, new_path string, ok boolean, error string")


def data_url(content: Column, path: Column) -> Column:
    """A file as a data URL, its type by extension."""
    ext = geometry.extension(path)
    mime = F.when(ext == "png", "image/png").when(ext == "webp", "image/webp").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def thumbnails(files: DataFrame, side: int = 256) -> DataFrame:
    """(path, thumb): a data URL of each picture within ``side`` squared; null where it cannot be decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = geometry.Resize("MaxDimension", side, side)
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    a = decode(content, path)
                    out.append("data:image/png;base64," + base64.b64encode(pixels.png(pixels.resample(a, *_target(a.shape[1], a.shape[0], r)))).decode())
                except ValueError:
                    out.append(None)
            yield pd.DataFrame({"path": f["path"], "thumb": out})

    return files.select("path", "content").mapInPandas(run, "path string, thumb string")
