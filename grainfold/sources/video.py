"""Video through an external tool, where one is installed; otherwise every call says so."""

from __future__ import annotations

import json
import shutil
import subprocess

from grainfold.sources.render import Unavailable


def tool(name: str = "ffmpeg") -> str:
    if not (path := shutil.which(name)):
        raise Unavailable(f"{name} is not installed")
    return path


def probe(path: str) -> dict[str, int]:
    """duration_us (0 where unknown), width and height of the first video stream."""
    out = subprocess.run([tool("ffprobe"), "-v", "error", "-print_format", "json", "-show_streams", "-show_format", path], capture_output=True, check=True, timeout=60)
    info = json.loads(out.stdout)
    stream = next((s for s in info.get("streams", []) if s.get("codec_type") == "video"), {})
    return {"duration_us": int(float(info.get("format", {}).get("duration", 0) or 0) * 1e6), "width": int(stream.get("width", 0)), "height": int(stream.get("height", 0))}


def frame(path: str, second: float) -> bytes:
    """One frame as JPEG; times before the start count as 0."""
    return subprocess.run([tool(), "-v", "error", "-ss", str(max(second, 0.0)), "-i", path, "-frames:v", "1", "-f", "mjpeg", "-"], capture_output=True, check=True, timeout=120).stdout


def transcode(path: str, out: str, width: int, height: int, filters: str | None = None) -> None:
    """H.264 in MP4 at an even size, audio copied, header first."""
    graph = ",".join([f"scale={width}:{height}", *([filters] if filters else [])])
    subprocess.run([tool(), "-y", "-v", "error", "-i", path, "-vf", graph, "-c:v", "libx264", "-preset", "fast", "-crf", "22", "-c:a", "copy", "-movflags", "+faststart", out], check=True)
