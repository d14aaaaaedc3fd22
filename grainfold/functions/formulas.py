"""Scoring formulas as column expressions; every constant is an explicit double."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    return F.lit(float(x))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Held between two values; a null must be handled outside, as least and greatest skip it."""
    return F.greatest(F.least(c, num(hi)), num(lo))


@dataclass(frozen=True)
class Weights:
    """Shares of the sub-scores in a composite, and the most that faces add."""

    sharpness: float = 0.30
    exposure: float = 0.22
    resolution: float = 0.38
    aesthetic: float = 0.10
    face_bonus: float = 0.10


def exposure(hi: Column, lo: Column, luma: Column) -> Column:
    """1 less half of the burnt share, a fifth of the crushed share and three tenths of the distance to mid tones."""
    burnt, crushed = F.least(hi / 100 * 5, num(1)), F.least(lo / 100 * num(2.5), num(1))
    off = F.when(luma < 90, num(90) - luma).when(luma > 160, luma - 160).otherwise(num(0))
    return num(1) - clamp(num(0.5) * burnt + num(0.2) * crushed + num(0.3) * clamp(off / 80))


def resolution(width: Column, height: Column) -> Column:
    """Pixels as a share of full HD, at most 1."""
    return clamp(width.cast("long") * height.cast("long") / num(1920 * 1080))


def aesthetic(mean: Column) -> Column:
    """A mean of 1 to 10 as 0 to 1; half where there is none."""
    return F.when(mean.isNull(), num(0.5)).otherwise(clamp((mean - 1) / num(9)))


def face_bonus(count: Column, frac: Column, centered: Column, most: float) -> Column:
    got = num(most) * (num(0.5) * clamp(centered) + num(0.5) * clamp(frac / num(0.2)))
    return F.when(count.isNull() | (count == 0), num(0)).otherwise(clamp(got, 0, most))


def composite(sharpness: Column, exposure: Column, resolution: Column, aesthetic: Column, bonus: Column, w: Weights) -> Column:
    return clamp(num(w.sharpness) * sharpness + num(w.exposure) * exposure + num(w.resolution) * resolution + num(w.aesthetic) * aesthetic + bonus)


def format_fit(width: Column, height: Column, ratio: Column, want_w: Column, want_h: Column, sx: Column | None = None, sy: Column | None = None) -> Column:
    """Share of the picture that a crop to ``ratio`` keeps, times whether the subject is in it, times how far it fills the wanted size."""
    w, h = width.cast("double"), height.cast("double")
    wide = w / h > ratio
    cw, ch = F.when(wide, h * ratio).otherwise(w), F.when(wide, h).otherwise(w / ratio)
    x, y = (clamp(s if s is not None else num(0.5)) * d for s, d in ((sx, w), (sy, h)))
    left, top = (F.greatest(F.least(p - c / 2, d - c), num(0)) for p, c, d in ((x, cw, w), (y, ch, h)))
    inside = (x >= left) & (x <= left + cw) & (y >= top) & (y <= top + ch)
    fit = clamp(cw * ch / (w * h)) * F.when(inside, num(1)).otherwise(num(0)) * clamp(F.least(cw / want_w, ch / want_h))
    return F.when((width <= 0) | (height <= 0) | (ratio <= 0), num(0)).otherwise(clamp(fit))


def recommendation(fit: Column, score: Column) -> Column:
    return clamp(fit * score)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(cells: Column, columns: int = 9) -> Column:
    """A 64-bit pattern from 8 rows of ``columns`` cells: bit 8 y + x is set where a cell is greater than the next."""
    step = columns - 1
    at = lambda k, d: F.get(cells, (k / step).cast("int") * columns + k % step + d)
    bit = lambda k: F.when(at(k, 0) > at(k, 1), F.expr("1L")).otherwise(F.expr("0L"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", bit(k), k)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in doubles; 0 where the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), num(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(num(0))


def l2_normalize(v: Column) -> Column:
    """Scaled to length 1; left alone where the length is 1e-12 or less."""
    norm = F.sqrt(F.aggregate(v, num(0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > num(1e-12), F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distribution(raw: Column) -> Column:
    """(mean, std_dev) of the first ten outputs of a rating model, as shares of 1 to 10; null where there are fewer."""
    p = F.slice(raw, 1, 10)
    total = F.aggregate(p, num(0), lambda s, x: s + x.cast("double"))
    share = F.transform(p, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(num(0.1)))
    pos = F.transform(share, lambda x, i: x * (i + 1))
    mean = F.aggregate(pos, num(0), lambda s, x: s + x)
    var = F.aggregate(F.transform(share, lambda x, i: x * (i + 1 - mean) * (i + 1 - mean)), num(0), lambda s, x: s + x)
    return F.when(F.size(raw) >= 10, F.struct(mean.alias("mean"), F.sqrt(var).alias("std_dev")))


def face_boxes(raw: Column, least: float = 0.6) -> Column:
    """Boxes (cx, cy, w, h) from rows (x1, y1, x2, y2, score): low scores and empty boxes go; overlaps stay."""
    kept = F.filter(raw, lambda b: b["score"] >= num(least))
    boxes = F.transform(kept, lambda b: F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), F.abs(b["x2"] - b["x1"]).alias("w"), F.abs(b["y2"] - b["y1"]).alias("h")))
    return F.filter(boxes, lambda b: (b["w"] > 0) & (b["h"] > 0))


def main_face(boxes: Column) -> Column:
    """The box of the largest area, the last of equals."""
    area = lambda b: F.greatest(b["w"] * b["h"], num(0))
    return F.aggregate(F.slice(boxes, 2, F.greatest(F.size(boxes), F.lit(1))), F.get(boxes, F.lit(0)), lambda a, b: F.when(area(b) >= area(a), b).otherwise(a))


def face_summary(boxes: Column) -> Column:
    """count, largest_face_frac, main_face_centered."""
    best = main_face(boxes)
    away = F.sqrt(F.pow(best["cx"] - num(0.5), num(2)) + F.pow(best["cy"] - num(0.5), num(2)))
    some = F.size(boxes) > 0
    return F.struct(
        F.size(boxes).alias("count"), F.when(some, clamp(best["w"] * best["h"])).otherwise(num(0)).alias("largest_face_frac"),
        F.when(some, clamp(num(1) - F.least(away / num(0.707), num(1)))).otherwise(num(0)).alias("main_face_centered"),
    )


# The same formulas as DuckDB SQL over the columns of PHOTOS_SQL.
EXPOSURE_SQL = """(1.0::DOUBLE - least(greatest(0.5::DOUBLE * least(hi / 100.0::DOUBLE * 5.0::DOUBLE, 1.0::DOUBLE)
  + 0.2::DOUBLE * least(lo / 100.0::DOUBLE * 2.5::DOUBLE, 1.0::DOUBLE)
  + 0.3::DOUBLE * least(greatest((CASE WHEN mean_luma < 90 THEN 90.0::DOUBLE - mean_luma WHEN mean_luma > 160 THEN mean_luma - 160.0::DOUBLE ELSE 0.0::DOUBLE END) / 80.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE))"""
RESOLUTION_SQL = "least(greatest((width::BIGINT * height::BIGINT) / 2073600.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
AESTHETIC_SQL = "CASE WHEN aesthetic_mean IS NULL THEN 0.5::DOUBLE ELSE least(greatest((aesthetic_mean - 1.0::DOUBLE) / 9.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END"


def bonus_sql(most: float) -> str:
    return f"CASE WHEN face_count IS NULL OR face_count = 0 THEN 0.0::DOUBLE ELSE least(greatest({most}::DOUBLE * (0.5::DOUBLE * face_centered + 0.5::DOUBLE * least(face_frac / 0.2::DOUBLE, 1.0::DOUBLE)), 0.0::DOUBLE), {most}::DOUBLE) END"


def composite_sql(w: Weights) -> str:
    return f"least(greatest({w.sharpness}::DOUBLE * sharpness + {w.exposure}::DOUBLE * exposure + {w.resolution}::DOUBLE * resolution + {w.aesthetic}::DOUBLE * aesthetic + face_bonus, 0.0::DOUBLE), 1.0::DOUBLE)"


def scored_sql(w: Weights = Weights()) -> str:
    return f"""
subs AS (
  SELECT *, least(greatest(cume_dist() OVER (ORDER BY sharpness_raw) - 0.5::DOUBLE / count(*) OVER (), 0.0::DOUBLE), 1.0::DOUBLE) AS sharpness,
    {EXPOSURE_SQL} AS exposure, {RESOLUTION_SQL} AS resolution, {AESTHETIC_SQL} AS aesthetic, {bonus_sql(w.face_bonus)} AS face_bonus
  FROM photos),
scored AS (SELECT *, {composite_sql(w)} AS composite_score FROM subs)
"""


FIT_SQL = """CASE WHEN w / h > ratio
  THEN least(greatest(h * ratio * h / (w * h), 0.0::DOUBLE), 1.0::DOUBLE) * least(greatest(least(h * ratio / want_w, h / want_h), 0.0::DOUBLE), 1.0::DOUBLE)
  ELSE least(greatest(w * (w / ratio) / (w * h), 0.0::DOUBLE), 1.0::DOUBLE) * least(greatest(least(w / want_w, w / ratio / want_h), 0.0::DOUBLE), 1.0::DOUBLE) END"""
