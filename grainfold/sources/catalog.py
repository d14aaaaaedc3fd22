"""Photo tables: schemas, the publishing formats, and the stand-in catalog over the provided tables.

The provided tables hold no pictures.  ``photos`` derives a deterministic photo
catalog from ``documents`` and ``labels``; the same derivation, as DuckDB SQL, is
``PHOTOS_SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUALITY = "struct<sharpness_raw:double,clipped_highlights_pct:double,clipped_shadows_pct:double,mean_luma:double,contrast:double>"
MEASURE = f"ord long, path string, file_size long, modified timestamp, width int, height int, capture_time timestamp, content_hash binary, perceptual_hash long, quality {QUALITY}, aesthetic struct<mean:double,std_dev:double>, faces struct<count:int,largest_face_frac:double,main_face_centered:double>, embedding array<float>, error string"

#: Publishing formats (fixed values): id, name, aspect ratio, orientation, suggested width and height.
NETWORKS = [
    ("ig_feed_4_5", "Instagram feed 4:5", 4.0 / 5.0, "Portrait", 1080, 1350),
    ("ig_feed_square", "Instagram feed 1:1", 1.0, "Square", 1080, 1080),
    ("stories_reels_tiktok", "Stories / Reels / TikTok 9:16", 9.0 / 16.0, "Portrait", 1080, 1920),
    ("fb_feed", "Facebook feed 1.91:1", 1.91, "Landscape", 1200, 628),
    ("yt_thumb", "Miniatura YouTube 16:9", 16.0 / 9.0, "Landscape", 1280, 720),
]
NETWORK_SCHEMA = "id string, name string, aspect_ratio double, orientation string, suggested_width int, suggested_height int"
#: First capture second of the stand-in catalog.
EPOCH = 1_700_000_000


def networks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NETWORKS, NETWORK_SCHEMA)


def network(spark: SparkSession, net_id: str) -> DataFrame:
    """The one row with this id; ValueError where there is none."""
    if net_id not in {n[0] for n in NETWORKS}:
        raise ValueError(f"unknown publishing format {net_id!r}")
    return networks(spark).where(F.col("id") == net_id)


def to_json_records(records: DataFrame) -> DataFrame:
    """(json): each row as one JSON object; null fields are left out."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("json"))


def from_json_records(lines: DataFrame, schema: StructType | str = MEASURE) -> DataFrame:
    """Rows of ``schema`` from (json); fields that a record lacks are null, and a broken record fails."""
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return lines.select(F.from_json("json", s, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, as a measured photo without its perceptual hash.  Contents are hashed before labels are joined, so a plan without ``text`` shuffles none."""
    d, lab = table(spark, sf_dir, "documents").withColumn("content_hash", F.sha2("text", 256)), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lid"), "quality")
    i = F.col("doc_id")
    dbl = lambda c: c.cast("double")
    faces = F.struct((i % 4).cast("int").alias("count"), (dbl(i * 17 % 50) * F.lit(0.01)).alias("largest_face_frac"), (dbl(i * 29 % 100) * F.lit(0.01)).alias("main_face_centered"))
    quality = F.struct(
        dbl(F.col("n_chars")).alias("sharpness_raw"), (dbl(i * 13 % 100) * F.lit(0.4)).alias("clipped_highlights_pct"),
        (dbl(i * 7 % 100) * F.lit(0.5)).alias("clipped_shadows_pct"), dbl(i * 31 % 256).alias("mean_luma"), dbl(i * 11 % 90).alias("contrast"),
    )
    mean = F.when(F.col("quality") == 1, F.lit(8.0)).when(F.col("quality") == 0, F.lit(3.0))
    return d.join(lab, i == F.col("lid"), "left").select(
        i.alias("ord"), F.concat(F.col("source"), F.lit("/"), i.cast("string"), F.lit(".jpg")).alias("path"), F.col("n_chars").alias("file_size"),
        (F.lit(640) + i * 37 % 5000).cast("int").alias("width"), (F.lit(480) + i * 53 % 4000).cast("int").alias("height"),
        F.when(i % 5 != 0, F.lit(EPOCH) + i * 7).alias("capture_s"), "content_hash", quality.alias("quality"),
        mean.alias("aesthetic_mean"), F.when(i % 6 != 0, faces).alias("faces"), F.col("text"),
    )


PHOTOS_SQL = """
photos AS (
  SELECT d.doc_id AS ord, d.source || '/' || d.doc_id || '.jpg' AS path, d.n_chars AS file_size,
    cast(640 + d.doc_id * 37 % 5000 AS INT) AS width, cast(480 + d.doc_id * 53 % 4000 AS INT) AS height,
    CASE WHEN d.doc_id % 5 <> 0 THEN 1700000000 + d.doc_id * 7 END AS capture_s, sha256(d.text) AS content_hash,
    d.n_chars::DOUBLE AS sharpness_raw, (d.doc_id * 13 % 100)::DOUBLE * 0.4::DOUBLE AS hi, (d.doc_id * 7 % 100)::DOUBLE * 0.5::DOUBLE AS lo,
    (d.doc_id * 31 % 256)::DOUBLE AS mean_luma, CASE l.quality WHEN 1 THEN 8.0::DOUBLE WHEN 0 THEN 3.0::DOUBLE END AS aesthetic_mean,
    CASE WHEN d.doc_id % 6 <> 0 THEN d.doc_id % 4 END AS face_count,
    CASE WHEN d.doc_id % 6 <> 0 THEN (d.doc_id * 17 % 50)::DOUBLE * 0.01::DOUBLE END AS face_frac,
    CASE WHEN d.doc_id % 6 <> 0 THEN (d.doc_id * 29 % 100)::DOUBLE * 0.01::DOUBLE END AS face_centered, d.text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
