"""Presets as JSON files: reading a folder of them, and writing one."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators import geometry as G

_LOGO = "struct<id:string,scale:double,opacity:double,x:double,y:double,background_rgba:array<int>,background_padding:double>"
SCHEMA = (
    "name string, resize struct<mode:string,width:int,height:int,percentage:double,keep_aspect_ratio:boolean,allow_upscale:boolean>, "
    f"logo {_LOGO}, logos array<{_LOGO}>, output struct<format:string,quality:int,folder:string,filename_pattern:string,preserve_structure:boolean>, "
    "crops array<struct<id:string,label:string,width:int,height:int>>, "
    "texts array<struct<text:string,font_size:double,rgba:array<int>,x:double,y:double,opacity:double,background_rgba:array<int>,background_padding:double>>, "
    "adjust struct<brightness:double,contrast:double,saturation:double,temperature:double>"
)


def read_presets(spark: SparkSession, folder: str) -> DataFrame:
    """Every parsable preset below ``folder``; an old single logo joins the list, missing fields are null."""
    df = spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    logos = F.concat(F.array_compact(F.array("logo")), F.coalesce("logos", F.array().cast(f"array<{_LOGO}>")))
    return df.where("_corrupt_record IS NULL AND name IS NOT NULL").withColumn("logos", logos).drop("logo", "_corrupt_record")


def to_preset(row) -> G.Preset:
    """A row of ``read_presets`` as a Preset, defaults for what is null."""

    def fill(kind, r):
        d = {k: (tuple(v) if isinstance(v, list) else v) for k, v in (r.asDict() if r else {}).items() if v is not None}
        return kind(**d)

    return G.Preset(
        row["name"], fill(G.Resize, row["resize"]), tuple(fill(G.Logo, x) for x in row["logos"] or ()), fill(G.Output, row["output"]),
        tuple(fill(G.Crop, x) for x in row["crops"] or ()), tuple(fill(G.TextMark, x) for x in row["texts"] or ()), fill(G.Adjust, row["adjust"]),
    )


def to_json(p: G.Preset) -> str:
    import json

    return json.dumps(asdict(p), ensure_ascii=False)
