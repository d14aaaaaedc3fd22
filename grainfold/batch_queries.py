"""Queries over the handling of a batch: selections, queue, names, text marks, records and video graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfold.operators import cache, geometry, scoring, selection
from grainfold.plans.workspace import Workspace
from grainfold.sources import catalog, library, presets, render
from grainfold.sources.catalog import PHOTOS_SQL, networks, photos, table

#: A file name that holds what names can hold: no extension, a leading dot, several dots, other letters.
_NAMES = ("{}.tar.JPG", "{}", ".hidden{}", "año {}'s: 100%,x.png", "sub\\{}.Nef")
VIDEO = geometry.Preset(
    "clip", geometry.Resize(width=1280, height=720), texts=(geometry.TextMark("{filename}: x", x=0.25, background_rgba=(1, 2, 254, 51), background_padding=0.5),),
    logos=(geometry.Logo(scale=0.2, opacity=0.5, x=0.95, y=0.05),), adjust=geometry.Adjust(brightness=0.1, contrast=-0.25, temperature=1),
)


def _named(spark, sf):
    each = F.array(*[F.concat(F.lit("dir/"), F.replace(F.lit(n), F.lit("{}"), F.col("ord").cast("string"))) for n in _NAMES])
    return photos(spark, sf).select("ord", F.element_at(each, (F.col("ord") % len(_NAMES) + 1).cast("int")).alias("path"))


def selected_queue(spark, sf):
    """The queue's rows that a selection names, some of them twice."""
    p = photos(spark, sf).select("ord", "path")
    pick = p.where("ord % 4 = 1")
    return selection.to_queue(p, pick.unionAll(pick))


def review_counts(spark, sf):
    p = photos(spark, sf).select(F.when(F.col("ord") % 4 == 0, "Reject").otherwise("Keep").alias("status"), F.when(F.col("ord") % 2 == 0, F.col("ord") % 10).alias("duplicate_group"))
    return selection.counts(p)


def _results(spark, sf):
    return photos(spark, sf).select("ord", "path", F.when(F.col("ord") % 9 == 0, F.concat(F.lit("unreadable: "), F.col("path"))).alias("error"))


def failed_files(spark, sf):
    return cache.split_errors(_results(spark, sf))[1]


def good_files(spark, sf):
    return cache.split_errors(_results(spark, sf))[0].select("ord", "path")


def network_lookup(spark, sf):
    return catalog.network(spark, "fb_feed")


def zipped_rows(spark, sf):
    """Queue rows beside analyses of some of them."""
    p = photos(spark, sf)
    return selection.zip_by_order(p.select("ord", "path"), p.where("ord % 3 = 0").select("ord", "file_size"))


def done_union(spark, sf):
    p = photos(spark, sf)
    return selection.done_paths(p.where("ord % 3 = 0"), p.where("ord % 5 = 0"))


def toggled_paths(spark, sf):
    """A selection of up to three paths, with the row's own path toggled in it."""
    have = F.when(F.col("ord") % 2 == 0, F.array(F.lit("a"), F.col("path"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return photos(spark, sf).select("ord", F.concat_ws("|", selection.toggle(have, F.col("path"))).alias("selected"))


def merged_results(spark, sf):
    """Cached rows without, and fresh rows with, an aesthetic mean."""
    p = photos(spark, sf)
    return selection.merge_results(p.where("ord % 2 = 0").select("ord", "path"), p.where("ord % 2 = 1").select("ord", "path", "aesthetic_mean"))


def file_names(spark, sf):
    p = F.col("path")
    return _named(spark, sf).select("ord", geometry.file_name(p).alias("name"), geometry.stem(p).alias("stem"), geometry.extension(p).alias("extension"), geometry.sanitize_name(geometry.file_name(p)).alias("safe_name"))


def text_marks(spark, sf):
    """A text mark filled with each photo's name and day of capture (UTC)."""
    day = F.date_from_unix_date(F.floor(F.col("capture_s") / 86400).cast("int"))
    return photos(spark, sf).select("ord", geometry.fill_text("{filename} on {date}, {filename}", geometry.stem(F.col("path")), day).alias("said"))


def clock_labels(spark, sf):
    return photos(spark, sf).select("ord", geometry.clock(F.col("file_size") * 123_457).alias("length"))


def data_urls(spark, sf):
    """Digests of the texts as data URLs."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("jpg", "PNG", "webp", "gif")]), (F.col("ord") % 4 + 1).cast("int"))
    url = render.data_url(F.col("text").cast("binary"), F.concat(F.lit("a/b."), ext))
    return photos(spark, sf).select("ord", F.md5(url.cast("binary")).alias("digest"), F.substring(url, 1, 22).alias("head"))


def preview_keys(spark, sf):
    return photos(spark, sf).select("ord", selection.preview_key(F.col("path"), F.col("capture_s"), F.col("file_size")).alias("key"))


def record_json(spark, sf):
    """Records written as JSON and read back."""
    p = photos(spark, sf).select("ord", "path", "file_size", "width", "height", "capture_s", "quality", "aesthetic_mean", "faces")
    back = catalog.from_json_records(catalog.to_json_records(p), p.schema)
    q, f = F.col("quality"), F.col("faces")
    return back.select("ord", "path", "file_size", "width", "height", "capture_s", q["clipped_highlights_pct"].alias("hi"), "aesthetic_mean", f["count"].alias("face_count"), f["largest_face_frac"].alias("face_frac"))


def recommendation_order(spark, sf):
    """Every photo's place in the list of every format."""
    r = scoring.recommend(scoring.score(photos(spark, sf)), networks(spark)).select("network_id", "ord", F.round("recommendation", 6).alias("recommendation"))
    return scoring.recommendation_order(r)


def video_graphs(spark, sf):
    """Filter graphs of a preset with colours, a logo and a text, for every photo's size."""
    name = geometry.file_name(F.col("path"))
    p = photos(spark, sf).drop("path").join(_named(spark, sf).withColumnRenamed("ord", "__o"), F.col("ord") == F.col("__o"))
    return p.select("ord", geometry.video_graph(F.col("width"), F.col("height"), F.lit(80), F.lit(40), VIDEO, "/f.ttf", name).alias("graph"))


def preset_files(spark, sf):
    """Presets written as JSON files, one of them in the old form with a single logo, and read back."""
    ws = Workspace(spark, "presets")
    lib = library.Library(spark, ws.path)
    lib.save_preset(VIDEO)
    lib.save_preset(geometry.Preset("plain"))
    library.replace_file(spark, f"{ws.path}/presets/old.json", b'{"name": "old", "logo": {"id": "one", "scale": 0.5}, "logos": [{"id": "two"}]}')
    library.replace_file(spark, f"{ws.path}/presets/broken.json", b'{"name": ')
    p = presets.read_presets(spark, f"{ws.path}/presets")
    return p.select("name", F.concat_ws("|", F.transform("logos", lambda x: x["id"])).alias("logo_ids"), F.col("resize.width").alias("width"), F.size("texts").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (
        selected_queue, review_counts, failed_files, good_files, network_lookup, zipped_rows, done_union, toggled_paths, merged_results, file_names, text_marks, clock_labels,
        data_urls, preview_keys, record_json, recommendation_order, video_graphs, preset_files,
    )
}

_P = f"WITH {PHOTOS_SQL}"
_N = f"""{_P}, named AS (SELECT ord, width, height, 'dir/' || CASE ord % 5 WHEN 0 THEN ord || '.tar.JPG' WHEN 1 THEN ord::VARCHAR WHEN 2 THEN '.hidden' || ord WHEN 3 THEN 'año ' || ord || '''s: 100%,x.png' ELSE 'sub\\' || ord || '.Nef' END AS path FROM photos),
names AS (SELECT *, regexp_extract(path, '[^/\\\\]*$') AS name FROM named)"""


def oracles(scored_sql: str, recs_sql: str, target_sql) -> dict[str, str]:
    """SQL by query; the arguments are the catalog's scores, its recommendations, and the two columns of a target size."""
    px = lambda side: f"greatest(floor({side} * least(1280::DOUBLE / width, 720::DOUBLE / height) + 0.5::DOUBLE), 1)"
    place = lambda side, own, at: f"greatest(least(floor({side} * {at}::DOUBLE - {own} / 2.0::DOUBLE + 0.5::DOUBLE), {side} - {own}), 0)::INT"
    return {
        "selected_queue": f"{_P} SELECT path, ord FROM photos WHERE ord % 4 = 1",
        "review_counts": f"{_P} SELECT count(*) AS photos, count(*) FILTER (ord % 4 = 0) AS rejects, count(DISTINCT CASE WHEN ord % 2 = 0 THEN ord % 10 END) AS groups, count(*) FILTER (ord % 2 = 0) AS grouped FROM photos",
        "failed_files": f"{_P} SELECT path, 'unreadable: ' || path AS error FROM photos WHERE ord % 9 = 0",
        "good_files": f"{_P} SELECT ord, path FROM photos WHERE ord % 9 <> 0",
        "network_lookup": "SELECT 'fb_feed' AS id, 'Facebook feed 1.91:1' AS name, 1.91::DOUBLE AS aspect_ratio, 'Landscape' AS orientation, 1200 AS suggested_width, 628 AS suggested_height",
        "zipped_rows": f"{_P} SELECT ord, path, CASE WHEN ord % 3 = 0 THEN file_size END AS file_size FROM photos",
        "done_union": f"{_P} SELECT DISTINCT path FROM photos WHERE ord % 3 = 0 OR ord % 5 = 0",
        "toggled_paths": f"{_P} SELECT ord, CASE WHEN ord % 2 = 0 THEN 'a|b' ELSE 'a|b|' || path END AS selected FROM photos",
        "merged_results": f"{_P} SELECT ord, path, CASE WHEN ord % 2 = 1 THEN aesthetic_mean END AS aesthetic_mean FROM photos",
        "file_names": f"""{_N} SELECT ord, name, CASE WHEN ord % 5 = 2 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') END AS stem,
          CASE ord % 5 WHEN 0 THEN 'jpg' WHEN 3 THEN 'png' WHEN 4 THEN 'nef' ELSE '' END AS extension, regexp_replace(name, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS safe_name FROM names""",
        "text_marks": f"{_P} SELECT ord, ord || ' on ' || strftime(DATE '1970-01-01' + (capture_s // 86400)::INT, '%Y-%m-%d') || ', ' || ord AS said FROM photos",
        "clock_labels": f"{_P} SELECT ord, printf('%d:%02d', file_size * 123457 // 60000000, file_size * 123457 // 1000000 % 60) AS length FROM photos",
        "data_urls": f"""{_P}, u AS (SELECT ord, 'data:image/' || CASE ord % 4 WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'jpeg' END || ';base64,' || base64(encode(text)) AS url FROM photos) SELECT ord, md5(url) AS digest, substr(url, 1, 22) AS head FROM u""",
        "preview_keys": f"{_P} SELECT ord, concat_ws('|', path, capture_s, file_size) AS key FROM photos",
        "record_json": f"{_P} SELECT ord, path, file_size, width, height, capture_s, hi, aesthetic_mean, face_count::INT AS face_count, face_frac FROM photos",
        "recommendation_order": f"{scored_sql}{recs_sql} SELECT network_id, ord, recommendation, row_number() OVER (PARTITION BY network_id ORDER BY recommendation DESC, ord) AS rank FROM recs",
        "video_graphs": f"""{_N}, t AS (SELECT ord, name, {target_sql("t", px("width"), px("height"), True)} FROM names),
          b AS (SELECT *, least(greatest(floor(t_w * 0.2::DOUBLE + 0.5::DOUBLE), 1), t_w)::INT AS l_w FROM t), l AS (SELECT *, least(greatest(floor(l_w * 0.5::DOUBLE + 0.5::DOUBLE), 1), t_h)::INT AS l_h, floor(greatest(t_w * 0.04::DOUBLE, 8) + 0.5::DOUBLE)::INT AS s FROM b)
          SELECT ord, '[0:v]scale=' || t_w || ':' || t_h || ',eq=brightness=0.1000:contrast=0.7500:saturation=1.0000,colorbalance=rm=0.3000:bm=-0.3000[v0];[1:v]scale=' || l_w || ':' || l_h
            || ',format=rgba,colorchannelmixer=aa=0.5000[w1];[v0][w1]overlay=' || {place("t_w", "l_w", 0.95)} || ':' || {place("t_h", "l_h", 0.05)} || '[v1];[v1]drawtext=fontfile=''/f.ttf'':text='''
            || replace(replace(replace(replace(replace(name, '\\', '\\\\'), ':', '\\:'), '%', '\\%'), ',', '\\,'), '''', '\\\\\\''') || '\\: x'':fontcolor=0xFFFFFF@1.000:fontsize=' || s
            || ':x=''max(min(w*0.25-text_w/2\\,w-text_w)\\,0)'':y=''max(min(h*0.9-text_h/2\\,h-text_h)\\,0)'':box=1:boxcolor=0x0102FE@0.200:boxborderw=' || floor(s * 0.5::DOUBLE + 0.5::DOUBLE)::INT || '[v2]' AS graph FROM l""",
        "preset_files": "SELECT * FROM (VALUES ('clip', 'logo', 1280, 1), ('plain', '', 2048, 0), ('old', 'one|two', NULL, NULL)) t(name, logo_ids, width, texts)",
    }
