"""The queries of the photo engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfold import batch_queries
from grainfold.functions import formulas as X
from grainfold.operators import cache, geometry, grouping, increments, metric, persons, scoring, slices
from grainfold.plans.workspace import Workspace
from grainfold.sources import render
from grainfold.sources.catalog import PHOTOS_SQL, networks, photos, table
from grainfold.sources.images import drawn, measure
from grainfold.streaming import watch

CUSTOM = X.Weights(0.5, 0.2, 0.2, 0.1, 0.05)
COSINE_LEAST = 0.4
r6 = lambda c: F.round(c, 6)


def _coded(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """The catalog (of it the columns ``names``, if any) with codes and without contents, written once; texts are read where they lie, and never shuffled."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    p = photos(spark, sf).drop("text", "content_hash")
    coded = p.select(*names or p.columns).join(grouping.text_grid_hash(texts).withColumnRenamed("ord", "__o"), F.col("ord") == F.col("__o"), "left").drop("__o")
    return Workspace(spark, "catalog").write(coded, "coded")


def _scored(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """``names`` of the catalog scored and grouped, written once.  Rows travel with their own scores, not with what these are made of, and only with what is asked for."""
    path = [c for c in names if c == "path"]
    p = _coded(spark, sf, "ord", *path, "capture_s", "quality", "width", "height", "aesthetic_mean", "faces")
    own = scoring.own_scores(p).select("ord", *path, F.col("quality.sharpness_raw").alias("__s"), "exposure", "resolution", "aesthetic", "face_bonus")
    scores = scoring.rescore(scoring.midpoint_percentile(own, "__s", "sharpness"), X.Weights()).drop("__s")
    grouped = grouping.add_groups(scores.select("ord", *(c for c in names if c not in ("ord", "duplicate_group"))), grouping.duplicate_groups(p))
    return Workspace(spark, "catalog").write(grouped, "scored")


def _culled(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """``names`` of the scored catalog with winners and proposed rejects."""
    needed = ("sharpness", "exposure", "composite_score", "duplicate_group")
    return scoring.pre_reject(scoring.mark_winners(_scored(spark, sf, *needed, *(c for c in names if c not in needed))))


def score_photos(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the batch scored, grouped, with winners and proposed rejects."""
    names = ("sharpness", "exposure", "resolution", "aesthetic", "face_bonus", "composite_score")
    subs = [r6(F.col(c)).alias(c) for c in names]
    return _culled(spark, sf, "path", *names).select("ord", "path", *subs, "duplicate_group", "is_group_winner", "status")


def sharpness_percentile(spark, sf):
    return scoring.midpoint_percentile(photos(spark, sf).withColumn("v", F.col("quality.sharpness_raw")), "v", "p").select("ord", r6(F.col("p")).alias("percentile"))


def exposure_score(spark, sf):
    q = F.col("quality")
    return photos(spark, sf).select("ord", r6(X.exposure(q["clipped_highlights_pct"], q["clipped_shadows_pct"], q["mean_luma"])).alias("exposure"))


def resolution_score(spark, sf):
    return photos(spark, sf).select("ord", r6(X.resolution(F.col("width"), F.col("height"))).alias("resolution"))


def aesthetic_score(spark, sf):
    return photos(spark, sf).select("ord", r6(X.aesthetic(F.col("aesthetic_mean"))).alias("aesthetic"))


def face_bonus(spark, sf):
    f = F.col("faces")
    return photos(spark, sf).select("ord", r6(X.face_bonus(f["count"], f["largest_face_frac"], f["main_face_centered"], 0.10)).alias("face_bonus"))


def composite_custom_weights(spark, sf):
    return scoring.score(photos(spark, sf), CUSTOM).select("ord", r6(F.col("composite_score")).alias("composite_score"))


def live_rerank(spark, sf):
    """Stored sub-scores under other weights, with the rank of every photo."""
    p = scoring.rescore(scoring.sub_scores(photos(spark, sf)), CUSTOM).select("ord", r6(F.col("composite_score")).alias("composite_score"))
    return scoring.ranked(p)


def ranking_slice(spark, sf):
    """Places 101 to 160 of the stored ranking, a view of it: only their parts are opened."""
    p = scoring.score(photos(spark, sf)).select("ord", r6(F.col("composite_score")).alias("composite_score"))
    stored = slices.Ranking.store(scoring.ranked(p), f"{Workspace(spark, 'ranking').path}/stored")
    return stored.slice(101, 160)


def group_winners(spark, sf):
    p = _scored(spark, sf, "composite_score").withColumn("composite_score", r6(F.col("composite_score")))
    return scoring.best_of(p, "duplicate_group")


def pre_reject(spark, sf):
    return _culled(spark, sf).select("ord", "status")


def status_overrides(spark, sf):
    p = scoring.score(photos(spark, sf)).withColumn("status", F.when(F.col("sharpness") < 0.2, "Reject").otherwise("Undecided"))
    chosen = table(spark, sf, "labels").join(photos(spark, sf).select("ord", "path"), F.col("ord") == F.col("doc_id")).select("path", F.when(F.col("toxic") == 1, "Reject").otherwise("Keep").alias("status"))
    return scoring.override_status(p, chosen).select("ord", "path", "status")


def keep_filter(spark, sf):
    done = status_overrides(spark, sf)
    return scoring.keep_for_processing(photos(spark, sf).select("ord", "path"), done).select("ord", "path")


def best_photo_per_person(spark, sf):
    p = scoring.score(photos(spark, sf)).withColumn("composite_score", r6(F.col("composite_score")))
    return scoring.best_of(p.withColumn("person_id", F.when(F.col("ord") % 3 != 0, F.col("ord") % 17)), "person_id")


def recommend_all_networks(spark, sf):
    return scoring.recommend(scoring.score(photos(spark, sf)), networks(spark)).select("network_id", "ord", "path", *[r6(F.col(c)).alias(c) for c in ("composite_score", "fit", "recommendation")])


def recommend_topn(spark, sf):
    return scoring.top_n(recommend_all_networks(spark, sf), 10).select("network_id", "rank", "ord", "recommendation")


def format_fit(spark, sf):
    return scoring.recommend(photos(spark, sf).withColumn("composite_score", X.num(1)), networks(spark)).select("network_id", "ord", r6(F.col("fit")).alias("fit"))


def text_grid_dhash(spark, sf):
    """Codes as hex, since SQL engines differ on unsigned 64-bit values."""
    return grouping.text_grid_hash(photos(spark, sf)).select("ord", F.lpad(F.lower(F.hex("perceptual_hash")), 16, "0").alias("code"))


def hamming_pairs(spark, sf):
    return grouping.hamming_pairs(_coded(spark, sf, "ord", "capture_s"))


def duplicate_groups(spark, sf):
    return grouping.duplicate_groups(_coded(spark, sf, "ord", "capture_s"))


def incremental_groups(spark, sf):
    """``duplicate_groups`` of photos that come in two batches, a tenth of them in the second."""
    p = _coded(spark, sf, "ord", "capture_s")
    kept = increments.GroupIndex(spark, f"{Workspace(spark, 'kept').path}/groups")
    late = F.xxhash64("ord") % 10 == 0
    kept.add(p.where(~late))
    kept.add(p.where(late))
    return kept.groups()


def group_sizes(spark, sf):
    return grouping.duplicate_groups(_coded(spark, sf, "ord", "capture_s")).groupBy("duplicate_group").agg(F.count(F.lit(1)).alias("photos"))


def exact_duplicates(spark, sf):
    return grouping.exact_duplicates(photos(spark, sf))


def ranked_group_markers(spark, sf):
    """Every photo by score, marked where its group differs from the row before."""
    p = _scored(spark, sf, "composite_score").select("ord", r6(F.col("composite_score")).alias("composite_score"), "duplicate_group")
    before = F.col("previous")
    start = F.col("duplicate_group").isNotNull() & (before.isNull() | (before != F.col("duplicate_group")))
    return scoring.ranked(p, carry="duplicate_group").select("ord", "composite_score", "duplicate_group", "rank", start.alias("starts_group"))


def _faces_embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")


def cosine_pairs(spark, sf):
    return persons.cosine_pairs(_faces_embedded(spark, sf), COSINE_LEAST).select("a", "b", r6(F.col("similarity")).alias("similarity"))


def l2_normalize(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    n = X.l2_normalize(v)
    return _faces_embedded(spark, sf).select("ord", r6(F.aggregate(n, X.num(0), lambda s, x: s + x * x)).alias("length"), r6(F.get(n, F.lit(0))).alias("first"))


def cluster_persons(spark, sf):
    return persons.cluster_persons(_faces_embedded(spark, sf), 0.3)


def cluster_persons_two_phase(spark, sf):
    return persons.cluster_persons_two_phase(_faces_embedded(spark, sf), 0.3)


def cosine_classes(spark, sf):
    """``cosine_pairs`` as a class and a number of links for each row; copies are not expanded."""
    return metric.similar_classes(_faces_embedded(spark, sf), COSINE_LEAST)


def cosine_blocks(spark, sf):
    """What the join of ``cosine_pairs`` compares, and the share of its largest block."""
    return metric.block_report(_faces_embedded(spark, sf), COSINE_LEAST)


def nearest_centroid(spark, sf):
    e = _faces_embedded(spark, sf)
    c = [(r["ord"], r["embedding"]) for r in e.where("ord < 8").orderBy("ord").collect()]
    return persons.nearest_centroid(e, c, 0.2).select("ord", F.col("person_id").cast("int").alias("person_id"), r6(F.col("similarity")).alias("similarity"))


def aesthetic_distribution(spark, sf):
    """Mean and deviation of rating shares, with parts of the embeddings as raw outputs."""
    raw = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    d = X.distribution(raw)
    return _faces_embedded(spark, sf).select("ord", d.alias("d")).select("ord", r6(F.col("d.mean")).alias("mean"), r6(F.col("d.std_dev")).alias("std_dev"))


def face_summary(spark, sf):
    """Boxes decoded and summed up, with six boxes a row out of the embeddings."""
    x = lambda i, k: F.abs(F.get("embedding", i * 5 + k).cast("double")) * X.num(3)
    raw = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(*[F.least(x(i, k), X.num(1)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2", "score"))]))
    s = _faces_embedded(spark, sf).select("ord", X.face_boxes(raw, 0.3).alias("boxes")).select("ord", X.face_summary(F.col("boxes")).alias("s"))
    return s.select("ord", F.col("s.count").alias("faces"), r6(F.col("s.largest_face_frac")).alias("largest_face_frac"), r6(F.col("s.main_face_centered")).alias("main_face_centered"))


def _entries(spark, sf):
    p = photos(spark, sf).select("ord", "path", "file_size", F.coalesce("capture_s", F.lit(0).cast("long")).alias("mtime_s"))
    return p.withColumn("cache_key", cache.cache_key(F.col("path"), F.col("mtime_s"), F.col("file_size")))


def _yesterday(spark, sf):
    old = _entries(spark, sf).where("ord % 7 <> 0")
    return old.select("cache_key", F.when(F.col("ord") % 11 == 0, 0).otherwise(1).alias("schema_version"), (F.col("ord") % 3).alias("model_version"), F.lit("old").alias("origin"))


def cache_hit_tiers(spark, sf):
    return cache.hit_tiers(_entries(spark, sf), _yesterday(spark, sf), 1).select("ord", "tier")


def cache_upsert(spark, sf):
    fresh = _entries(spark, sf).where("ord % 2 = 0").select("cache_key", F.lit(1).alias("schema_version"), F.lit(1).cast("long").alias("model_version"), F.lit("new").alias("origin"))
    return cache.upsert(_yesterday(spark, sf), fresh)


def resume_pending(spark, sf):
    p = photos(spark, sf).select("ord", "path")
    state = F.when(F.col("ord") % 3 == 0, "ok").when(F.col("ord") % 7 == 0, "error").otherwise("pending")
    return cache.pending(p, p.select("path", state.alias("state"))).select("ord", "path")


def batch_metrics(spark, sf):
    return cache.batch_metrics(photos(spark, sf).select("path", (F.col("ord") % 9 != 0).alias("ok"), (F.col("ord") % 4 == 0).alias("is_video")))


def move_plan(spark, sf):
    p = scoring.score(photos(spark, sf)).withColumn("status", F.when(F.col("sharpness") < 0.2, "Reject").otherwise("Undecided"))
    return cache.plan_moves(p)


def resize_targets(spark, sf):
    w, h = F.col("width"), F.col("height")
    R = geometry.Resize
    got = {"fit": R(), "exact": R("Exact", 800, 600, keep_aspect_ratio=False), "half": R("Percentage", percentage=0.5), "video": None}
    cols = []
    for k, r in got.items():
        t = geometry.video_size(w, h, R("MaxDimension", 1280, 720)) if r is None else geometry.target_size(w, h, r)
        cols += [t["width"].alias(f"{k}_w"), t["height"].alias(f"{k}_h")]
    return photos(spark, sf).select("ord", *cols)


def center_crop_geometry(spark, sf):
    n = F.broadcast(networks(spark).select("id", "suggested_width", "suggested_height"))
    c = geometry.center_crop(F.col("width"), F.col("height"), F.col("suggested_width"), F.col("suggested_height"))
    return photos(spark, sf).crossJoin(n).select("ord", F.col("id").alias("crop_id"), *[c[k].alias(f"crop_{k}") for k in ("x", "y", "width", "height")])


def logo_placement(spark, sf):
    b = geometry.logo_box(F.col("width"), F.col("height"), F.lit(80), F.lit(40), geometry.Logo(scale=0.2, x=0.95, y=0.05))
    return photos(spark, sf).select("ord", *[b[k].alias(f"logo_{k}") for k in ("x", "y", "width", "height")])


def output_paths(spark, sf):
    o = geometry.Output(folder="out", filename_pattern="{name}_web{ext}", preserve_structure=True)
    p = F.col("path")
    return photos(spark, sf).select("ord", geometry.output_path(p, o).alias("out_path"), geometry.output_path(p, o, F.lit("ig feed/4:5")).alias("crop_path"))


def output_collisions(spark, sf):
    preset = geometry.Preset(output=geometry.Output(filename_pattern="{name}{ext}"), crops=(geometry.Crop("sq", "square", 256, 256),))
    p = photos(spark, sf).withColumn("path", F.concat(F.col("path").substr(1, 4), F.lit("/"), (F.col("ord") % 700).cast("string"), F.lit(".jpg")))
    return geometry.plan_outputs(p, preset).select("ord", "crop_id", "out_path", "collides")


def media_kinds(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "png", "webp", "CR2", "nef", "mp4", "MOV", "txt")]), (F.col("ord") % 8 + 1).cast("int"))
    p = photos(spark, sf).withColumn("path", F.concat(F.lit("a/b."), F.col("ord").cast("string"), F.lit("."), ext))
    kind = F.when(geometry.is_kind(F.col("path"), geometry.IMAGES), "image").when(geometry.is_kind(F.col("path"), geometry.RAWS), "raw").when(geometry.is_kind(F.col("path"), geometry.VIDEOS), "video").otherwise("other")
    return p.select("ord", kind.alias("kind"))


def arrival_gaps(spark, sf):
    """Arrivals within thirty seconds of the one before, of the same user."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.withColumn("gap", gap).where("gap <= 30000000").groupBy("event_type").agg(F.count(F.lit(1)).alias("close_arrivals"))


def event_windows(spark, sf):
    """Arrivals by hour and type, counted by a stream that takes what is there and stops."""
    ws = Workspace(spark, "stream")
    got = watch.run_once(watch.event_rates(spark, f"{sf}/events.parquet*"), f"{ws.path}/table", f"{ws.path}/checkpoint")
    return got.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def measured_pictures(spark, sf):
    """Texts drawn as gray pictures of 32 columns, stored as PNG, and measured from the files."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    return measure(drawn(docs)).select("ord", "width", "height", *[r6(F.col(f"quality.{k}")).alias(k) for k in ("sharpness_raw", "clipped_highlights_pct", "clipped_shadows_pct", "mean_luma", "contrast")], F.hex("perceptual_hash").alias("code"))


def rendered_pictures(spark, sf):
    """The same pictures through resize, adjustment and crops; sizes and paths of the files that would be written."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    preset = geometry.Preset(resize=geometry.Resize(width=64, height=64), output=geometry.Output("Png", folder="web"), crops=(geometry.Crop("sq", "square", 16, 16),), adjust=geometry.Adjust(contrast=0.2))
    return render.render(drawn(docs), preset).select("path", "crop_id", "out_path", "width", "height", "ok")


def preset_outputs(spark, sf):
    """Planned outputs of the catalog under a preset with two crops: a row per file."""
    preset = geometry.Preset(output=geometry.Output("Png", folder="web"), crops=(geometry.Crop("sq", "square", 256, 256), geometry.Crop("tall", "tall", 1080, 1920)))
    return geometry.plan_outputs(photos(spark, sf), preset).select("ord", "crop_id", "width", "height", "out_path")


QUERIES = {
    f.__name__: f
    for f in (
        score_photos, sharpness_percentile, exposure_score, resolution_score, aesthetic_score, face_bonus, composite_custom_weights, live_rerank, group_winners,
        pre_reject, status_overrides, keep_filter, best_photo_per_person, recommend_all_networks, recommend_topn, format_fit, text_grid_dhash, hamming_pairs, ranking_slice,
        duplicate_groups, incremental_groups, group_sizes, exact_duplicates, ranked_group_markers, cosine_pairs, l2_normalize, cluster_persons, cluster_persons_two_phase, cosine_blocks, cosine_classes, nearest_centroid, aesthetic_distribution,
        face_summary, cache_hit_tiers, cache_upsert, resume_pending, batch_metrics, move_plan, resize_targets, center_crop_geometry, logo_placement, output_paths,
        output_collisions, media_kinds, arrival_gaps, event_windows, measured_pictures, rendered_pictures, preset_outputs,
    )
} | batch_queries.QUERIES

_S = f"WITH {PHOTOS_SQL}, {X.scored_sql()}"
_G = f"WITH RECURSIVE {PHOTOS_SQL}, {X.scored_sql()}, {grouping.GRID_SQL}, {grouping.PAIRS_SQL}, {grouping.GROUPS_SQL}"
_CULL = """, culled AS (
  SELECT s.*, g.duplicate_group,
    g.duplicate_group IS NOT NULL AND row_number() OVER (PARTITION BY g.duplicate_group ORDER BY s.composite_score DESC, s.ord) = 1 AS is_group_winner
  FROM scored s LEFT JOIN grouped g ON g.ord = s.ord),
judged AS (
  SELECT *, CASE WHEN sharpness < 0.2::DOUBLE OR exposure < 0.25::DOUBLE OR (duplicate_group IS NOT NULL AND NOT is_group_winner) THEN 'Reject' ELSE 'Undecided' END AS status
  FROM culled)"""
_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("sharpness", "exposure", "resolution", "aesthetic", "face_bonus", "composite_score"))
_NETS = "nets AS (SELECT * FROM (VALUES ('ig_feed_4_5', 0.8::DOUBLE, 1080, 1350), ('ig_feed_square', 1.0::DOUBLE, 1080, 1080), ('stories_reels_tiktok', 0.5625::DOUBLE, 1080, 1920), ('fb_feed', 1.91::DOUBLE, 1200, 628), ('yt_thumb', 16.0::DOUBLE / 9.0::DOUBLE, 1280, 720)) t(network_id, ratio, want_w, want_h))"
_FITS = f""", {_NETS}, wide AS (SELECT n.*, s.*, s.width::DOUBLE AS w, s.height::DOUBLE AS h FROM scored s CROSS JOIN nets n),
fits AS (SELECT *, {X.FIT_SQL} AS fit FROM wide),
recs AS (SELECT network_id, ord, path, round(composite_score, 6) AS composite_score, round(fit, 6) AS fit, round(least(greatest(fit * composite_score, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS recommendation FROM fits)"""
_OVER = """, over AS (
  SELECT s.ord, s.path, coalesce(CASE l.toxic WHEN 1 THEN 'Reject' ELSE CASE WHEN l.doc_id IS NOT NULL THEN 'Keep' END END, CASE WHEN s.sharpness < 0.2::DOUBLE THEN 'Reject' ELSE 'Undecided' END) AS status
  FROM scored s LEFT JOIN labels l ON l.doc_id = s.ord)"""
_E = f"""WITH {PHOTOS_SQL}, entries AS (
  SELECT *, sha256(path || chr(31) || coalesce(capture_s, 0) || chr(31) || file_size) AS cache_key FROM photos),
old AS (SELECT cache_key, CASE WHEN ord % 11 = 0 THEN 0 ELSE 1 END AS schema_version, ord % 3 AS model_version, 'old' AS origin FROM entries WHERE ord % 7 <> 0)"""
_fit = lambda w, h: f"least({w}::DOUBLE / width, {h}::DOUBLE / height)"


def _target_sql(name: str, tw: str, th: str, even: bool = False) -> str:
    """Two columns: a wanted size with no enlargement."""
    back = f"least(width::DOUBLE / ({tw}), height::DOUBLE / ({th}))"
    over = f"(({tw}) > width OR ({th}) > height)"
    out = []
    for k, t in (("w", tw), ("h", th)):
        c = f"(CASE WHEN {over} THEN greatest(floor(({t}) * {back} + 0.5::DOUBLE), 1) ELSE ({t}) END)::INT"
        out.append(f"{f'({c} // 2) * 2' if even else c} AS {name}_{k}")
    return ", ".join(out)


def _px(side: str, s: str) -> str:
    return f"greatest(floor({side} * {s} + 0.5::DOUBLE), 1)"


ORACLES = {
    "score_photos": f"{_G}{_CULL} SELECT ord, path, {_R}, duplicate_group, is_group_winner, status FROM judged",
    "sharpness_percentile": f"{_S} SELECT ord, round(sharpness, 6) AS percentile FROM scored",
    "exposure_score": f"{_S} SELECT ord, round(exposure, 6) AS exposure FROM scored",
    "resolution_score": f"{_S} SELECT ord, round(resolution, 6) AS resolution FROM scored",
    "aesthetic_score": f"{_S} SELECT ord, round(aesthetic, 6) AS aesthetic FROM scored",
    "face_bonus": f"{_S} SELECT ord, round(face_bonus, 6) AS face_bonus FROM scored",
    "composite_custom_weights": f"WITH {PHOTOS_SQL}, {X.scored_sql(CUSTOM)} SELECT ord, round(composite_score, 6) AS composite_score FROM scored",
    "live_rerank": f"{_S}, r AS (SELECT ord, round({X.composite_sql(CUSTOM)}, 6) AS composite_score FROM subs) SELECT *, row_number() OVER (ORDER BY composite_score DESC, ord) AS rank FROM r",
    "group_winners": f"{_G}{_CULL} SELECT duplicate_group, arg_max(ord, (round(composite_score, 6), -ord)) AS best FROM culled WHERE duplicate_group IS NOT NULL GROUP BY duplicate_group",
    "pre_reject": f"{_G}{_CULL} SELECT ord, status FROM judged",
    "status_overrides": f"{_S}{_OVER} SELECT ord, path, status FROM over",
    "keep_filter": f"{_S}{_OVER} SELECT ord, path FROM over WHERE status <> 'Reject'",
    "best_photo_per_person": f"{_S} SELECT ord % 17 AS person_id, arg_max(ord, (round(composite_score, 6), -ord)) AS best FROM scored WHERE ord % 3 <> 0 GROUP BY 1",
    "recommend_all_networks": f"{_S}{_FITS} SELECT * FROM recs",
    "recommend_topn": f"{_S}{_FITS} SELECT network_id, rank, ord, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY network_id ORDER BY recommendation DESC, ord) AS rank FROM recs) WHERE rank <= 10",
    "format_fit": f"{_S}{_FITS} SELECT network_id, ord, fit FROM recs",
    "text_grid_dhash": f"WITH {PHOTOS_SQL}, {grouping.GRID_SQL} SELECT ord, lower(printf('%016x', h)) AS code FROM hashed",
    "hamming_pairs": f"WITH {PHOTOS_SQL}, {grouping.GRID_SQL}, {grouping.PAIRS_SQL} SELECT src, dst FROM pairs",
    "duplicate_groups": f"{_G} SELECT ord, duplicate_group FROM grouped",
    "incremental_groups": f"{_G} SELECT ord, duplicate_group FROM grouped",
    "ranking_slice": f"{_S}, r AS (SELECT ord, round(composite_score, 6) AS composite_score FROM scored), n AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, ord) AS rank FROM r) SELECT * FROM n WHERE rank BETWEEN 101 AND 160",
    "group_sizes": f"{_G} SELECT duplicate_group, count(*) AS photos FROM grouped GROUP BY duplicate_group",
    "exact_duplicates": f"WITH {PHOTOS_SQL} SELECT content_hash, count(*) AS copies, min(ord) AS first_ord FROM photos WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1",
    "ranked_group_markers": f"""{_G}, p AS (SELECT s.ord, round(s.composite_score, 6) AS composite_score, g.duplicate_group FROM scored s LEFT JOIN grouped g ON g.ord = s.ord)
      SELECT ord, composite_score, duplicate_group, row_number() OVER w AS rank, duplicate_group IS NOT NULL AND (lag(duplicate_group) OVER w IS NULL OR lag(duplicate_group) OVER w <> duplicate_group) AS starts_group
      FROM p WINDOW w AS (ORDER BY composite_score DESC, ord)""",
    "cosine_classes": f"WITH e AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.ord AS a, b.ord AS b FROM e a JOIN e b ON a.ord <> b.ord WHERE list_dot_product(a.e, b.e) >= {COSINE_LEAST}::DOUBLE), n AS (SELECT a, count(*) AS links FROM p GROUP BY a) SELECT e.ord, min(e.ord) OVER (PARTITION BY e.e) AS head, coalesce(n.links, 0) AS links FROM e LEFT JOIN n ON n.a = e.ord",
    "cosine_pairs": f"WITH e AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.ord AS a, b.ord AS b, list_dot_product(a.e, b.e) AS s FROM e a JOIN e b ON a.ord < b.ord) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= {COSINE_LEAST}::DOUBLE",
    "l2_normalize": "WITH e AS (SELECT vec_id AS ord, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings), n AS (SELECT ord, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM e) SELECT ord, round(list_dot_product(e, e), 6) AS length, round(e[1], 6) AS first FROM n",
    "nearest_centroid": """WITH e AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.ord, b.ord AS k, list_dot_product(a.e, b.e) AS s FROM e a JOIN e b ON b.ord < 8),
      m AS (SELECT ord, arg_max(k, (s, -k)) AS k, max(s) AS s FROM s GROUP BY ord)
      SELECT ord, CASE WHEN s > 0.2::DOUBLE THEN k::INT END AS person_id, CASE WHEN s > 0.2::DOUBLE THEN round(s, 6) END AS similarity FROM m""",
    "aesthetic_distribution": """WITH e AS (SELECT vec_id AS ord, list_transform(embedding[1:10], lambda x: abs(x::DOUBLE)) AS r FROM embeddings), p AS (SELECT ord, list_transform(r, lambda x: x / list_sum(r)) AS p FROM e),
      m AS (SELECT ord, p, list_dot_product(p, list_transform(range(1, 11), lambda i: i::DOUBLE)) AS mean FROM p)
      SELECT ord, round(mean, 6) AS mean, round(sqrt(list_sum(list_transform(p, lambda x, i: x * (i - mean) * (i - mean)))), 6) AS std_dev FROM m""",
    "face_summary": """WITH e AS (SELECT vec_id AS ord, unnest(range(0, 6))::INT AS i, embedding AS v FROM embeddings),
      b AS (SELECT ord, i, least(abs(v[i*5+1]::DOUBLE)*3, 1) AS x1, least(abs(v[i*5+2]::DOUBLE)*3, 1) AS y1, least(abs(v[i*5+3]::DOUBLE)*3, 1) AS x2, least(abs(v[i*5+4]::DOUBLE)*3, 1) AS y2, least(abs(v[i*5+5]::DOUBLE)*3, 1) AS s FROM e),
      f AS (SELECT ord, i, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, abs(x2-x1) AS w, abs(y2-y1) AS h FROM b WHERE s >= 0.3::DOUBLE AND abs(x2-x1) > 0 AND abs(y2-y1) > 0),
      m AS (SELECT ord, count(*) AS n, arg_max((cx, cy, w, h), (w*h, i)) AS t FROM f GROUP BY ord)
      SELECT e.ord, coalesce(m.n, 0)::INT AS faces, CASE WHEN m.n IS NULL THEN 0.0::DOUBLE ELSE round(least(t[3]*t[4], 1.0::DOUBLE), 6) END AS largest_face_frac,
        CASE WHEN m.n IS NULL THEN 0.0::DOUBLE ELSE round(greatest(1.0::DOUBLE - least(sqrt((t[1]-0.5::DOUBLE)*(t[1]-0.5::DOUBLE) + (t[2]-0.5::DOUBLE)*(t[2]-0.5::DOUBLE)) / 0.707::DOUBLE, 1.0::DOUBLE), 0), 6) END AS main_face_centered
      FROM (SELECT vec_id AS ord FROM embeddings) e LEFT JOIN m ON m.ord = e.ord""",
    "cache_hit_tiers": f"{_E} SELECT e.ord, CASE WHEN o.schema_version = 1 AND o.model_version = 1 THEN 'full' WHEN o.schema_version = 1 THEN 'partial' ELSE 'miss' END AS tier FROM entries e LEFT JOIN old o ON o.cache_key = e.cache_key",
    "cache_upsert": f"{_E}, fresh AS (SELECT cache_key, 1 AS schema_version, 1::BIGINT AS model_version, 'new' AS origin FROM entries WHERE ord % 2 = 0) SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.cache_key = o.cache_key AND f.model_version = o.model_version) UNION ALL SELECT * FROM fresh",
    "resume_pending": f"WITH {PHOTOS_SQL} SELECT ord, path FROM photos WHERE ord % 3 <> 0 AND ord % 7 <> 0",
    "batch_metrics": f"WITH {PHOTOS_SQL}, m AS (SELECT count(*) AS processed, count(*) FILTER (ord % 9 <> 0) AS ok, count(*) FILTER (ord % 9 = 0) AS failed, count(*) FILTER (ord % 4 = 0) AS v FROM photos) SELECT processed, ok, failed, greatest(ok - v, 0) AS images, least(v, ok) AS videos, least(100, round(ok * 100.0::DOUBLE / processed)::BIGINT) AS percent_ok FROM m",
    "move_plan": f"{_S} SELECT ord, path, regexp_extract(path, '^(.*)/', 1) || '/rejects/' || regexp_extract(path, '([^/]*)$', 1) AS new_path FROM scored WHERE sharpness < 0.2::DOUBLE",
    "resize_targets": f"WITH {PHOTOS_SQL} SELECT ord, "
    + ", ".join([
        _target_sql("fit", _px("width", _fit(2048, 2048)), _px("height", _fit(2048, 2048))), _target_sql("exact", "800.0::DOUBLE", "600.0::DOUBLE"),
        _target_sql("half", _px("width", "0.5::DOUBLE"), _px("height", "0.5::DOUBLE")), _target_sql("video", _px("width", _fit(1280, 720)), _px("height", _fit(1280, 720)), True),
    ]) + " FROM photos",
    "center_crop_geometry": f"""{_S}, {_NETS}, w AS (SELECT s.ord, n.network_id AS crop_id, s.width, s.height, s.width::DOUBLE / s.height > want_w::DOUBLE / want_h AS wide, want_w::DOUBLE / want_h AS r FROM scored s CROSS JOIN nets n),
      c AS (SELECT *, CASE WHEN wide THEN greatest(least(floor(height * r + 0.5::DOUBLE), width), 1) ELSE width END::INT AS cw, CASE WHEN wide THEN height ELSE greatest(least(floor(width / r + 0.5::DOUBLE), height), 1) END::INT AS ch FROM w)
      SELECT ord, crop_id, (width - cw) // 2 AS crop_x, (height - ch) // 2 AS crop_y, cw AS crop_width, ch AS crop_height FROM c""",
    "logo_placement": f"""WITH {PHOTOS_SQL}, a AS (SELECT *, least(greatest(floor(width * 0.2::DOUBLE + 0.5::DOUBLE), 1), width) AS tw FROM photos),
      b AS (SELECT *, least(greatest(floor(tw * 0.5::DOUBLE + 0.5::DOUBLE), 1), height) AS th FROM a)
      SELECT ord, greatest(least(floor(width * 0.95::DOUBLE - tw / 2.0::DOUBLE + 0.5::DOUBLE), width - tw), 0)::INT AS logo_x, greatest(least(floor(height * 0.05::DOUBLE - th / 2.0::DOUBLE + 0.5::DOUBLE), height - th), 0)::INT AS logo_y, tw::INT AS logo_width, th::INT AS logo_height FROM b""",
    "output_paths": f"WITH {PHOTOS_SQL} SELECT ord, 'out/' || regexp_extract(path, '^(.*)/', 1) || '/' || ord || '_web.jpg' AS out_path, 'out/' || regexp_extract(path, '^(.*)/', 1) || '/' || ord || '__ig_feed_4_5_web.jpg' AS crop_path FROM photos",
    "output_collisions": f"WITH {PHOTOS_SQL}, o AS (SELECT ord, NULL AS crop_id, 'out/' || (ord % 700) || '.jpg' AS out_path FROM photos UNION ALL SELECT ord, 'sq', 'out/' || (ord % 700) || '__sq.jpg' FROM photos) SELECT *, count(*) OVER (PARTITION BY out_path) > 1 AS collides FROM o",
    "media_kinds": f"WITH {PHOTOS_SQL} SELECT ord, CASE ord % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'raw' WHEN 4 THEN 'raw' WHEN 5 THEN 'video' WHEN 6 THEN 'video' ELSE 'other' END AS kind FROM photos",
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "rendered_pictures": "WITH d AS (SELECT doc_id, 32 AS width, greatest(1, ceil(strlen(coalesce(text, '')) / 32.0::DOUBLE))::INT AS height FROM documents), s AS (SELECT doc_id, "
    + _target_sql("t", _px("width", _fit(64, 64)), _px("height", _fit(64, 64))) + """ FROM d), o AS (SELECT *, unnest([NULL, 'sq']) AS crop_id FROM s)
      SELECT 'drawn/' || doc_id || '.png' AS path, crop_id, 'web/' || doc_id || CASE WHEN crop_id IS NULL THEN '' ELSE '__sq' END || '.png' AS out_path,
        CASE WHEN crop_id IS NULL THEN t_w ELSE 16 END AS width, CASE WHEN crop_id IS NULL THEN t_h ELSE 16 END AS height, true AS ok FROM o""",
    "preset_outputs": f"WITH {PHOTOS_SQL}, t AS (SELECT ord, " + _target_sql("t", _px("width", _fit(2048, 2048)), _px("height", _fit(2048, 2048))) + """ FROM photos)
      SELECT ord, NULL AS crop_id, t_w AS width, t_h AS height, 'web/' || ord || '.png' AS out_path FROM t
      UNION ALL SELECT ord, 'sq', 256, 256, 'web/' || ord || '__sq.png' FROM t UNION ALL SELECT ord, 'tall', 1080, 1920, 'web/' || ord || '__tall.png' FROM t""",
    "arrival_gaps": "WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT event_type, count(*) AS close_arrivals FROM g WHERE gap <= 30000000 GROUP BY event_type",
} | batch_queries.oracles(_S, _FITS, _target_sql)
