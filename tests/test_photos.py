"""Behaviour of the photo operators on small literal tables and generated pictures."""

import os
import struct
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainfold.functions import formulas as X
from grainfold.functions import jpeg, pixels
from grainfold.operators import cache, geometry, grouping, persons, scoring, selection
from grainfold.plans.analyze import Settings, analyze
from grainfold.plans.components import connected_components
from grainfold.plans.workspace import Workspace, replace_file
from grainfold.sources import folders, images, presets, render, video
from grainfold.sources.catalog import network, networks
from grainfold.sources.library import Library
from grainfold.streaming import watch

CODES = "ord long, perceptual_hash long, capture_s long"


def gradient(w=400, h=300):
    x = np.arange(w) * 255 // w
    a = np.zeros((h, w, 3), np.uint8)
    a[:, :, 0], a[:, :, 1], a[:, :, 2] = x, 128, 200 - x // 2
    return a


def checkers(h=200, w=200):
    return (((np.arange(h)[:, None] + np.arange(w)) % 2) * 255).astype(np.uint8)


def groups(spark, rows, **kw):
    return dict(map(tuple, grouping.duplicate_groups(spark.createDataFrame(rows, CODES), **kw).collect()))


def test_groups_by_code(spark):
    assert groups(spark, [(0, 0, None), (1, 0, None), (2, 0xFFFF, None)]) == {0: 0, 1: 0}
    assert groups(spark, [(0, 0, None), (1, 0b11111, None)]) == {0: 0, 1: 0}
    assert groups(spark, [(0, 0, None), (1, 0xFF, None)], threshold=3) == {}
    assert groups(spark, [(0, 0, None), (1, 0, None), (2, -1, None), (3, -1, None)]) == {0: 0, 1: 0, 2: 1, 3: 1}
    assert groups(spark, []) == {}


def test_groups_by_time(spark):
    t = 1_700_000_000
    assert groups(spark, [(0, 0, t), (1, 0, t + 1000)]) == {}
    assert groups(spark, [(0, 0, t), (1, 0, t + 1000)], window_s=None) == {0: 0, 1: 0}
    assert groups(spark, [(0, 0, t), (1, 0, None)]) == {0: 0, 1: 0}
    assert groups(spark, [(0, 0, t), (1, 0, t + 30), (2, 0, t + 60)]) == {0: 0, 1: 0, 2: 0}
    assert groups(spark, [(0, 0, t), (1, 0, t + 1)], window_s=0) == {}


def test_links_give_the_groups_of_all_pairs(spark):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 4)) * 0x0F0F0F + int(1 << r.integers(0, 60)), None if r.random() < 0.3 else int(r.integers(0, 200))) for i in range(120)]
    df = spark.createDataFrame(rows, CODES)
    got = {}
    for o, g in grouping.duplicate_groups(df, 2, 5).collect():
        got.setdefault(g, set()).add(o)
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for a in range(120):
        for b in range(a + 1, 120):
            (_, ha, ta), (_, hb, tb) = rows[a], rows[b]
            if bin((ha ^ hb) & (2**64 - 1)).count("1") <= 2 and (ta is None or tb is None or abs(ta - tb) <= 5):
                parent[find(b)] = find(a)
                pairs.add((a, b))
    want = {}
    for i in range(120):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert {tuple(x) for x in grouping.hamming_pairs(df, 2, 5).collect()} == pairs


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = dict(map(tuple, connected_components(df, Workspace(spark, "t")).collect()))
    assert {got[i] for i in range(61)} == {0} and {got[100 + k] for k in range(50)} == {100} and len(got) == 111


def test_bit_count_of_codes(spark):
    df = spark.createDataFrame([(0, 0), (0b1010, 0b0101), (-1, 0)], "a long, b long")
    assert [r[0] for r in df.select(X.hamming(F.col("a"), F.col("b"))).collect()] == [0, 4, 64]


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_score_formulas(spark):
    d = X.num
    assert value(spark, X.exposure(d(0), d(0), d(128))) > 0.95
    assert value(spark, X.exposure(d(60), d(0), d(245))) < 0.45
    assert value(spark, X.resolution(F.lit(1920), F.lit(1080))) == 1.0
    assert value(spark, X.aesthetic(F.lit(None).cast("double"))) == 0.5
    assert value(spark, X.face_bonus(F.lit(0), d(1), d(1), 0.1)) == 0
    assert value(spark, X.face_bonus(F.lit(1), d(0.2), d(1), 0.1)) == pytest.approx(0.1)
    assert value(spark, X.recommendation(d(0.8), d(0.9))) == pytest.approx(0.72)


def test_fit(spark):
    fit = lambda w, h, r, ww, hh: value(spark, X.format_fit(F.lit(w), F.lit(h), X.num(r), F.lit(ww), F.lit(hh)))
    assert fit(1920, 1080, 16 / 9, 1280, 720) > 0.99
    assert fit(1920, 1080, 9 / 16, 1080, 1920) < 0.5
    assert fit(0, 100, 1.0, 10, 10) == 0
    assert networks(spark).count() == 5 and network(spark, "fb_feed").count() == 1
    with pytest.raises(ValueError):
        network(spark, "none")


def test_percentile_shares_the_upper_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 3, 5, 9)] + [(None,)], "v double")
    got = sorted(r["p"] for r in scoring.midpoint_percentile(df.where("v IS NOT NULL"), "v", "p").collect())
    assert got == pytest.approx([1 / 12, 0.25, 7 / 12, 7 / 12, 0.75, 11 / 12])
    assert scoring.midpoint_percentile(df.where("v IS NULL"), "v", "p").first()["p"] == 0.5


def test_winners_and_rejects(spark):
    rows = [(0, "a", 0.9, 0.5, 0.5, 1), (1, "b", 0.9, 0.5, 0.5, 1), (2, "c", 0.1, 0.9, 0.9, None), (3, "d", 0.5, 0.9, 0.1, None), (4, "e", 0.4, 0.9, 0.9, None)]
    df = scoring.mark_winners(spark.createDataFrame(rows, "ord long, path string, composite_score double, sharpness double, exposure double, duplicate_group int"))
    got = {r["ord"]: (r["is_group_winner"], r["status"]) for r in scoring.pre_reject(df.withColumn("sharpness", F.when(F.col("ord") == 2, 0.1).otherwise(0.5))).collect()}
    assert got == {0: (True, "Undecided"), 1: (False, "Reject"), 2: (False, "Reject"), 3: (False, "Reject"), 4: (False, "Undecided")}


def test_every_row_is_ranked_and_carries_the_row_before(spark):
    rows = [(i, (i * 37 % 500) / 500 if i % 3 else 0.5, i % 11 if i % 4 else None) for i in range(1500)] + [(1500, None, 3)]
    df = spark.createDataFrame(rows, "ord long, composite_score double, g int").repartition(5)
    got = {r["ord"]: (r["rank"], r["previous"]) for r in scoring.ranked(df, carry="g").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: (k + 1, want[k - 1][2] if k else None) for k, r in enumerate(want)}
    assert scoring.ranked(df.where("ord < 0")).count() == 0


def test_persons_in_order(spark):
    e = [[1.0, 0.0], [0.99, 0.14], None, [0.0, 1.0], [], [0.1, 0.99]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(e)], "ord long, embedding array<float>")
    assert [r["person_id"] for r in persons.cluster_persons(df).orderBy("ord").collect()] == [0, 0, None, 1, None, 1]
    assert persons.cluster_persons(df.limit(0)).count() == 0
    assert persons.cosine_pairs(df, 0.9).count() == 2
    near = {r["ord"]: r["person_id"] for r in persons.nearest_centroid(df, [(7, [1.0, 0.0]), (8, [0.0, 1.0])]).collect()}
    assert near[0] == 7 and near[3] == 8 and near[4] is None


def test_sizes(spark):
    size = lambda w, h, r: tuple(value(spark, geometry.target_size(F.lit(w), F.lit(h), r)))
    R = geometry.Resize
    cases = [
        (4000, 3000, R(), (2048, 1536)), (800, 600, R(), (800, 600)), (800, 600, R(allow_upscale=True), (2048, 1536)), (1000, 500, R("Exact", 300, 300, keep_aspect_ratio=False), (300, 300)),
        (1000, 500, R("Exact", 300, 300), (300, 150)), (1000, 500, R("Percentage", percentage=0.5), (500, 250)), (1000, 500, R("Percentage", percentage=-1.0), (1, 1)),
    ]
    for w, h, r, want in cases:
        assert size(w, h, r) == want == render._target(w, h, r)
    assert tuple(value(spark, geometry.video_size(F.lit(1001), F.lit(501), R("Percentage", percentage=1.0)))) == (1000, 500)
    with pytest.raises(ValueError):
        geometry.target_size(F.lit(1), F.lit(1), R("other"))


def test_paths(spark):
    p = F.lit("/in/trip/a.b.CR3")
    assert value(spark, geometry.output_path(p, geometry.Output("Png", folder="o"))) == "o/a.b.png"
    assert value(spark, geometry.output_path(p, geometry.Output(folder="o", preserve_structure=True), F.lit("ig 4:5"))) == "o/trip/a.b__ig_4_5.jpg"
    assert value(spark, geometry.output_path(F.lit("x.MOV"), geometry.Output(folder="o"))) == "o/x.mp4"
    assert value(spark, geometry.escape_drawtext(F.lit("a:b'c%"))) == "a\\:b\\\\\\'c\\%"
    assert geometry.video_adjust(geometry.Adjust()) == []
    eq, balance = geometry.video_adjust(geometry.Adjust(brightness=2, temperature=0.5))
    assert value(spark, eq) == "eq=brightness=1.0000:contrast=1.0000:saturation=1.0000" and value(spark, balance) == "colorbalance=rm=0.1500:bm=-0.1500"
    assert value(spark, geometry.clock(F.lit(61_500_000))) == "1:01"


def test_cache_tiers_and_table(spark, tmp_path):
    now = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 4), ("c", 0, 5)], "cache_key string, schema_version int, model_version int")
    assert {r["cache_key"]: r["tier"] for r in cache.hit_tiers(now, old, 5).collect()} == {"a": "full", "b": "partial", "c": "miss"}
    t = cache.CacheTable(spark, f"file://{tmp_path}/cache")
    assert t.read() is None
    t.put(old)
    t.put(spark.createDataFrame([("a", 2, 5)], old.schema))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2, 5), ("b", 1, 4), ("c", 0, 5)]


def test_measures():
    flat, board = np.full((200, 200), 128, np.uint8), checkers()
    assert pixels.quality(board)["sharpness_raw"] > pixels.quality(flat)["sharpness_raw"] == 0
    assert pixels.quality(np.full((50, 50), 255, np.uint8))["clipped_highlights_pct"] == 100
    assert pixels.quality(np.zeros((50, 50), np.uint8))["clipped_shadows_pct"] == 100
    assert pixels.quality(flat)["contrast"] < 1
    assert max(pixels.work_copy(np.zeros((1024, 2048), np.uint8)).shape) == 1024
    up = np.repeat((np.arange(200) * 255 // 199).astype(np.uint8)[None, :], 200, 0)
    assert pixels.dhash(up) == 0 and pixels.dhash(up[:, ::-1]) == -1 and pixels.dhash(flat) == 0


def test_adjust_and_compose():
    a = gradient()
    assert pixels.adjust(a) is a
    g = pixels.adjust(a, saturation=-1)
    assert (g[:, :, 0] == g[:, :, 1]).all() and (g[:, :, 1] == g[:, :, 2]).all()
    warm = pixels.adjust(a, temperature=1.0)
    assert warm[:, :, 0].mean() > a[:, :, 0].mean() and warm[:, :, 2].mean() < a[:, :, 2].mean()
    logo = np.full((40, 80, 4), 255, np.uint8)
    out = pixels.compose_logo(a, logo, geometry.Logo(scale=0.2, x=1.0, y=1.0, background_rgba=(0, 0, 0, 255), background_padding=0.1))
    assert out.shape == (300, 400, 4) and (out[-40:, -80:, :3] == 255).all() and (out[-44, -84, :3] == 0).all()
    assert pixels.center_crop(a, 256, 256).shape[:2] == (256, 256)
    assert pixels.resample(np.full((7, 5, 3), 9, np.uint8), 50, 3).min() == 9


def test_png_and_exif():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (pixels.read_png(pixels.png(a)) == a).all()
    for bad in (b"", b"text", pixels.png(gradient())[:200]):
        with pytest.raises(ValueError):
            pixels.read_png(bad)
    tiff = b"II*\x00\x08\x00\x00\x00\x02\x00" + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<HHII", 0x0132, 2, 20, 38) + b"\0\0\0\0" + b"2024:05:06 07:08:09\x00"
    assert pixels.exif(b"\xff\xd8Exif\x00\x00" + tiff)[0x0112] == 6
    assert pixels.capture_time(tiff).isoformat() == "2024-05-06T07:08:09+00:00"
    assert pixels.exif(bytes(16)) == {} and pixels.capture_time(b"") is None
    a = np.zeros((2, 4, 3), np.uint8)
    a[0, 0] = (255, 0, 0)
    assert pixels.orient(a, 6).shape == (4, 2, 3) and (pixels.orient(a, 6)[0, 1] == (255, 0, 0)).all() and pixels.orient(a, 99) is a
    for k in range(1, 9):
        assert sorted(pixels.orient(a, k).ravel()) == sorted(a.ravel())
    small, large = b"\xff\xd8ab\xff\xd9", b"\xff\xd8" + bytes(32) + b"\xff\xd9"
    assert pixels.raw_preview(b"x" + small + b"yy" + large + b"z") == large
    with pytest.raises(ValueError):
        pixels.raw_preview(bytes(64))


def test_jpeg_equals_the_platform_codec(spark, tmp_path):
    r, io, jvm = np.random.default_rng(5), spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io
    y, x = np.mgrid[:45, :70]
    smooth = np.stack([x * 3, y * 5, 255 - x - y], 2).clip(0, 255).astype(np.uint8)
    for a in (smooth, smooth[:, :, 0], r.integers(0, 256, (17, 9, 3)).astype(np.uint8), np.full((1, 1, 3), 77, np.uint8)):
        # what another codec wrote (with subsampled colours), read here and by it
        out = jvm.ByteArrayOutputStream()
        assert io.write(io.read(jvm.ByteArrayInputStream(pixels.png(a))), "jpg", out)
        theirs = bytes(out.toByteArray())
        for name, body in (("theirs", theirs), ("ours", jpeg.jpeg(a, 90))):
            got = jpeg.read_jpeg(body)
            assert got.shape == a.shape
            folder = tmp_path / f"{name}{a.shape}"
            folder.mkdir()
            (folder / "x.jpg").write_bytes(body)
            row = spark.read.format("image").load(f"file://{folder}").select("image.*").first()
            want = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])[:, :, ::-1]
            mine = np.repeat(got[:, :, None], want.shape[2], 2) if got.ndim == 2 else got
            away = np.abs(mine.astype(int) - want)
            # the other codec smooths subsampled colours, so single samples of noise may differ
            assert away.mean() < (2 if name == "ours" or a is smooth or a.ndim == 2 else 40), (name, a.shape, away.mean())
    lossless = jpeg.read_jpeg(jpeg.jpeg(smooth, 100))
    assert np.abs(lossless.astype(int) - smooth).max() <= 3
    good = jpeg.jpeg(smooth, 80)
    for bad in (b"", b"\xff\xd8\xff", good[:200], good[:-300], good.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            jpeg.read_jpeg(bad)


def test_raw_files_are_measured_by_their_preview(spark, tmp_path):
    tiff = b"II*\x00\x08\x00\x00\x00\x02\x00" + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<HHII", 0x0132, 2, 20, 38) + b"\0\0\0\0" + b"2024:05:06 07:08:09\x00"
    body = jpeg.jpeg(gradient(64, 32))
    mark = b"Exif\x00\x00" + tiff
    body = body[:2] + b"\xff\xe1" + struct.pack(">H", len(mark) + 2) + mark + body[2:]
    (tmp_path / "a.nef").write_bytes(b"II*\x00" + bytes(100) + body + bytes(9))
    (tmp_path / "b.jpg").write_bytes(body)
    (tmp_path / "c.jpg").write_bytes(body[:-200])
    rows = {r["path"][-5:]: r for r in images.measure(images.scan(spark, [str(tmp_path)])).collect()}
    for k in ("a.nef", "b.jpg"):
        assert (rows[k]["width"], rows[k]["height"], rows[k]["error"]) == (32, 64, None)  # turned upright
        assert rows[k]["capture_time"].timestamp() == 1714979289
    assert rows["a.nef"]["perceptual_hash"] == rows["b.jpg"]["perceptual_hash"] and "cut short" in rows["c.jpg"]["error"]


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
@settings(max_examples=50, deadline=None)
def test_distance_is_symmetric(a, b):
    assert bin(a ^ b).count("1") == bin(b ^ a).count("1") <= 64


@pytest.fixture
def folder(tmp_path):
    big = gradient(800, 600)
    for name, body in (("a.png", pixels.png(big)), ("b.PNG", pixels.png(big)), ("sub/c.png", pixels.png(checkers(300, 400))), ("bad.png", b"no picture"), ("note.txt", b"x"), ("clip.mp4", b"x")):
        p = Path(tmp_path / "in" / name)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return tmp_path / "in"


def test_analysis_of_a_folder(spark, folder, tmp_path):
    t = cache.CacheTable(spark, f"file://{tmp_path}/cache")
    for _ in range(2):  # the second time from the cache
        photos, errors = analyze(spark, [str(folder)], Settings(), t)
        rows = {r["path"].rpartition("/")[2]: r for r in photos.collect()}
        assert set(rows) == {"a.png", "b.PNG", "c.png"} and [r["path"].rpartition("/")[2] for r in errors.collect()] == ["bad.png"]
        assert rows["a.png"]["duplicate_group"] == rows["b.PNG"]["duplicate_group"] is not None
        assert rows["a.png"]["is_group_winner"] + rows["b.PNG"]["is_group_winner"] == 1
        assert rows["c.png"]["quality"]["sharpness_raw"] > rows["a.png"]["quality"]["sharpness_raw"]


def test_warm_analysis_opens_no_known_file(spark, folder, tmp_path):
    t = cache.CacheTable(spark, f"file://{tmp_path}/cache")
    pick = lambda df: {r["path"].rpartition("/")[2]: (r["content_hash"], r["quality"], r["aesthetic_mean"]) for r in df.collect()}
    cold = pick(analyze(spark, [str(folder)], Settings(), t)[0])
    assert all(x[2] is None for x in cold.values())
    model = pick(analyze(spark, [str(folder)], Settings(model_version=1), t, lambda: {"aesthetic": lambda a: (5.0, 1.0)})[0])
    assert {k: (*v[:2], 5.0) for k, v in cold.items()} == model  # the partial tier: only the model's measures are new
    for f in folder.rglob("*"):
        if f.is_file() and f.name in cold:
            at = f.stat()
            f.write_bytes(bytes(at.st_size))
            os.utime(f, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert pick(analyze(spark, [str(folder)], Settings(), t)[0]) == cold  # an older model's entries are still there


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for k, name in enumerate(["r/a.png", "r/x/b.png", "r/x/y/c.png", "r/x/y/z/d.png", "r/x/y/z/w/e.png", "s/f.png"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes(k + 1))
    roots = [f"{tmp_path}/r", f"file://{tmp_path}/s", f"{tmp_path}/r/x"]
    got = folders.listing(spark, roots)
    assert sorted((Path(r["path"]).name, r["file_size"]) for r in got.collect()) == [(f"{c}.png", k + 1) for k, c in enumerate("abcdef")]
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/r").select("path", "length").collect()
    one = folders.listing(spark, roots[:1])
    assert sorted((r["path"], r["file_size"]) for r in one.collect()) == sorted(map(tuple, theirs))
    assert sorted(r["file_size"] for r in one.where("file_size >= 2 AND path LIKE '%.png' AND file_size < 4").collect()) == [2, 3]
    assert folders.listing(spark, []).count() == 0
    assert [folders.read_file(r["path"]) for r in one.where("file_size = 3").collect()] == [bytes(3)]


def test_outputs_of_one_path_are_errors(spark, tmp_path):
    for name, v in (("a/0.png", 10), ("a/sub/0.png", 90), ("a/1.png", 50)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(pixels.png(np.full((20, 30, 3), v, np.uint8)))
    out = render.render(images.scan(spark, [f"{tmp_path}/a"]), geometry.Preset(output=geometry.Output("Png", folder="web"), crops=(geometry.Crop("sq", "square", 8, 8),)))
    rows = sorted((Path(r["path"]).name, r["crop_id"] or "", r["ok"], r["error"]) for r in out.collect())
    assert rows == [("0.png", "", False, render.TAKEN)] * 2 + [("0.png", "sq", False, render.TAKEN)] * 2 + [("1.png", "", True, None), ("1.png", "sq", True, None)]


@pytest.mark.parametrize("quality", [50, 85, 95, 100])
def test_jpeg_of_a_grainy_photo(quality):
    r = np.random.default_rng(quality)
    a = np.clip(gradient(800, 600).astype(int) + r.integers(-32, 33, (600, 800, 3)), 0, 255).astype(np.uint8)
    body = jpeg.jpeg(a, quality)
    assert body[:2] == b"\xff\xd8" and body[-2:] == b"\xff\xd9"


def test_render_and_write(spark, folder, tmp_path):
    preset = geometry.Preset(
        resize=geometry.Resize(width=400, height=400), output=geometry.Output("Png", folder="web"), logos=(geometry.Logo("l", 0.2),), crops=(geometry.Crop("ig sq", "square", 256, 256), geometry.Crop("wide", "wide", 320, 180)),
        adjust=geometry.Adjust(brightness=0.1),
    )
    files = images.scan(spark, [str(folder)]).where("NOT path LIKE '%.mp4'")
    out = render.write_files(render.render(files, preset, {"l": pixels.png(np.full((40, 80, 4), 200, np.uint8))}), f"file://{tmp_path}/done").collect()
    good, bad = [r for r in out if r["ok"]], [r for r in out if not r["ok"]]
    assert len(good) == 9 and len(bad) == 1 and "bad.png" in bad[0]["path"]
    sizes = {p.name: pixels.read_png(p.read_bytes()).shape[:2] for p in (tmp_path / "done/web").iterdir()}
    assert sizes["a.png"] == (300, 400) and sizes["a__ig_sq.png"] == (256, 256) and sizes["c__wide.png"] == (180, 320)
    assert render.render(files, geometry.Preset(output=geometry.Output("Jpeg"))).where("ok").count() == 3
    none = render.render(files, geometry.Preset(output=geometry.Output("WebP"))).where("ok").count()
    assert none == 0  # no WebP encoder here: said, not skipped
    missing = render.render(files, geometry.Preset(output=geometry.Output("Png"), logos=(geometry.Logo("x"),))).select("error").distinct().collect()
    assert any("logo not found" in r[0] for r in missing)
    assert render.thumbnails(files, 32).where("thumb IS NULL").count() == 1


def test_moves(spark, folder):
    p = spark.createDataFrame([(1, f"file://{folder}/a.png", "Reject"), (2, f"file://{folder}/none.png", "Reject"), (3, f"file://{folder}/sub/c.png", "Keep")], "ord long, path string, status string")
    got = {r["ord"]: r["ok"] for r in render.move_files(cache.plan_moves(p)).collect()}
    assert got == {1: True, 2: False} and (folder / "rejects/a.png").exists() and not (folder / "a.png").exists()


def test_presets(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "old", "logo": {"id": "a", "scale": 0.2}, "logos": [{"id": "b"}], "resize": {"mode": "Exact", "width": 5, "height": 6}}')
    (tmp_path / "q.json").write_text("{broken")
    (tmp_path / "r.json").write_text(presets.to_json(geometry.Preset("new", crops=(geometry.Crop("c", "c", 1, 2),))))
    got = {r["name"]: presets.to_preset(r) for r in presets.read_presets(spark, str(tmp_path)).collect()}
    assert [x.id for x in got["old"].logos] == ["a", "b"] and got["old"].resize.width == 5 and got["new"].crops[0].height == 2


def test_watched_folder(spark, folder, tmp_path):
    q = watch.process_arrivals(watch.arrivals(spark, str(folder)).where("NOT path LIKE '%.mp4'"), f"{tmp_path}/ck", watch.measure_to(f"{tmp_path}/m"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/m").where("error IS NULL").count() == 3
    (folder / "late.png").write_bytes(pixels.png(gradient(50, 40)))
    watch.process_arrivals(watch.arrivals(spark, str(folder)).where("NOT path LIKE '%.mp4'"), f"{tmp_path}/ck", watch.measure_to(f"{tmp_path}/m"), once=True).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/m").where("error IS NULL").count() == 4


def test_watched_folder_takes_files_with_old_times(spark, folder, tmp_path):
    def run():
        watch.process_arrivals(watch.arrivals(spark, str(folder)).where("NOT path LIKE '%.mp4'"), f"{tmp_path}/ck", watch.measure_to(f"{tmp_path}/m"), once=True).awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/m").where("error IS NULL").count()

    assert run() == 3
    for name, age in (("hours.png", 3 * 3600), ("days.png", 40 * 86400)):
        (folder / name).write_bytes(pixels.png(gradient(50, 40)))
        os.utime(folder / name, (time.time() - age,) * 2)
    assert run() == 5


def test_library(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.save_preset(geometry.Preset("my preset")) == "presets/my_preset.json"
    assert presets.read_presets(spark, f"file://{tmp_path}/lib/presets").first()["name"] == "my preset"
    assert lib.delete_preset("my preset") and not lib.delete_preset("my preset")
    logo = lib.add_logo("a b.PNG", b"123")
    assert lib.logos() == [logo] and lib.logo(logo) == b"123" and lib.delete_logo(logo) and lib.logo(logo) is None
    lib.add_metrics({"images": 2})
    assert lib.add_metrics({"images": 3, "videos": 1})["images"] == 5 and lib.clear_metrics()
    (tmp_path / "m.onnx").write_bytes(b"x")
    found = lib.find_model("m.onnx", [str(tmp_path / "none"), str(tmp_path)])
    assert found and lib.model_version([found]) > 0 and lib.model_version([]) == 0


def test_selection(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "ord long, path string")
    pick = q.where("ord < 3").select("path")
    assert selection.to_queue(q, pick).count() == 2 and selection.to_queue(q, pick.limit(0)).count() == 3
    assert selection.done_paths(pick, pick).count() == 2
    both = F.array(F.lit("a"), F.lit("b"))
    assert value(spark, selection.toggle(both, F.lit("a"))) == ["b"] and value(spark, selection.toggle(both, F.lit("c"))) == ["a", "b", "c"]
    assert [r["v"] for r in selection.zip_by_order(q, spark.createDataFrame([(2, "x")], "ord long, v string")).orderBy("ord").collect()] == [None, "x", None]


def test_leaders_equal_a_loop():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(20, 40))
    rows = [None, np.empty(0), *[(v := near[k] + rng.normal(size=40) * 0.3) / np.sqrt(v @ v) for k in rng.integers(0, 20, 120)], np.ones(3) / np.sqrt(3), np.ones(3) / np.sqrt(3)]
    people, want = [], []
    for e in rows:
        if e is None or not len(e):
            want.append(None)
            continue
        sims = [(float(c @ e), -k) for k, (c, _) in enumerate(people) if len(c) == len(e)]
        if sims and max(sims)[0] > 0.5:
            k = -max(sims)[1]
            c = (people[k][0] * people[k][1] + e) / (people[k][1] + 1)
            people[k] = (c / np.sqrt(c @ c), people[k][1] + 1)
        else:
            k = len(people)
            people.append((e, 1))
        want.append(k)
    leaders = persons.Leaders(0.5)
    assert [leaders.assign(e) for e in rows] == want and len(people) > 8


def test_replaced_file_is_whole(spark, tmp_path):
    at = f"file://{tmp_path}/deep/POINTER"
    for body in (b"one", b"two, longer", b""):
        replace_file(spark, at, body)
        assert (tmp_path / "deep/POINTER").read_bytes() == body
    assert not list((tmp_path / "deep").glob("*.tmp"))


def test_video_graph(spark):
    p = geometry.Preset(logos=(geometry.Logo("l", 0.25, background_rgba=(0, 0, 0, 128)),), texts=(geometry.TextMark("{filename}: x"),), adjust=geometry.Adjust(contrast=0.2))
    g = value(spark, geometry.video_graph(F.lit(1921), F.lit(1081), F.lit(80), F.lit(40), p, "/f.ttf", F.lit("clip")))
    assert g.startswith("[0:v]scale=1920:1080,eq=") and "drawbox" in g and "overlay=" in g and "text='clip\\: x'" in g and g.endswith("[v2]")


def test_video_says_what_is_missing():
    import shutil

    if shutil.which("ffprobe"):
        pytest.skip("a video tool is installed")
    with pytest.raises(render.Unavailable):
        video.probe("x.mp4")


def test_distribution_and_boxes(spark):
    raw = F.array(*[F.lit(float(v)) for v in (0, 0, 0, 0, 2, 2, 0, 0, 0, 0)])
    assert value(spark, X.distribution(raw))["mean"] == pytest.approx(5.5)
    assert value(spark, X.distribution(F.array(F.lit(1.0)))) is None
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2", "score"))])
    s = value(spark, X.face_summary(X.face_boxes(F.array(box(0.4, 0.4, 0.6, 0.6, 0.9), box(0, 0, 1, 1, 0.3)))))
    assert s["count"] == 1 and s["main_face_centered"] > 0.99 and s["largest_face_frac"] == pytest.approx(0.04)
    assert value(spark, X.face_summary(X.face_boxes(F.array(box(0, 0, 1, 1, 0.3)))))["count"] == 0
    assert value(spark, X.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0
