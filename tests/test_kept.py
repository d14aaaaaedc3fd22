"""Groups that grow by batches, slices of a ranking, and the thumbnail cache."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.operators import grouping, scoring
from grainfold.operators.increments import GroupIndex
from grainfold.operators.slices import Ranking
from grainfold.sources.thumbs import Thumbnails

CODES = "ord long, perceptual_hash long, capture_s long"


def rows_of(seed, n=150):
    r = np.random.default_rng(seed)
    rows = [(i, None if r.random() < 0.05 else int(r.integers(0, 6)) * 0x0F0F0F + int(1 << r.integers(0, 60)), None if r.random() < 0.2 else int(r.integers(0, 400))) for i in range(n)]
    return [rows[k] for k in r.permutation(n)]


@pytest.mark.parametrize(("seed", "window", "most"), [(2, None, 256), (3, 20, 2)])
def test_batches_give_the_groups_of_a_full_run(spark, tmp_path, monkeypatch, seed, window, most):
    monkeypatch.setattr("grainfold.operators.increments.BUCKET_MOST", most)
    rows = rows_of(seed)
    kept = GroupIndex(spark, f"file://{tmp_path}/groups", 2, window)
    for part in (rows[:70], [], rows[70:90], rows[90:]):
        kept.add(spark.createDataFrame(part, CODES))
    want = grouping.duplicate_groups(spark.createDataFrame(rows, CODES), 2, window)
    got = sorted(map(tuple, kept.groups().collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 20
    assert kept.components().count() == sum(c is not None for _, c, _ in rows)


def test_a_batch_joins_older_groups_and_rewrites_only_those(spark, tmp_path):
    kept = GroupIndex(spark, f"file://{tmp_path}/groups", 2, None)
    frame = lambda *r: spark.createDataFrame([(o, c, None) for o, c in r], CODES)
    kept.add(frame((10, 0), (11, 0), (20, 0b1111), (21, 0b1111), (30, -1), (31, -1), (40, 0xFF00FF)))
    before = kept._state()
    assert dict(map(tuple, kept.groups().collect())) == {10: 0, 11: 0, 20: 1, 21: 1, 30: 2, 31: 2} and before["merged"] == []
    kept.add(frame((5, 0b0011)))  # two bits from both
    after = kept._state()
    assert dict(map(tuple, kept.groups().collect())) == {5: 0, 10: 0, 11: 0, 20: 0, 21: 0, 30: 1, 31: 1}
    assert after["members"][:1] == before["members"] and sorted(map(tuple, kept._read(after["merged"], "label long, component long").collect())) == [(10, 5), (20, 5)]
    kept.add(frame((6, 0b0011), (41, 0xFF00FF)))
    assert dict(map(tuple, kept.components().collect())) == {5: 5, 6: 5, 10: 5, 11: 5, 20: 5, 21: 5, 30: 30, 31: 30, 40: 40, 41: 40}
    assert kept._read(kept._state()["heads"], "perceptual_hash long, ord long").count() == 5  # codes that were known add none


def test_nothing_was_added(spark, tmp_path):
    kept = GroupIndex(spark, f"file://{tmp_path}/groups")
    assert kept.groups().count() == kept.components().count() == 0
    kept.add(spark.createDataFrame([(1, None, 5)], CODES))
    assert kept.groups().count() == 0


def test_a_slice_opens_only_its_parts(spark, tmp_path):
    rows = [(i, None if i % 10 == 0 else (i * 37 % 50) / 50) for i in range(100)]
    ranked = scoring.ranked(spark.createDataFrame(rows, "ord long, composite_score double"))
    stored = Ranking.store(ranked, f"file://{tmp_path}/ranking", 8)
    order = [o for o, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for a, b in ((1, 8), (5, 12), (97, 140), (0, 3), (200, 300), (9, 8), (1, 100)):
        got = stored.slice(a, b)
        assert [r["ord"] for r in sorted(got.collect(), key=lambda r: r["rank"])] == order[max(a, 1) - 1 : b]
        assert len(got.inputFiles()) <= (max(0, b - a) // 8) + 2
    for s in (-1.0, 0.0, 0.3, 0.5, 0.98, 2.0):
        assert stored.above(s) == sum(v is not None and v > s for _, v in rows)


def test_an_empty_ranking_has_empty_slices(spark, tmp_path):
    stored = Ranking.store(scoring.ranked(spark.createDataFrame([], "ord long, composite_score double")), f"file://{tmp_path}/ranking")
    assert stored.slice(1, 50).count() == 0 and stored.above(0.5) == 0



def listed(spark, *names, size=10):
    return spark.createDataFrame([(n, None, size) for n in names], "path string, x string, file_size long").select("path", F.timestamp_seconds(F.lit(7)).alias("modified"), "file_size")


def test_kept_thumbnails_are_not_made_again(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def make(files):
        def run(frames):
            for f in frames:
                made.add(len(f))
                yield f.assign(thumb=[None if "bad" in p else "x" * 32 for p in f["path"]])[["path", "thumb"]]

        return files.mapInPandas(run, "path string, thumb string")

    t = Thumbnails(spark, f"file://{tmp_path}/thumbs", 64, 3 * (32 + 67), make)  # three of them
    get = lambda now, *names, **kw: {r["path"]: (r["thumb"] is not None, r["hit"]) for r in t.get(listed(spark, *names, **kw), now).collect()}
    assert get(1, "a", "b", "b", None) == {"a": (True, False), "b": (True, False)} and made.value == 2
    assert get(2, "a", "c", "d") == {"a": (True, True), "c": (True, False), "d": (True, False)} and made.value == 4
    assert {r["path"] for r in t.kept().collect()} == {"a", "c", "d"}  # b was used longest ago
    assert t.kept().agg(F.sum("bytes")).first()[0] <= t.capacity
    assert get(3, "b", "a") == {"a": (True, True), "b": (True, False)}
    assert get(4, "a", size=11) == {"a": (True, False)}  # a file that changed
    assert get(5, *"efgh") == dict.fromkeys("efgh", (True, False)) and t.kept().count() == 3  # more than fit come back all the same
    assert t.clear() == 3 and t.clear() == 0 and t.kept().count() == 0
    n = made.value
    assert get(6, "bad") == {"bad": (False, False)} and get(7, "bad") == {"bad": (False, True)} and made.value == n + 1
    assert get(8) == {}
