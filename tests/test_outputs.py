"""Committed outputs: staging, manifest, clashes, failures, cancelling, events and moves."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from grainfold.operators import cache
from grainfold.sources import outputs

RESULT = "path string, crop_id string, out_path string, width int, height int, bytes binary, ok boolean, error string"


def rows(spark, *given):
    return spark.createDataFrame([(p, c, o, 1, 1, b, b is not None, None if b is not None else "bad") for p, c, o, b in given], RESULT)


def placed(root):
    return {str(f.relative_to(root)): f.read_bytes() for f in root.rglob("*") if f.is_file() and not str(f.relative_to(root)).startswith("_") and not f.name.endswith(".crc")}


def test_a_part_is_staged_then_placed_with_its_manifest(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = rows(spark, ("a", None, "web/a.png", b"1"), ("a", "sq", "web/a__sq.png", b"22"), ("b", None, "web/b.png", None), ("c", None, "web/x.png", b"3"), ("d", None, "web/x.png", b"4"), (None, None, None, None))
    assert outputs.manifest(spark, root).count() == 0
    outputs.stage(df, root, "p0")
    assert placed(tmp_path) == {}
    got = {(r["path"], r["crop_id"]): (r["state"], r["error"], r["size"]) for r in outputs.publish(spark, root, "p0").collect()}
    assert placed(tmp_path) == {"web/a.png": b"1", "web/a__sq.png": b"22"}
    assert got[("a", "sq")] == ("ok", None, 2) and got[("b", None)][:2] == ("error", "bad") and got[("c", None)][1] == got[("d", None)][1] == outputs.TAKEN
    files = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    assert [r[0] for r in cache.pending(files, outputs.manifest(spark, root)).collect()] == ["e"]
    outputs.stage(rows(spark, ("e", None, "web/a.png", b"9"), ("a", None, "web/a.png", b"7")).where("path = 'e'"), root, "p1")
    assert outputs.publish(spark, root, "p1").first()["error"] == outputs.TAKEN
    assert placed(tmp_path)["web/a.png"] == b"1"
    outputs.stage(df.limit(0), root, "p2")
    assert outputs.publish(spark, root, "p2").count() == 0
    assert not (tmp_path / "_staging/p0").exists()


def test_a_failing_task_leaves_nothing_and_a_second_attempt_gives_the_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = rows(spark, *[(str(k), None, f"o/{k}", b"x" * k) for k in range(20)]).repartition(4)
    broken = df.withColumn("error", F.when(F.col("path") == "13", F.raise_error(F.lit("lost"))).otherwise(F.col("error")))
    with pytest.raises(Exception, match="lost"):
        outputs.stage(broken, root, "p")
    assert placed(tmp_path) == {} and outputs.recover(spark, root) == []
    assert not list((tmp_path / "_staging").glob("*")) if (tmp_path / "_staging").exists() else True
    outputs.stage(df, root, "p")
    # the driver is lost in the middle of the moves: some files are placed, and no manifest is written
    lists = spark.read.parquet(*[str(f) for f in (tmp_path / "_staging/p").glob("*/list")]).where("path IN ('3', '4')").collect()
    for r in lists:
        assert outputs.place(r["staged"], f"{root}/{r['out_path']}", r["size"]) is None
    assert len(lists) == 2 and outputs.recover(spark, root) == ["p"] and outputs.recover(spark, root) == []
    assert placed(tmp_path) == {f"o/{k}": b"x" * k for k in range(20)}
    assert outputs.manifest(spark, root).where("state = 'ok'").count() == 20


def _make(files, wait=0.0):
    def run(frames):
        import time as t

        for f in frames:
            t.sleep(wait)
            yield f.assign(crop_id=None, out_path=["o/" + p for p in f["path"]], width=1, height=1, bytes=[p.encode() for p in f["path"]], ok=[p != "f7.png" for p in f["path"]], error=None)

    return files.select("path").mapInPandas(run, RESULT)


def test_a_cancelled_batch_keeps_its_parts_and_goes_on(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = spark.createDataFrame([(f"f{k}.png",) for k in range(30)] + [("v.mp4",)], "path string")
    calls = []

    def slow(some):
        calls.append(1)
        return _make(some, 0.0 if len(calls) == 1 else 60.0)

    b = outputs.Batch(spark, root, slow, part_files=8)
    end = []
    from pyspark import InheritableThread

    t = InheritableThread(target=lambda: end.append(b.run(files)))
    t.start()
    for _ in range(600):
        if len(calls) > 1:
            break
        time.sleep(0.1)
    time.sleep(2)
    began = time.time()
    b.cancel()
    t.join(60)
    assert end == ["cancelled"] and time.time() - began < 50
    kept = outputs.manifest(spark, root).select("path").distinct().count()
    assert 0 < kept < 31 and len(placed(tmp_path)) == outputs.manifest(spark, root).where("state = 'ok'").count()
    assert threading.active_count() < 50
    assert outputs.Batch(spark, root, _make, part_files=16).run(files) == "done"
    assert len(placed(tmp_path)) == 30
    assert outputs.Batch(spark, root, _make).run(files.limit(0)) == "done"
    n = {r["kind"]: r["count"] for r in outputs.events(spark, root).groupBy("kind").count().collect()}
    assert n["file_done"] == 30 and n["file_failed"] == 1 and n["batch_cancelled"] == 1 and n["batch_started"] == 1 and n["batch_resumed"] == 2 and n["batch_done"] == 2
    assert outputs.events(spark, root).where("is_video").select("path").collect()[0][0] == "v.mp4"


def test_moves_are_logged_and_can_be_repeated(spark, tmp_path):
    for n in ("a.png", "b.png", "c.png", "k.png"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "rejects").mkdir()
    (tmp_path / "rejects/c.png").write_bytes(b"old")
    at = lambda n: f"file://{tmp_path}/{n}"
    given = [(1, at("a.png"), "Reject"), (2, at("b.png"), "Reject"), (3, at("c.png"), "Reject"), (4, at("k.png"), "Keep"), (5, at("none.png"), "Reject"), (6, at("rejects/old.png"), "Reject"), (7, None, "Keep")]
    p = spark.createDataFrame(given, "ord long, path string, status string")
    log = f"file://{tmp_path}/log"
    p2, out, report = outputs.move_rejects(p, log)
    want = {1: at("rejects/a.png"), 2: at("rejects/b.png"), 3: at("c.png"), 4: at("k.png"), 5: at("none.png"), 6: at("rejects/old.png"), 7: None}
    state = lambda: {f.name: f.read_bytes() for f in [*tmp_path.glob("*.png"), *tmp_path.glob("rejects/*.png")]}
    first = state()
    assert {r["ord"]: r["path"] for r in p2.collect()} == want
    told = report.first()
    assert told.asDict() == {"considered": 5, "moved": 2, "failed": 2}
    assert first == {"a.png": b"a.png", "b.png": b"b.png", "c.png": b"old", "k.png": b"k.png"} and (tmp_path / "c.png").read_bytes() == b"c.png"
    # interrupted between the intent and the end: one file is moved, one is copied and not yet removed
    for f in (tmp_path / "log/done").iterdir():
        f.unlink()
    (tmp_path / "b.png").write_bytes(b"b.png")
    p3, _, again = outputs.move_rejects(p, log)
    assert {r["ord"]: r["path"] for r in p3.collect()} == want and state() == first and again.first() == told


def test_moves_of_one_target_and_of_nothing(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    p = spark.createDataFrame([(1, f"file://{tmp_path}/a.png", "Reject"), (2, f"file://{tmp_path}/a.png", "Reject")], "ord long, path string, status string")
    _, out, report = outputs.move_rejects(p, f"file://{tmp_path}/log")
    assert {r["error"] for r in out.collect()} == {outputs.TAKEN} and report.first()["failed"] == 2 and (tmp_path / "a.png").exists()
    assert outputs.move_rejects(p.limit(0), f"file://{tmp_path}/log2")[2].first().asDict() == {"considered": 0, "moved": 0, "failed": 0}
