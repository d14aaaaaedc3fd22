"""Watched folders by versions, and files that are waited for."""

import os
import time

from grainfold.streaming import versions


def drain(spark, folder, log, checkpoint, table):
    def each(batch, k):
        batch.write.mode("overwrite").parquet(f"{table}/batch={k}")

    q = versions.versions(spark, folder, log).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    q.stop()
    return sorted((r["path"].rpartition("/")[2], r["file_size"]) for r in spark.read.parquet(table).collect())


def test_a_rewritten_file_comes_once_more_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.png").write_bytes(b"1")
    (folder / "deep/b.jpg").write_bytes(b"22")
    (folder / "notes.txt").write_bytes(b"no")
    args = (spark, f"file://{folder}", f"file://{tmp_path}/log", str(tmp_path / "ck"), str(tmp_path / "out"))
    assert drain(*args) == [("a.png", 1), ("b.jpg", 2)]
    assert drain(*args) == [("a.png", 1), ("b.jpg", 2)]
    (folder / "a.png").write_bytes(b"4444")
    (folder / "c.png").write_bytes(b"333")
    os.utime(folder / "c.png", (1, 1))  # of any age
    (folder / "deep/b.jpg").unlink()
    assert drain(*args) == [("a.png", 1), ("a.png", 4), ("b.jpg", 2), ("c.png", 3)]
    assert drain(*args) == [("a.png", 1), ("a.png", 4), ("b.jpg", 2), ("c.png", 3)]


def test_offsets_are_read_again_alike(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"1")
    make = lambda: versions.VersionReader(f"file://{tmp_path}/in", f"file://{tmp_path}/log")
    r = make()
    assert r.latestOffset() == {"files": 1} == r.latestOffset()
    (tmp_path / "in/a.png").write_bytes(b"12")
    assert make().latestOffset() == {"files": 2}
    read = lambda a, b: [row[:2] for p in make().partitions({"files": a}, {"files": b}) for row in make().read(p)]
    assert [s for _, s in read(0, 2)] == [1, 2] and read(1, 2) == read(0, 2)[1:] and read(2, 2) == []


def test_files_are_waited_for(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "done.png").write_bytes(b"whole")
    (folder / "grows.png").write_bytes(b".")
    (folder / "empty.png").write_bytes(b"")
    s = versions.whole_files(versions.versions(spark, f"file://{folder}", f"file://{tmp_path}/log"), quiet_s=4, most_s=10)
    q = s.writeStream.format("memory").queryName("waited").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "ck")).start()
    began, got = time.time(), {}
    while time.time() - began < 90 and len(got) < 3:
        if "grows.png" not in got:
            with open(folder / "grows.png", "ab") as f:
                f.write(b".")
        time.sleep(0.3)
        got = {r["path"].rpartition("/")[2]: (r["file_size"], r["stable"]) for r in spark.table("waited").collect()}
    until = time.time() + 60  # the last writes make a wait of their own
    while time.time() < until and spark.table("waited").count() < 4:
        time.sleep(0.5)
    state = 1
    while time.time() < until + 20 and state:
        time.sleep(0.5)
        state = (q.lastProgress or {}).get("stateOperators", [{"numRowsTotal": 1}])[0]["numRowsTotal"]
    rows = [(r["path"].rpartition("/")[2], r["file_size"], r["stable"]) for r in spark.table("waited").collect()]
    q.stop()
    assert got["done.png"] == (5, True) and got["empty.png"] == (0, False) and got["grows.png"][1] is False
    assert rows.count(("done.png", 5, True)) == 1 and state == 0
    assert [r[2] for r in rows if r[0] == "grows.png"][-1] is True
    assert max(r[1] for r in rows if r[0] == "grows.png") == (folder / "grows.png").stat().st_size
