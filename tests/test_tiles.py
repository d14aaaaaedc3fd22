"""The vector join writes no copies of rows and makes no row for a pair that is only counted."""

import numpy as np
import pytest

from grainfold.operators import metric
from grainfold.plans.workspace import Workspace


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that a workspace writes."""
    rows, plain = {}, Workspace.write

    def write(self, df, name):
        out = plain(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "write", write)
    return rows


def unrelated(spark, n=300, d=16):
    v = np.random.default_rng(7).standard_normal((n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "ord long, embedding array<double>")


def test_pairs_write_no_copies(spark, monkeypatch, written):
    monkeypatch.setattr(metric, "CELL", 10)
    v, df = unrelated(spark)
    s = np.triu(v @ v.T, 1)
    assert {(r["a"], r["b"]) for r in metric.similar_pairs(df, 0.4).collect()} == set(zip(*(k.tolist() for k in np.nonzero(s >= 0.4))))
    assert max(written.values()) <= len(v)


def test_tiles_meet_in_bundles(spark, monkeypatch):
    for name, value in (("CELL", 10), ("BLOCK", 30), ("SIDES", 3)):
        monkeypatch.setattr(metric, name, value)
    v, df = unrelated(spark)
    both = df.unionAll(df.selectExpr("ord + 1000", "slice(embedding, 1, 8)"))
    c = metric.Cells(both, 0.4, "ord", "embedding")
    t = c.tiles()[0]
    assert t.count() <= 3 < c.rows.select("cell", "part").distinct().count()  # a row sent to Python for two bundles, not for two tiles
    monkeypatch.setattr(metric, "BUNDLE", 5000)
    got = [(r["a"], r["b"]) for r in metric.similar_pairs(both, 0.4).collect()]
    want = {(a + k, b + k) for k, m in ((0, v), (1000, v[:, :8])) for a, b in zip(*(i.tolist() for i in np.nonzero(np.triu(m @ m.T, 1) >= 0.4)))}
    assert len(got) == len(want) and set(got) == want


def test_classes_write_no_pairs(spark, monkeypatch, written):
    monkeypatch.setattr(metric, "CELL", 10)
    v, df = unrelated(spark)
    links = (v @ v.T >= 0.05).sum(1) - 1
    assert {r["ord"]: r["links"] for r in metric.similar_classes(df, 0.05).collect()} == dict(enumerate(links.tolist()))
    assert max(written.values()) <= len(v)


def test_report_writes_counts_only(spark, monkeypatch, written):
    monkeypatch.setattr(metric, "CELL", 30)
    v, df = unrelated(spark)
    r = metric.block_report(df, 0.4).first()
    assert r["rows"] == len(v) and r["copies"] > 2 * len(v) and max(written.values()) <= len(v)
    assert r["compared"] <= len(v) * (len(v) - 1) / 2


def test_report_makes_no_row_for_a_copy(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL", 30)
    v, df = unrelated(spark)
    c = metric.Cells(df.unionAll(df.selectExpr("ord + 1000", "slice(embedding, 1, 1)")), 0.7, "ord", "embedding")
    want = {tuple(r) for r in metric._copies(c).groupBy("cell", "own", "j").count().collect()}
    monkeypatch.setattr(metric, "_copies", None)
    assert {tuple(r) for r in metric._sizes(c)[2].collect()} == want
    may, rows = c.reach(), [(r["cell"], r["part"], np.array(r["x"])) for r in c.rows.collect()]
    cells, got = {r[0] for r in rows}, {}
    for own, j, x in rows:
        for cell in cells:
            if cell <= own and may(cell, own, x[None])[0]:
                got[cell, own, j] = got.get((cell, own, j), 0) + 1
    assert want == {(*k, n) for k, n in got.items()} and sum(got.values()) < len(rows) * len(cells) / 2


@pytest.mark.parametrize("long", [1.0, 1e20, 1e-3])
def test_candidates_miss_nothing_near_the_bound(long):
    r = np.random.default_rng(3)
    x = r.standard_normal((80, 64)) * long
    d = metric._dots(x, x, *(k.ravel() for k in np.indices((80, 80))))
    least = float(np.sort(d[d > 0])[500])  # some pair's own dot product
    got = set()
    for i, j, sure in metric._near(x, x, least, None):
        assert (metric._dots(x, x, i[sure], j[sure]) >= least).all()
        got |= set(zip(i.tolist(), j.tolist()))
    assert {(k // 80, k % 80) for k in np.flatnonzero(d >= least).tolist()} <= got
