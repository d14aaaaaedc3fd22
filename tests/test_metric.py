"""The metric join and two-phase clustering, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.functions.formulas import hamming
from grainfold.operators import grouping, metric, persons

SCHEMA = "ord long, embedding array<double>"


def units(rng, n, d, kinds=0, noise=0.1):
    v = rng.standard_normal((n, d))
    if kinds:
        v = rng.standard_normal((kinds, d))[rng.integers(0, kinds, n)] + noise * v
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def brute(v, least):
    s = v @ v.T
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= least}


def table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], SCHEMA)


@pytest.mark.parametrize("least,d,kinds", [(0.4, 16, 0), (0.8, 8, 20), (0.95, 3, 0), (1e-3, 4, 5)])
def test_pairs_are_those_of_brute_force(spark, monkeypatch, least, d, kinds):
    monkeypatch.setattr(metric, "CELL", 30)
    monkeypatch.setattr(metric, "BLOCK", 25)
    v = units(np.random.default_rng(d), 400, d, kinds)
    got = metric.similar_pairs(table(spark, v), least).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == brute(v, least)


def test_copies_of_one_vector_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK", 20)
    v = np.concatenate([np.tile([[0.6, 0.8]], (130, 1)), units(np.random.default_rng(1), 40, 2)])
    df = table(spark, v)
    got = metric.similar_pairs(df, 0.999)
    assert {(r["a"], r["b"]) for r in got.collect()} == brute(v, 0.999)
    x, y, n = metric.blocks(df, 0.999)
    assert x.groupBy("cell", "i", "j").count().agg(F.max("count")).first()[0] < 60  # of 130 copies
    assert n >= 49


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL", 30)
    v = units(np.random.default_rng(2), 600, 12, kinds=25, noise=0.03)
    r = metric.block_report(table(spark, v), 0.95).first()
    assert r["rows"] == 600 and r["share_of_all"] < 0.5 and r["copies"] < 1800


def test_rows_without_a_usable_vector_have_no_pairs(spark):
    nan = float("nan")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [3.0, 0.0]), (9, [0.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash"))
    assert sorted(tuple(r) for r in metric.similar_pairs(df, 0.5).collect()) == [(5, 6, 1.0), (5, 8, 3.0), (6, 8, 3.0)]
    assert metric.similar_pairs(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        metric.similar_pairs(df, 0.0)


def test_codes_as_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 12)
    codes = [int(np.bitwise_xor(b, sum(np.int64(1) << np.int64(k) for k in rng.choice(62, 4, False)))) for b in base for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(codes)), "ord long, perceptual_hash long")
    got = metric.similar_pairs(df.withColumn("v", metric.code_vector(F.col("perceptual_hash"))), 1 - grouping.THRESHOLD / 32, vector="v")
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, F.col("a.ord") < F.col("b.ord")).where(hamming(F.col("a.perceptual_hash"), F.col("b.perceptual_hash")) <= grouping.THRESHOLD)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(r[0], r[1]) for r in want.select("a.ord", "b.ord").collect()}


def two_phase(v, blocks, threshold):
    """The stated rule in plain Python: ord to person."""
    centroid, size, of = {}, {}, {}
    for b in sorted(set(blocks)):
        found = []  # centroid, count, first ord
        for o in [k for k in range(len(v)) if blocks[k] == b]:
            sims = [c @ v[o] for c, _, _ in found]
            k = int(np.argmax(sims)) if sims else -1
            if sims and sims[k] > threshold:
                c, n, f = found[k]
                c = (c * n + v[o]) / (n + 1)
                found[k] = (c / np.linalg.norm(c), n + 1, f)
            else:
                k = len(found)
                found.append((v[o], 1, o))
            of[o] = found[k][2]
        centroid |= {f: c for c, _, f in found}
        size |= {f: n for _, n, f in found}
    heads = []
    for f in sorted(centroid, key=lambda f: (-size[f], f)):
        if all(centroid[f] @ centroid[h] <= threshold for h in heads):
            heads.append(f)
    of_leader = {f: f if f in heads else max(heads, key=lambda h: (centroid[f] @ centroid[h], -h)) for f in centroid}
    number = {f: k for k, f in enumerate(sorted(heads))}
    return {o: number[of_leader[f]] for o, f in of.items()}


@pytest.mark.parametrize("kinds,noise,threshold", [(9, 0.2, 0.6), (0, 1.0, 0.45)])
def test_two_phase_clusters_follow_the_rule(spark, kinds, noise, threshold):
    v = units(np.random.default_rng(kinds), 240, 10, kinds, noise)
    df = table(spark, v)
    blocks = [r[0] for r in df.orderBy("ord").select(persons.person_block(240)).collect()]
    got = {r["ord"]: r["person_id"] for r in persons.cluster_persons_two_phase(df, threshold).collect()}
    assert got == two_phase(v, blocks, threshold)
    if kinds:  # clear groups: as in one pass
        one = {r["ord"]: r["person_id"] for r in persons.cluster_persons(df, threshold).collect()}
        same = [(got[a] == got[b]) == (one[a] == one[b]) for a in got for b in got if a < b]
        assert np.mean(same) > 0.95


def test_two_phase_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(3, None), (4, []), (5, [1.0, 0.0]), (6, [1.0, 0.0])], SCHEMA)
    assert {r["ord"]: r["person_id"] for r in persons.cluster_persons_two_phase(df).collect()} == {3: None, 4: None, 5: 0, 6: 0}
    assert persons.cluster_persons_two_phase(df.limit(0)).count() == 0


def test_classes_count_the_links_of_copies(spark):
    v = np.concatenate([np.tile([[0.6, 0.8]], (30, 1)), units(np.random.default_rng(8), 50, 2)])
    df = table(spark, v).unionAll(spark.createDataFrame([(100, None), (101, [])], SCHEMA))
    got = {r["ord"]: (r["head"], r["links"]) for r in metric.similar_classes(df, 0.97).collect()}
    near = brute(v, 0.97)
    want = {k: (0 if k < 30 else k, sum(k in p for p in near)) for k in range(80)} | {100: (None, 0), 101: (None, 0)}
    assert got == want
