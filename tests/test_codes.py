"""The join of near codes by packed parts, against brute force."""

import numpy as np
import pytest

from grainfold.operators import codes, grouping
from grainfold.operators.increments import GroupIndex

CODES = "ord long, perceptual_hash long, capture_s long"


def near_each_other(n, seed=0):
    """Codes of at most three set bits: any two are within ten."""
    r = np.random.default_rng(seed)
    return sorted({sum(1 << int(k) for k in r.choice(60, 3, False)) for _ in range(2 * n)})[:n]


def components(n, edges):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        of[find(a)] = find(b)
    return [min(k for k in range(n) if find(k) == find(x)) for x in range(n)]


@pytest.mark.parametrize("small", [0, 1 << 24])
@pytest.mark.parametrize("threshold", [0, 2, 10, 40])
def test_near_pairs_are_those_of_brute_force(monkeypatch, small, threshold):
    monkeypatch.setattr(codes, "SMALL", small)
    monkeypatch.setattr(codes, "STEP", 500)
    r = np.random.default_rng(threshold)
    kinds = r.integers(0, 2**63, 5, dtype=np.uint64)
    flip = lambda n: np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (n, 8), dtype=np.uint64), axis=1)
    x, y = kinds[r.integers(0, 5, 60)] ^ flip(60), np.concatenate([kinds[r.integers(0, 5, 90)] ^ flip(90), kinds])
    want = {(i, j) for i in range(len(x)) for j in range(len(y)) if bin(int(x[i] ^ y[j])).count("1") <= threshold}
    got = [(int(a), int(b)) for i, j in codes._near(x, y, threshold, None) for a, b in zip(i, j)]
    assert len(got) == len(want) and set(got) == want
    of, kept = codes.Joined(len(x) + len(y)), []
    for i, j in codes._near(x, y, threshold, of):
        k = of.add(i, len(x) + j)
        kept += zip(i[k].tolist(), (len(x) + j[k]).tolist())
    both = len(x) + len(y)
    assert components(both, kept) == components(both, [(i, len(x) + j) for i, j in want])
    assert len(kept) == both - len(set(components(both, kept)))  # no edge too many


def test_groups_of_many_near_codes_need_few_links(spark):
    c = near_each_other(300)
    df = spark.createDataFrame([(k, v, None) for k, v in enumerate(c)], CODES)
    assert grouping.group_links(df).count() < 4 * len(c)  # not a link for each of their 45,000 pairs
    assert {tuple(x) for x in grouping.duplicate_groups(df).collect()} == {(k, 0) for k in range(len(c))}


def test_pairs_need_no_row_for_each_offer(spark):
    c = near_each_other(40)
    rows = [(k, v, None if k % 3 else 5 * k) for k, v in enumerate(c)] + [(100, c[0], None), (101, None, None), (None, c[1], None)]
    pairs = grouping.untimed_pairs(spark.createDataFrame(rows, CODES))
    assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
    code = {o: (v, t) for o, v, t in rows if o is not None and v is not None}
    assert {tuple(x) for x in pairs.collect()} == {(a, b) for a in code for b in code if a < b and (code[a][1] is None or code[b][1] is None) and bin(code[a][0] ^ code[b][0]).count("1") <= 10}
    assert pairs.count() == len(set(map(tuple, pairs.collect())))


def test_batches_of_many_near_codes_keep_few_links(spark, tmp_path, monkeypatch):
    c = near_each_other(200)
    seen = []
    plain = grouping.near_codes
    monkeypatch.setattr(grouping, "near_codes", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    kept = GroupIndex(spark, f"file://{tmp_path}/groups")
    kept.add(spark.createDataFrame([(k, v, None) for k, v in enumerate(c[:150])], CODES))
    kept.add(spark.createDataFrame([(150 + k, v, None) for k, v in enumerate(c[150:])], CODES))
    assert kept.groups().where("duplicate_group = 0").count() == len(c)
    assert len(seen) == 4 and all(x.count() < 2 * len(c) for x in seen)


def test_parts_are_cut_for_few_links(spark, monkeypatch):
    for n, m in ((51_282, 256_410), (615_000, 3_080_000), (10_000_000, 60_000_000), (0, 0), (5, 100), (100_000, 10)):
        p, q = codes._cut(n, m)
        assert -(-n // p) <= codes.LEFT and -(-m // q) <= codes.RIGHT
        assert p * q >= min(codes.WANTED, max(n, m) // codes.LEAST) and p * m + q * n <= max(24, -(-n // (1 << 16))) * m + -(-m // codes.RIGHT) * n + n
    assert all(p * 3_080_000 + q * 615_000 < 20_000_000 for p, q in [codes._cut(615_000, 3_080_000)])
    monkeypatch.setattr(codes, "LEAST", 20)
    c = near_each_other(480)
    near = grouping.near_codes(*(spark.createDataFrame([(v,) for v in x], f"{k} long") for k, x in (("l", c[::5]), ("r", c))), joined=True)
    got = near.collect()
    assert len(got) < 5 * len(c)  # 24 parts of the left would each tie all of the right
    assert set(components(len(c), [(c.index(a), c.index(b)) for a, b in got])) == {0}


def test_codes_are_made_without_moving_texts(spark, tmp_path, monkeypatch):
    from grainfold import registry
    from grainfold.plans.workspace import Workspace

    docs = [(k, f"{'so many words ' * (k % 3)}{k % 4}", "en", "web", 9) for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (1, 1, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # one twice
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: df)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for p in (registry._coded(spark, str(tmp_path)), registry._coded(spark, str(tmp_path), "ord", "capture_s"), registry.photos(spark, str(tmp_path)).drop("text")):
            todo, wide = [p._jdf.queryExecution().executedPlan()], []
            while todo:
                n = todo.pop()
                todo += [n.children().apply(i) for i in range(n.children().size())]
                if n.nodeName().startswith("Exchange"):
                    wide += [x.split("#")[0] for x in n.output().mkString(" ").split()]
            assert wide and "text" not in wide
        got = registry._coded(spark, str(tmp_path)).select("ord", "perceptual_hash").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    p = registry.photos(spark, str(tmp_path))
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in p.select("ord").join(grouping.text_grid_hash(p), "ord").collect()) and len(got) == 13


def shuffled_rows(spark, df):
    """Rows that the shuffles of ``df`` write."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    plan.execute().count()
    todo, rows = [plan], []
    while todo:
        n = todo.pop()
        todo += [n.children().apply(i) for i in range(n.children().size())]
        if n.nodeName().startswith("Exchange"):
            rows.append(n.metrics().apply("shuffleRecordsWritten").value())
    return rows


def test_codes_move_a_row_for_each_text(spark, monkeypatch):
    from hashlib import md5

    texts = [(k, " ".join(f"w{k}-{j}" for j in range(300))) for k in range(20)]
    df = spark.createDataFrame(texts, "ord long, text string").repartition(3)
    assert sum(shuffled_rows(spark, grouping.text_grid_hash(df))) <= 20 + len(texts)  # those of repartition, and one for each text
    odd = [(0, None), (1, ""), (2, " "), (3, "  a  B "), (4, "É \U0001f600 é"), (5, "a\nb\tc A B"), (6, "x " * 999), (1, "the same id again"), (None, "no id"), (-5, "one"), *texts[7:9]]
    monkeypatch.setattr(grouping, "CHUNK", 900)
    cells = {}
    for o, t in odd:
        c = cells.setdefault(o, [0] * 72)
        for w in (t or "").lower().split(" "):
            c[int(md5(w.encode()).hexdigest()[:4], 16) % 72] += 1
    code = {o: sum(1 << b for b in range(64) if c[9 * (b // 8) + b % 8] > c[9 * (b // 8) + b % 8 + 1]) for o, c in cells.items()}
    got = grouping.text_grid_hash(spark.createDataFrame(odd, "ord long, text string")).collect()
    assert len(got) == len(code) and {o: h % (1 << 64) for o, h in got} == code


def test_scored_rows_travel_with_what_is_asked_for(spark, tmp_path, monkeypatch):
    from grainfold import registry
    from grainfold.plans.workspace import Workspace

    docs = [(k, f"{'so many words ' * (k % 3)}{k % 4}", "en", "web", 9 + k % 5) for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in (1, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    written, plain = {}, Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.update({name: df}) or plain(self, df, name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for query, more in ((registry.ranked_group_markers, set()), (registry.group_winners, set()), (registry.pre_reject, {"exposure", "sharpness"})):
        query(spark, str(tmp_path))
        assert set(written["scored"].columns) == {"ord", "composite_score", "duplicate_group"} | more
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            todo, wide = [written["scored"].select("*")._jdf.queryExecution().executedPlan()], set()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        while todo:
            n = todo.pop()
            todo += [n.children().apply(i) for i in range(n.children().size())]
            if n.nodeName().startswith("Exchange"):
                wide |= {x.split("#")[0] for x in n.output().mkString(" ").split()}
        assert "composite_score" in wide and not wide & {"quality", "faces", "path", "width", "height", "aesthetic_mean"}


def test_codes_of_texts_met_once_are_not_shuffled(spark):
    texts = [(k, " ".join(f"w{k}-{j}" for j in range(30 * k))) for k in range(9)]
    df = spark.createDataFrame(texts, "ord long, text string")
    assert shuffled_rows(spark, grouping.text_grid_hash(df)) == []
    again = spark.createDataFrame([*texts, (99, "a"), (99, "b")], "ord long, text string")  # one ord twice: counts of all rows are added up
    got = {r["ord"]: r["perceptual_hash"] for r in grouping.text_grid_hash(again).collect()}
    assert got.pop(99) is not None and got == {r["ord"]: r["perceptual_hash"] for r in grouping.text_grid_hash(df).collect()}


def test_rounds_of_components_copy_no_minima_but_those_of_hubs(spark, tmp_path, monkeypatch):
    import random

    from grainfold.plans import components as cc
    from grainfold.plans.workspace import Workspace

    rng = random.Random(5)
    n = 600
    edges = [(k, k + 1) for k in range(300, 450)] + [(7, k) for k in range(500, n)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    want = components(n, edges)
    for hubs in (2, 1000):  # with 2, no node but 7 has as many edges; with 1000, all are hubs that have two
        monkeypatch.setattr(cc, "HUBS", hubs)
        df = spark.createDataFrame(edges, "src long, dst long")
        got = cc.connected_components(df, Workspace(spark, f"hubs{hubs}")).collect()
        assert len(got) == len({x for a, b in edges if a != b for x in (a, b)}) and all(want[r["node"]] == r["component"] for r in got)
    path = spark.createDataFrame([(k + 1, k) for k in range(2000)], "u long, v long")
    path.write.parquet(f"{tmp_path}/path")
    path = spark.read.parquet(f"{tmp_path}/path")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sum(shuffled_rows(spark, cc._large_star(path, 2))) < 5 * 2000  # minima 8 times over would be 16,000 rows more
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
