"""Lexical search, fingerprints and alignment against SQL, exact similarity and plain Python."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from grainfold.llm import alignment, lexical, sampling, tokencount

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
HARD = [None, "", " \n\t", "One", "one two ONE two one two one two", "Ünïcode ÜNÏCODE 漢字 z9", "\x00a\x00b", "word " * 3000, "x" * 20000, "<|endoftext|> <s> </s>", "  two  spaces\n\n", "🙂é\r\n"]


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        key = "doc_id" if name == "documents" else "item_id"
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    return con.execute(sql).fetchall()


# ---- 11 ----


def test_search_equals_sql_on_hard_rows(spark):
    docs = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, "tie tie words here") for i in range(45)] + [(200 + i, f"one two tie {'pad ' * i}") for i in range(30)]
    items = [(0, "one two"), (1, "TIE words tie"), (2, None), (3, "absent"), (4, "ünïcode 漢字 z9 word"), (5, "a b x" + "x" * 19999), (6, "tie " * 50 + "here one")]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "1 AS rank", "2 AS item_id").repartition(3)
    got = lexical.search(df, spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = oracle(lexical.ORACLE_SQL, documents=docs, benchmark=items)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60
    lots = lexical.search(df, spark.createDataFrame(items, ITEMS), most=15000)
    assert sorted(map(tuple, lots.collect())) == sorted(want)


def test_search_of_nothing_and_of_null_ids(spark):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(None, "alpha"), (None, "alpha"), (7, "beta"), (7, "alpha beta")], ITEMS)
    assert lexical.search(none, items).count() == 0 and lexical.search(none, spark.createDataFrame([], ITEMS)).count() == 0
    docs = spark.createDataFrame([(None, "alpha"), (None, "alpha"), (1, "alpha"), (2, "beta beta")], DOCS)
    got = sorted(map(tuple, lexical.search(docs, items).select("item_id", "rank", "doc_id").collect()), key=str)
    assert [r for r in got if r[0] is None] == [(None, 1, 1), (None, 2, None), (None, 3, None)]
    assert [r[2] for r in got if r[0] == 7].count(2) == 2


def test_sums_of_bitmaps_equal_plain_sums():
    rng = np.random.default_rng(5)
    value, weight = rng.integers(0, 10**6, (9, 200)), rng.integers(1, 30000, 9)
    flat = np.zeros((9, lexical.BITS, 256), bool)
    for b in range(lexical.BITS):
        flat[:, b, :200] = value >> b & 1
    maps = np.packbits(flat, axis=2, bitorder="little").view("<u8")
    made = lexical.multiplied(maps, weight, 45)
    s, c = made[:1], np.zeros_like(made[:1])
    for k in range(1, 9):
        s, c = lexical._add(s, c, made[k : k + 1])
    want = (value * weight[:, None]).sum(0)
    ids = rng.permutation(256)
    got = [(p, v) for _, p, v in lexical.best(lexical._settle(s, c), 200, ids)]
    assert dict(got) == {p: v for p, v in enumerate(want.tolist()) if v}
    top = {p for _, p, _ in lexical.best(lexical._settle(s, c), 20, ids)}
    assert top == set(sorted(range(200), key=lambda p: (-want[p], ids[p]))[:20])


# ---- 12 ----


def bag(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return collections.Counter([tuple(w)] if len(w) < 5 else list(zip(w, w[1:], w[2:], w[3:], w[4:])))


def jaccard(a, b):
    x, y = bag(a), bag(b)
    return sum(min(x[k], y[k]) for k in x | y) / sum(max(x[k], y[k]) for k in x | y)


def test_terms_are_weighted_shingles(spark):
    texts = ["a b c d e a b c d e a b c d e", "A  b\nc", "", " ", "same " * 40, "x y z w v u"]
    rows = sampling.with_terms(spark.createDataFrame(list(enumerate(texts)), DOCS), {"t": "text"}).collect()
    for r in rows:
        assert sorted(x & sampling._MOST for x in r["t"]) == sorted(bag(r["text"]).values()), r["text"]


def test_collisions_are_generalised_jaccard(spark):
    r = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 4000, n))
    texts = []
    for n in (60, 120, 180, 240, 300):
        for _ in range(4):
            a = word(n)
            texts += [(a, a[: len(a) // 2] + word(n // 2)), (a, a + " " + a), (a + " " + a + " " + a, a), (a, word(n))]
    df = spark.createDataFrame(list(enumerate(t for pair in texts for t in pair)), DOCS).repartition(4)
    prints = {x["doc_id"]: x["fingerprint"] for x in sampling.fingerprints(df).collect()}
    near = np.array([np.mean(np.array(prints[2 * k]) == np.array(prints[2 * k + 1])) for k in range(len(texts))])
    j = np.array([jaccard(a, b) for a, b in texts])
    assert np.abs(near - j).max() < 5 * 0.5 / np.sqrt(sampling.SAMPLES)
    for kind in range(4):  # twenty pairs each: 960 samples
        assert abs((near - j)[kind::4].mean()) < 4 * 0.5 / np.sqrt(20 * sampling.SAMPLES), kind


def test_edited_texts_and_hard_rows(spark):
    docs = [(3 * i, t) for i, t in enumerate([*HARD, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma delta epsilon zeta eta theta iota kappa"])]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "5 AS n", "'q' AS fingerprint", "0 AS id").repartition(3)
    got = {r["doc_id"]: r for r in sampling.compare_edited(df).collect()}
    assert len(got) == len(docs)
    texts = [t or "" for _, t in docs]
    for (i, _), t, nxt in zip(docs, texts, texts[1:] + texts[:1]):
        m = len(t) // 4
        r, new = got[i], t[: len(t) - m] + nxt[:m]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(t, new)) < 0.35 and abs(r["near_next"] - jaccard(t, nxt)) < 0.35
        if jaccard(t, nxt) in (0.0, 1.0):
            assert r["near_next"] == jaccard(t, nxt)
        if t == nxt:
            assert r["fingerprint"] == got[i + 3]["fingerprint"]
    odd = spark.createDataFrame([(None, "a b"), (1, "c d"), (1, "c d"), (1, "a e"), (4, "f g h i")], DOCS)
    rows = sampling.compare_edited(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 3), (1, 3), (1, 3), (4, 7)]
    four = next(r for r in rows if r["doc_id"] == 4)
    assert four["edited_sha256"] == hashlib.sha256(b"f g h a").hexdigest()  # the least text of the first id
    alone = sampling.compare_edited(spark.createDataFrame([(9, "lone words of one document")], DOCS)).first()
    assert alone["near_next"] == 1.0
    assert sampling.compare_edited(spark.createDataFrame([], DOCS)).count() == 0


def test_sampling_runs_without_python(spark):
    plan = sampling.fingerprints(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 13 ----


def aligned(rows):
    """Token by token, with the libraries named."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in tokencount._byte_chars().items()}
    docs, counts = [], collections.Counter()
    for d, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        x = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
        y = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            docs.append((d, 0, 0, [], []))
            continue
        ends = [set(np.cumsum(list(map(len, z))).tolist()) for z in (x, y)]
        groups, links, at = [], [], 0
        for cut in sorted(ends[0] & ends[1]):
            part = [[i for i, e in zip(ids, np.cumsum(list(map(len, z))).tolist()) if at < e <= cut] for ids, z in ((a, x), (b, y))]
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links.append((part[0][-1], part[1][-1]))
            at = cut
        counts.update(links)
        docs.append((d, len(a), len(b), groups, links))
    top = collections.defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(d, na, nb, len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), sha(g)) for d, na, nb, g, k in docs]


def test_alignment_equals_plain_python(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*HARD, "the cat sat on the mat", "the mat", "ﬁ ligature ½", "naïve café " * 40])]
    rows += [(2, " \n\t"), (13, "the mat"), (14, "another text under one id"), (None, "no id at all"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "1 AS h", "'x' AS ids").repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(aligned(rows), key=key)
    assert sorted(map(tuple, alignment.align(df, A, B).collect()), key=key) == want
    assert sorted(map(tuple, alignment.align(df, A, B, most=40).collect()), key=key) == want  # several passes
    assert any(r[1] == 0 and r[0] not in (None, 0, 1, 2) for r in want) or all(r[3] for r in want if r[0] == 14)
    assert alignment.align(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_windows_do_not_change_the_sweep():
    text = "ab cdé 漢字 " * 50
    sides = [alignment.side(alignment.ByteLevel, A), alignment.side(alignment.Pieces, B)]
    ids = [np.array(s.encode([text])[0], np.uint16) for s in sides]
    ends = [np.cumsum(s.lengths[x]) for s, x in zip(sides, ids)]
    got = []
    for width in (1, 7, 64, 10**6):
        s = alignment.Sweep()
        for w in range(int(max(e[-1] for e in ends)) // width + 1):
            s.window([x[e // width == w] for x, e in zip(ids, ends)], [x.lengths for x in sides])
        got.append((s.n, s.groups, s.digest.hexdigest(), np.sort(np.concatenate(s.held)).tolist()))
    assert all(g == got[0] for g in got) and got[0][1] > 100


# ---- 8: long pieces ----


def test_long_pieces_count_as_the_library_does():
    r = np.random.default_rng(8)
    letters = lambda n, k: "".join(map(chr, r.integers(97, 97 + k, n)))
    texts = [letters(200_000, 26), letters(3000, 2), "a" * 5001, "ab" * 2500 + "é" * 900, "one " + letters(1024, 26) + " two " + letters(1025, 26), "漢字" * 2000, ""]
    library = Tokenizer.from_file(A)
    assert tokencount.counter(A).count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], DOCS).selectExpr("doc_id", "text", "'x' AS n_tokens", "0 AS over_limit")
    got = tokencount.count_tokens(df, A)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 3, 2, False), (None, 0, 0, False)]
    assert tokencount.count_tokens(df.limit(0), A).count() == 0
