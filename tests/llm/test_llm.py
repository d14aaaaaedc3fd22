"""Each operator against its library, an exact round trip, or brute force, and on hard rows."""

import base64
import hashlib
import io
import json
import random
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainfold.plans.workspace import Workspace
from grainfold.llm import bpe, chat, decontam, langid, licenses, linedup, media, ngramjoin, pieces, queries, shingles, tokencount, warc

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string"
ODD = ["", " ", "\n", "a  b", " a ", "\n\n a b  c\n", "x" * 3000, "ab" * 700, "don't  we'll\t ok", "漢字 é\x1c\x85 🙂", "<|endoftext|>a <|endoftext|>", "\x00z", "same same " * 200]


def noise(n, seed=1):
    r = random.Random(seed)
    al = "ab  \n\t'stre09é \x1c 漢字🙂-.,$%\r\x85ñß<|>\\"
    return ["".join(r.choice(al) for _ in range(r.randrange(80))) for _ in range(n)]


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def same(df, sql, **tables):
    cols, want = oracle(sql, **tables)
    got = df.select(*cols).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# ---- 1 ----


def test_bpe_equals_the_library():
    c = bpe.codec(RANKS, P.PATTERN)
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    texts = ODD + noise(1500) + ["word" * 100 + " " + "w" * 400]
    for t, ids in zip(texts, c.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == e.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_memo_is_bounded_in_bytes():
    c, whole = bpe.Codec(RANKS, P.PATTERN), bpe.codec(RANKS, P.PATTERN)
    small = pieces.WordMemo(P.PATTERN, c._encode_pieces, 30_000)
    texts = noise(300) + [" ".join("q" * 20_000 + str(i) for i in range(20)), "odd  " + "z" * 9_000 + "\n\n x"]
    assert [x for t in texts for x in small.encode([t])] == whole.encode(texts) == small.encode(texts)
    r = random.Random(5)
    for _ in range(40):
        small.encode([" ".join("".join(r.choice("abcdefgh") for _ in range(r.choice([3, 9, 5000]))) for _ in range(60))])
    held = [k for m in (small.words, small.pieces) for d in (m.young, m.old) for k in d]
    assert max(map(len, held)) <= pieces.LONGEST and sum(map(len, held)) < 60_000


def test_bpe_frames(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "x" * 20000)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    got = bpe.digest_frame(df, RANKS, P.PATTERN).collect()
    assert len(got) == 5 and {r["n_tokens"] for r in got if r["doc_id"] in (None, 2)} == {0}
    assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(got, rows))
    assert bpe.digest_frame(df.limit(0), RANKS, P.PATTERN).count() == 0
    ids = bpe.encode_frame(df, RANKS, P.PATTERN).select("bpe_ids").collect()
    assert len(ids[0][0]) == got[0]["n_tokens"] and ids[2][0] == []
    again = bpe.encode_frame(df.withColumn("bpe_ids", F.lit("clash")), RANKS, P.PATTERN)
    assert again.columns == [*df.columns, "bpe_ids"] and [r["bpe_ids"] for r in again.collect()] == [r[0] for r in ids]


# ---- 2 ----


def test_line_dedup_equals_sql(spark):
    long = "This line is long enough to count as a shared one."
    rows = [(i, f"{long}\nown {i}\n  {long.upper()}\t\n{long}" if i % 2 else f"short\n\n{long} {i // 3}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "é" * 45 + "\n"), (104, ("word " * 2000 + "\n") * 20)]
    df = spark.createDataFrame(rows, DOCS)
    got = linedup.drop_common_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    same(got, linedup.ORACLE_SQL, documents=df)


def test_line_dedup_hard_rows(spark):
    long = "x" * 50
    rows = [(i, long) for i in range(6)] + [(None, long), (5, long)]
    df = spark.createDataFrame(rows, DOCS).withColumn("k", F.lit(1)).withColumn("n_dropped", F.lit("clash"))
    got = linedup.drop_common_lines(df)
    assert got.columns == ["doc_id", "text", "k", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None and r["text"]) == [(5, long), (5, long)]
    assert [r["text"] for r in got.collect() if r["doc_id"] is None] == [""]
    assert linedup.drop_common_lines(df.limit(0)).count() == 0


# ---- 3 ----


def brute_matches(docs, items):
    out = set()
    for d, t in docs:
        h = decontam.word_runs(t)
        for i, x in items:
            y = decontam.word_runs(x)
            if not len(h) or not len(y):
                continue
            m = min(len(h), len(y))
            if max(decontam.similarity(h[s : s + m], y) for s in range(len(h) - m + 1)) >= 0.8:
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.randrange(14, 60)))) for i in range(12)] + [(90, None), (91, "one two"), (92, "")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.randrange(5, 150))]
        if d % 2:
            p = items[r.randrange(12)][1].split()
            for _ in range(r.randrange(0, 4)):
                p[r.randrange(len(p))] = word()
            w[10:10] = [x.upper() if d % 4 == 1 else x for x in p]
        docs.append((d, ", ".join(w)))
    docs += [(500, None), (501, ""), (502, "One, two!"), (503, items[0][1]), (503, items[0][1]), (504, " ".join([items[1][1]] * 30))]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find(df, bench).collect()}
    assert got == brute_matches(docs, items) and len(got) > 20
    left = {x["doc_id"] for x in decontam.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert decontam.find(df, bench.limit(0)).count() == 0 and decontam.clean(df, bench.limit(0)).count() == len(docs)
    n, lots = decontam._lots(bench, 500)
    assert n > 1 and sorted(x for p in lots for x, _ in p) == sorted(i for i, _ in items)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.find(df, bench, most=1500).collect()} == got
    assert {x["doc_id"] for x in decontam.clean(df, bench, most=1500).collect()} == left


def test_decontamination_hard_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, item), (1, "Long " * 40_000 + item.upper()), (2, item.replace(" ", "\n")), (3, "今日は天気がいいから散歩しましょうと彼は言った。"), (4, f"{item} {item}"), (5, "one two")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("item_id", "similarity", "start")})
    bench = spark.createDataFrame([(1, item), (None, item), (1, item), (7, "天気がいいから散歩しましょう"), (8, "One, two")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted(map(tuple, decontam.find(df, bench).collect()), key=str)
    want = [(d, i, 1.0, s) for d, s in ((None, 0), (1, 40_000), (2, 0), (4, 0)) for i in (1, 1, None)] + [(3, 7, 1.0, 3), (5, 8, 1.0, 0)]
    assert got == sorted(want, key=str)
    left = decontam.clean(df.unionAll(df.withColumn("text", F.lit(None).cast("string"))), bench)
    assert left.columns == df.columns and [r["text"] for r in left.collect()] == [None] * len(rows)


def test_blocks_find_everything_within_the_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**63, (50, 4)).astype(np.uint64)
    index = decontam.HammingIndex(prints)
    queries, want = [], set()
    for q in range(200):
        x, owner = prints[q % 50].copy(), q % 50
        for b in r.choice(decontam.BITS, decontam.RADIUS + q % 2, replace=False).tolist():  # one bit too many in every second
            x[b // 64] ^= np.uint64(1 << (b % 64))
        queries.append(x)
        want |= set() if q % 2 else {(q, owner)}
    assert set(zip(*map(list, index.near(np.array(queries))))) == want
    some = r.integers(0, 2**63, (400, 4)).astype(np.uint64)
    assert len(index.candidates(some)) < 0.25 * 400 * 50  # the blocks select


# ---- 4 ----

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</turn><turn user>x\\b\\l\\"), (1, 2, "user", None), (1, 3, "assistant", "a\nb"), (2, 0, "sys>t<em\\", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "tie"),
    (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (4, 0, None, "no role"), (5, 0, "user", "only"), (6, None, "user", "é🙂"), (6, 1, "assistant", "é🙂"),
]
CONV = "conv_id long, turn long, role string, text string"


def test_chat_equals_sql_and_reads_back(spark):
    df = spark.createDataFrame(TURNS, CONV)
    same(chat.digests(df), chat.ORACLE_SQL.replace("UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'", "").replace("UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'", ""), conversations=df.where("turn IS NOT NULL OR conv_id <> 6").unionAll(df.where("turn IS NULL").withColumn("turn", F.lit(-1).cast("long"))))
    back = {}
    for r in chat.read_back(chat.transcripts(df)).withColumn("text", chat.unescape(F.col("body"))).orderBy("turn_no").collect():
        back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert back[1] == [(r, t or "") for c, _, r, t in TURNS if c == 1] and back[2] == [("sys>t<em\\", "x")]
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_examples(spark):
    df = spark.createDataFrame([*TURNS, (None, 0, "user", "q"), (None, 1, "assistant", "no conversation")], CONV)
    t = chat.transcripts(df).withColumn("turn_no", F.lit("clash"))
    full = {r["conv_id"]: r["transcript"] for r in t.collect()}
    got = chat.write_out(t, chat.examples(t).withColumn("transcript", F.lit("clash"))).collect()
    assert len(got) == 1 + sum(r == "assistant" for _, _, r, _ in TURNS)
    for r in got:
        whole = r["prompt"] + r["target"]
        assert full[r["conv_id"]].startswith(whole) and whole[r["loss_end"] :] == "</turn>" and r["prompt"].endswith("<turn assistant>")


def test_chat_losses_come_from_the_contexts(spark):
    df = spark.createDataFrame(TURNS, CONV)
    t = chat.transcripts(df)
    e = chat.examples(t)
    right = {r["conv_id"]: r for r in chat.digest_turns(t, e).collect()}
    for wrong in (e.withColumn("context_chars", F.col("context_chars") + 1), e.withColumn("loss_end", F.col("loss_end") - 1)):
        bad = {r["conv_id"]: r for r in chat.digest_turns(t, wrong).collect()}
        assert bad[1]["loss_sha256"] != right[1]["loss_sha256"] and bad[-7]["loss_sha256"] != right[-7]["loss_sha256"]
        assert {k: r["turns_sha256"] for k, r in bad.items()} == {k: r["turns_sha256"] for k, r in right.items()}
    names = {x.split(" ")[0] for x in chat.digests(df)._jdf.queryExecution().optimizedPlan().toString().replace("+-", "").replace(":-", "").split("\n") for x in [x.strip(" :")]}
    assert "Window" in names


def test_chat_hard_rows(spark):
    rows = [(1, 0, "user", "a" * 50_000), (1, 1, "assistant", "<" * 50_000), (1, 1, "assistant", "<" * 50_000), (None, None, None, None), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, CONV).withColumn("conv", F.lit("clash")).withColumn("transcript", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 100_000 and got[1]["formatted_chars"] == 50_000 + 200_000 + len("<turn user></turn><turn assistant></turn><turn assistant></turn>")
    assert got[None]["n_turns"] == 2 and got[None]["loss_sha256"] == hashlib.sha256(b"x").hexdigest()


# ---- 5 ----


def test_media_round_trip():
    r = np.random.default_rng(1)
    for kind, shape in (("pgm", (7, 5)), ("ppm", (7, 5, 3)), ("bmp", (7, 5)), ("bmp", (7, 5, 3))):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode(a, kind)) == a).all()
    assert (media.decode(b"P2 # note\n2 1\n255\n7 9") == [[7, 9]]).all()
    small = bytearray(media.encode(np.full((3, 3), 200, np.uint8), "bmp"))
    small[46:50] = (16).to_bytes(4, "little")  # a palette of 16 entries
    for bad in (b"", b"P5 3 3 255\n12", b"BM", b"P5 1 1 70000\n1", b"P5 0 0 255\n", b"P5 -1 -1 255\n1", b"P2 1 1 255\n256", b"P2 1 1 9\n10", b"P2 1 1 255\nx", bytes(small)):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_broken_media_raise_value_errors_only():
    r = random.Random(8)
    whole = [media.encode(np.full(s, 77, np.uint8), k) for k, s in (("pgm", (4, 6)), ("ppm", (4, 6, 3)), ("bmp", (4, 6)), ("bmp", (4, 6, 3)))] + [b"P3 2 1\n255\n1 2 3 4 5 6"]
    for _ in range(3000):
        b = bytearray(r.choice(whole))
        for _ in range(r.randrange(1, 4)):
            b[r.randrange(min(60, len(b)))] = r.randrange(256)
        try:
            a = media.decode(bytes(b[: r.randrange(len(b) + 1)] if r.random() < 0.3 else b))
            assert a.size and a.dtype == np.uint8 and len(media.dhash(a)) == 16
        except ValueError:
            pass


def plain_mean(a, h, w):
    """Area means by exact overlaps, pixel by pixel."""
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y0, y1, x0, x1 = i * a.shape[0] / h, (i + 1) * a.shape[0] / h, j * a.shape[1] / w, (j + 1) * a.shape[1] / w
            for y in range(int(y0), min(int(np.ceil(y1)), a.shape[0])):
                for x in range(int(x0), min(int(np.ceil(x1)), a.shape[1])):
                    out[i, j] += a[y, x] * max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x))
    return out * h * w / a.size


def test_media_features_equal_a_plain_form(spark, monkeypatch):
    texts = [None, "", "é🙂" * 300, "abc" * 900, "line\n" * 500]
    got = media.text_media(spark.createDataFrame(list(enumerate(texts)), DOCS), with_tile=True).collect()
    for r, t in zip(got, texts):
        b = (t or "").encode()
        b += b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        kind = ("pgm", "ppm", "bmp")[zlib.crc32(b) % 3]
        if kind == "pgm":
            file, gray = b"P5\n24 %d\n255\n" % (len(b) // 24) + b, np.frombuffer(b, np.uint8).reshape(-1, 24)
        else:
            rgb = np.frombuffer(b, np.uint8).reshape(-1, 24, 3)
            gray = rgb @ [0.299, 0.587, 0.114]
            file = b"P6\n24 %d\n255\n" % len(rgb) + b
            if kind == "bmp":
                body = rgb[::-1, :, ::-1].tobytes()
                file = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 24, len(rgb), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
        assert (r["kind"], r["media_bytes"], r["media_sha256"]) == (kind, len(file), hashlib.sha256(file).hexdigest())
        g = plain_mean(gray, 8, 9).round(6)
        assert r["feature"] == np.packbits(g[:, :-1] > g[:, 1:]).tobytes().hex()
        tile = np.load(io.BytesIO(r["tile"]))
        each = [plain_mean(gray, 8, 8)] if kind == "pgm" else [plain_mean(rgb[:, :, c], 8, 8) for c in range(3)]
        assert np.abs(tile.reshape(8, 8, -1) - np.stack(each, 2)).max() <= 0.5 + 1e-6 and r["tile_sha256"] == hashlib.sha256(r["tile"]).hexdigest()
    tall = np.random.default_rng(2).integers(0, 256, (100, 24), dtype=np.uint8)
    whole = media.area_resize(tall, 8, 9)
    monkeypatch.setattr(media, "STRIP", 7)
    assert np.allclose(media.area_resize(tall, 8, 9), whole) and np.allclose(whole, plain_mean(tall, 8, 9))


def test_area_resize_is_a_mean():
    a = np.arange(48, dtype=np.float64).reshape(6, 8)
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(a, 4, 5).mean(), a.mean()) and np.allclose(media.area_resize(np.full((2, 3), 7.0), 9, 8), 7)
    assert np.load(__import__("io").BytesIO(media.npy_tile(a))).shape == (8, 8)


def test_media_frames(spark):
    rows = [(i, t) for i, t in enumerate([None, *ODD, "a" * 576, "a" * 577, "w" * 300_000])] + [(0, None), (None, "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("media", F.lit("clash")).withColumn("n_bytes", F.lit("clash"))
    for r, (i, t) in zip(media.text_media(df).collect(), rows):
        b = (t or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(b), len(p)) and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-32:])
    assert media.text_media(df.limit(0)).count() == 0
    assert media.describe(spark.createDataFrame([(1, None)], "doc_id long, media binary"), keep=("doc_id",)).first()["feature"] is None


def test_a_broken_file_is_an_error_row(spark):
    files = [(1, b"P5 1 1 255 "), (2, b"P5 1 1 255 x"), (3, b""), (4, None), (5, b"BMnothing")]
    got = {r["doc_id"]: r for r in media.describe(spark.createDataFrame(files, "doc_id long, media binary"), keep=("doc_id",), with_tile=True).collect()}
    assert {k for k, r in got.items() if r["error"]} == {1, 3, 5} and all(got[k]["payload_bytes"] is None and got[k]["tile"] is None for k in (1, 3, 4, 5))
    assert got[2]["payload_bytes"] == 1 and got[2]["tile"] is not None


# ---- 6 ----


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def plain_language(model, text):
    """The rule in full, by zstandard's plain interface: every size computed anew."""
    kept = langid.regex.sub(r"[^\p{L}\p{M}]+", " ", text or "").strip().lower()
    if not any(c.isalpha() for c in kept):
        return "und", 0.0, False
    b = f" {kept} ".encode()

    def sizes(parts):
        out = []
        for content in model.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            out.append(sum(len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(x)) for x in parts))
        return out

    count = -(-len(b) // langid.BLOCK)
    step = -(-len(b) // count)
    parts = [b[k * step : (k + 1) * step] for k in range(count) if b[k * step :]]
    whole = sizes(parts)
    looked = [whole]
    if len(parts) > 1:
        looked += [sizes(parts[: len(parts) // 2]), sizes(parts[len(parts) // 2 :])]
    elif len(b) >= langid.HALVES_FROM:
        at = b.rfind(b" ", 0, len(b) // 2)
        at = at + 1 if at >= 0 else 0
        at = at or len(b) // 2
        looked += [sizes([b[:at]]), sizes([b[at:]])]
    k = whole.index(min(whole))
    score = 1 / sum(2.0 ** (-(s - whole[k]) * 8 / langid.TEMPER) for s in whole)
    rivals = [min(s for j, s in enumerate(x) if j != k) for x in looked]
    return list(model)[k], score, all((r - x[k]) / x[k] >= langid.MIN_MARGIN for r, x in zip(rivals, looked))


def test_language_id_equals_the_plain_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(texts) and any(r["accepted"] for r in got)
    for r in got:
        lang, score, ok = plain_language(model, texts[r["doc_id"]])
        assert (r["lang_pred"], r["accepted"]) == (lang, ok) and abs(r["score"] - score) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_id_hard_rows(spark):
    model = {"en": b" the cat and the dog went to the house ", "de": b" der hund und die katze gingen in das haus "}
    rows = [(1, None), (2, ""), (3, "12 $%"), (4, "und die katze und der hund"), (5, "THE DOG AND THE CAT " * 5000), (None, "the house")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, DOCS).withColumn("lang", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "de" and got[5]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    empty = spark.createDataFrame([], DOCS + ", lang string")
    assert langid.identify(empty).count() == 0


def test_language_id_rejects_narrow_margins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    c = langid.Classifier(langid.fit(docs))
    rng = random.Random(3)
    own = docs.where("length(text) BETWEEN 600 AND 4000 AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2").orderBy("doc_id").select("text", "lang").collect()
    by = {k: [r["text"] for r in own if r["lang"] == k] for k in ("en", "fr")}
    mixed = [f"{rng.choice(by['en'])[:600]} {rng.choice(by['fr'])[:600]}" for _ in range(60)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (30, 200, 1000, 9000) for _ in range(25)]
    share = lambda ts: sum(c.classify(t)[2] for t in ts) / len(ts)
    assert share(mixed) < 0.1 and share(junk) < 0.02 and share([r["text"] for r in own]) > 0.95
    just_over = [(t + " ") * 9 for t in by["en"][:40]]
    just_over = [t[: langid.BLOCK + 40] for t in just_over if len(t) > langid.BLOCK + 40]
    assert len(just_over) > 20 and share(just_over) == 1  # a short last block does not count as a half
    two = langid.Classifier({"a": b" one two three ", "b": b" one two three "})
    assert two.classify("one two three") == ("a", 0.5, False)


def test_language_id_keeps_clashing_columns_apart(spark):
    model = {"en": b" the cat and the dog went to the house ", "de": b" der hund und die katze gingen in das haus "}
    df = spark.createDataFrame([(1, "the cat and the dog"), (1, "the cat and the dog")], DOCS).withColumns({c: F.lit("clash") for c in ("lang_pred", "score", "accepted")})
    got = langid.predict(df, model, keep=df.columns)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "accepted"] and {r["lang_pred"] for r in got.collect()} == {"en"} and got.count() == 2


# ---- 7 ----


def plain_licences(rows):
    m, out = licenses.model(), []
    for d, t in rows:
        for n, p in enumerate(licenses.paragraphs(t or "")):
            family, prob = m.predict(p)
            if family != licenses.UNKNOWN and prob >= licenses.LEAST_PROBABILITY and licenses.cover(p, family) >= licenses.LEAST_COVER:
                out.append((d, n, family, round(licenses.cover(p, family), 6)))
    return out


#: Whole notices as files carry them, a line per paragraph, and other wordings that the model has not seen.
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "This repository is published under the MIT license, see LICENSE for details.",
    ],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Copying is allowed under the 3-clause BSD license."],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The tool is licensed under version 3 of the GNU General Public License.",
    ],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Published under the Apache License, Version 2.0, by its authors."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by-4.0": ["This article is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["The pictures are licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the authors have waived all copyright and related or neighboring rights to this work."],
}
PROSE = [
    "The station had a license to sell coffee, and the public could use the library next to it free of charge.", "Version 3 of the report was released in May; the terms of the contract were not published.",
    "MIT and other universities distribute copies of their general course material without charge.", "Any person who finds a source of clean water may use it subject to local law.", "The foundation of the house was modified under the terms of the new permission.",
    "International commons and the creative arts: an attribution of works.", "The file was written in binary form and the software could not obtain a copy.", "He granted permission to include the above notice in all later editions.",
]


def test_licences_equal_the_plain_form_and_sql(spark):
    own = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = [(i, f"Some prose here.\n{t}\nmore") for i, t in enumerate(own)] + [(100, None), (101, ""), (102, "\n".join(licenses.OTHERS)), (0, "Some prose.\n" + own[0]), (None, own[0]), (103, own[0] + "\x01" + own[5]), (104, "\n\n \t\r\n\n" + own[1] + "\n\n"), (105, "word " * 60_000 + own[4])]
    df = spark.createDataFrame(rows, DOCS).withColumn("p", F.lit("clash")).withColumn("w", F.lit("clash")).withColumn("family", F.lit("clash"))
    got = licenses.scan(df)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["paragraph_no"], r["family"], r["template_cover"]) for r in got.collect()), key=key) == sorted(plain_licences(rows), key=key)
    same(got, licenses.oracle_sql(), documents=df)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["family"])
    assert all(by.get(i) == {f} for i, f in enumerate(f for f, ts in licenses.TEMPLATES.items() for _ in ts)) and not {100, 101, 102} & set(by)
    assert by[103] == {"apache-2.0", "mit"} and by[None] == {"apache-2.0"} and len(by[104]) == len(by[105]) == 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_licences_are_found(spark):
    rows, want = [], {}
    for f, ts in NOTICES.items():
        for t in ts:
            for width in (30, 50, 72, 10_000):
                for mark in ("", " * ", "# ", "// "):
                    lines = [mark + x for x in textwrap.wrap(t, width)]
                    rows.append((len(rows), "\n".join(["First comes a line of prose.", *lines, "", PROSE[len(rows) % len(PROSE)]])))
                    want[len(rows) - 1] = f
    rows += [(10_000 + i, t) for i, t in enumerate(PROSE)] + [(20_000, "\n".join(PROSE)), (20_001, " ".join(PROSE))]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["family"])
    found = sum(got.get(d) == {f} for d, f in want.items()) / len(want)
    assert found >= 0.9 and all(got.get(d, {f}) == {f} for d, f in want.items()) and not [d for d in got if d >= 10_000]
    for f in ("mit", "bsd-3-clause", "gpl-3.0"):
        assert all(got.get(d) == {f} for d, x in want.items() if x == f and rows[d][1].count("\n") > 4)


def test_neighbouring_licences_are_not_named():
    own = [
        "This program is licensed under the GNU Affero General Public License version 3.", "You may use this file under the terms of the GNU Affero General Public License.",
        "The text is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Available under CC BY-ND 4.0.", "This code is released under the 2-clause BSD license.",
        "Use of this source code is governed by the BSD 2-Clause License.", "Permission to use, copy, modify and distribute this software for any purpose with or without fee is granted.",
        "Licensed under the ISC license.", "Distributed under the Eclipse Public License v. 2.0.", "This file is subject to the terms of the Eclipse Public License, v. 2.0.",
        "Text is available under the Creative Commons Attribution 3.0 License.", "This library is licensed under the GNU Lesser General Public License version 2.1.", "Released under the Artistic License version 2.0.",
    ]
    for t in [*own, *licenses.NEIGHBOURS]:
        family, p = licenses.model().predict(t)
        assert family == licenses.UNKNOWN or p < licenses.LEAST_PROBABILITY or licenses.cover(t, family) < licenses.LEAST_COVER, t
    assert not set(own) & set(licenses.NEIGHBOURS)


def test_licence_probabilities_are_calibrated():
    m = licenses.model()
    assert licenses.GRID[0] < m.temperature < licenses.GRID[-1] and m.predict("")[0] == m.predict("xyz qwerty")[0] == licenses.UNKNOWN
    held = [(t, f) for f, ts in licenses.HELD_OUT.items() for t in ts]
    assert sum(m.predict(t)[0] == f for t, f in held) >= 0.9 * len(held) and len({t for t, _ in held} & {t for ts in licenses.TEMPLATES.values() for t in ts}) == 0


# ---- 8 ----


def test_token_counts_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    c, t = tokencount.counter(path), Tokenizer.from_file(path)
    texts = ODD + noise(1500, 2)
    assert c.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_frames(spark):
    rows = [(1, "a" * 9000), (None, None), (2, "é"), (2, "é")]
    got = [tuple(r) for r in tokencount.count_tokens(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.json")).collect()]
    assert got[1] == (None, 0, 0, False) and got[2] == got[3] and got[2][1] == 2 and got[0][3]


# ---- 9 ----


def variants(seed, n, groups):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(r.choice([3, 8, 30, 80]))] for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = word()
        out.append((i * 3 % (3 * n + 1), " ".join(w)))
    return out


def brute_components(docs):
    sets = [shingles.shingle_set(t) for _, t in docs]
    p = list(range(len(docs)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if len(sets[i]) and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                p[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(docs)}


def test_links_equal_brute_force():
    for seed in range(40):
        docs = list({t: (d, t) for d, t in variants(seed, 40, 3)}.values())
        sets = {shingles.set_key(s): s for s in (shingles.shingle_set(t) for _, t in docs)}
        sets = list(sets.values())
        links = ngramjoin.link_sets(sets)
        p = list(range(len(sets)))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in links:
            p[find(a)] = find(b)
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    assert find(i) == find(j)
        for a, b in links:
            k = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)


@pytest.mark.parametrize("most", [ngramjoin.FAMILY_MOST, 400])
def test_components_equal_brute_force(spark, most):
    docs = variants(7, 150, 4) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  two"), (1005, "one"), (1006, "w " * 30)]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.components(df, most).collect()}
    assert got == brute_components(docs)


def test_components_hard_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)]
    got = sorted((tuple(r) for r in ngramjoin.components(spark.createDataFrame(docs, DOCS)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    assert ngramjoin.components(spark.createDataFrame([], DOCS)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in ngramjoin.keep_first(spark.createDataFrame(docs, DOCS)).collect()) == [0, 1, 3]
    clash = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("clash") for c in ("s1", "s2", "n", "token", "family", "kept", "component_id", "n_shingles")})
    assert sorted((tuple(r) for r in ngramjoin.components(clash).collect()), key=str) == got and ngramjoin.keep_first(clash).columns == clash.columns


def test_one_doc_id_with_two_texts_loses_no_link(spark):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:59], "x"])), (3, " ".join([*b[:59], "x"])), (4, " ".join([*a[:58], "y", "z"])), (5, "c " * 40)]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_a_very_long_text_and_a_hot_group(spark):
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(30_000))
    rows = [(0, long), (1, long + " more words at the end"), *[(10 + i, f"{i % 3} the same passage of some words stands in a great many rows of this table and goes on {i % 40} to its end") for i in range(400)]]
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.components(spark.createDataFrame(rows, DOCS).repartition(3), 3000).collect()}
    assert got == brute_components(rows)


# ---- 10 ----


def test_warc_equals_sql(spark):
    rows = [(i, f"http://x/{i}", None if i % 9 == 0 else "" if i % 7 == 0 else f"<p>é {i % 5}</p>") for i in range(60)] + [(99, None, "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    same(warc.round_trip(spark, df), warc.ORACLE_SQL, pages=df)
    assert warc.round_trip(spark, df.limit(0)).count() == 0
    assert warc.round_trip(spark, df, 1).where("record_type = 'revisit' AND payload_bytes = 0").count() == 0


def test_warc_hard_rows(spark):
    rows = [(None, None, "x"), (None, "u", "x"), (1, "u\r\nv", "x"), (2, None, "x"), (2, None, "x"), (1, None, "x"), (3, "", None), (3, "", "other"), (4, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("id", "d", "f", "h", "first", "body", "sha1", "n", "refers_to", "name")})
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, df).collect()), key=str)
    want = [(None, 1, "response", None)] * 2 + [(1, 1, "revisit", 2)] * 2 + [(2, 1, "response", None)] * 2 + [(3, 0, "revisit", 4), (3, 5, "response", None), (4, 0, "response", None)]
    assert got == sorted(want, key=str)


def test_warc_reads_committed_archives_only(spark):
    ws = Workspace(spark, "t")
    pages = spark.createDataFrame([(i, None, f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").repartition(3)
    plan = warc.plan_records(pages, ws)
    folder = f"{ws.path}/archives"
    warc.write_archives(plan, folder, 500).collect()  # an attempt whose names were not kept
    names = ws.write(warc.write_archives(plan, folder, 500), "names")
    assert names.count() > 5 and names.select("name").distinct().count() == names.count()
    assert sorted(r["page_id"] for r in warc.read_archives(names, folder).collect()) == list(range(40))


def test_warc_reader_checks():
    http = [("WARC-Type", "response"), ("Content-Type", warc.HTTP)]
    a = warc.record([*http, ("WARC-Payload-Digest", "sha1:" + warc.digest(b"abc\r\n\r\n"))], warc.http_response(b"abc\r\n\r\n"))
    b = warc.record([("WARC-Type", "revisit")], b"")
    big = bytes(random.Random(1).randrange(256) for _ in range(200_000))
    c = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.digest(big))], big)
    assert [x for _, x in warc.records(io.BytesIO(a + b + c + a))] == [b"abc\r\n\r\n", b"", big, b"abc\r\n\r\n"] and not list(warc.records(io.BytesIO(b"")))
    assert warc.digest(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    for bad in (a[:-5], b"text", a + b"text", warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:X")], b"abc"), warc.record(http, b"abc")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(bad)))


# ---- pipeline and queries ----


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
    left = {r["doc_id"] for r in out}
    assert 0 < len(out) == len(left) <= docs.count()
    bad = {r["doc_id"] for r in decontam.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not bad & left


def test_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (None, "The cat and the dog.", "en", "s", 20), (2, "The cat and the dog.", "en", "s", 20), (2, "The cat and the dog.", "en", "s", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for d in (df, df.limit(0)):
            got = stage(spark, d, SF)
            assert got.count() <= d.count()
            if name != "byte_bpe":
                assert got.columns == df.columns


def test_queries_are_named_by_their_number():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert numbers == list(range(1, 14)) and set(queries.oracles()) <= set(queries.QUERIES)
    assert all(f.__name__ == n and f.__doc__ for n, f in queries.QUERIES.items())
