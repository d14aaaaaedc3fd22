"""Ranked lexical search over a bit-sliced impact index.

Documents lie in segments of at most SEGMENT_DOCS.  For each term that the
queries ask for, a segment holds a bitmap for each bit of the term's impact: bit
d of bitmap b says whether bit b of the impact in document d is set.  A search
multiplies impacts by the term's weight (shifted copies, added), adds the terms
of an item by bitwise carry arithmetic, all documents of a segment at once, and
finds the best by descending from the most significant sum bitmap: a document
stays a candidate as long as too many others share its leading bits.

The impact of a term that occurs tf times in a document of n terms is
(10^9 tf) div (1000 tf + 12 m), with m = 100 - 25 + (25 n N) div L; a term's
weight is floor(1000 ln((2N + 2) / (2 df + 1))).  All is exact.

The queries are a stated set against all documents: a lot of them, of at most
PASS_CHARS characters, is known to every task; more of them take more passes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm.memory import tidy
from grainfold.plans.workspace import Workspace

#: Bits of an impact, which is less than 10^6.
BITS = 20
#: A segment ends at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 2_000_000
#: Characters of query text in a pass, and queries and term products that a search holds at once.
PASS_CHARS, ITEMS, PRODUCTS = 8 << 20, 64, 1024
#: Parts that a query's best of all segments are first ranked in.
PARTS = 64

#: A-Z to a-z, and what is neither letter, digit nor beyond ASCII to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8; a null text has none."""
    return (text or "").encode().translate(_FOLD).split()


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with at least one term, and the terms of all with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], names=["n", "l"])

    got = docs.select(text).mapInArrow(tidy(run), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


class Segment:
    """Postings of up to SEGMENT_DOCS documents, and their bitmaps."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.m: list[int] = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.tfs: list[int] = []

    def add(self, doc: int | None, found: Counter, m: int) -> None:
        self.ids.append(doc)
        self.m.append(m)
        self.sizes.append(len(found))
        self.terms += found.keys()
        self.tfs += found.values()

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or len(self.terms) >= SEGMENT_POSTINGS

    def bitmaps(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(term, documents that hold it, BITS bitmaps of 64-bit words) of each term."""
        at = np.repeat(np.arange(len(self.ids)), self.sizes)
        term, tf = np.array(self.terms, np.int64), np.array(self.tfs, np.int64)
        m = np.array(self.m, np.int64)[at]
        impact = (10**9 * tf) // (1000 * tf + 12 * m)
        by = np.argsort(term, kind="stable")
        term, at, impact = term[by], at[by], impact[by]
        values, starts, counts = np.unique(term, return_index=True, return_counts=True)
        wide = -(-len(self.ids) // 64) * 64
        step = max(1, (16 << 20) // (BITS * wide))
        for k in range(0, len(values), step):
            part = slice(starts[k], starts[k] + counts[k : k + step].sum())
            flat = np.zeros((len(values[k : k + step]), BITS, wide), bool)
            row = np.repeat(np.arange(len(flat)), counts[k : k + step])
            for b in range(BITS):
                flat[row, b, at[part]] = impact[part] >> b & 1
            words = np.packbits(flat, axis=2, bitorder="little").view("<u8")
            yield from zip(values[k : k + step].tolist(), counts[k : k + step].tolist(), words)


def build(docs: DataFrame, vocabulary: dict[bytes, int], size: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: rows (segment, term, df, body) of terms, and a row (segment, null, null, null, ids) for each segment's documents.

    Every document is indexed, by the terms of ``vocabulary``, whose size the caller bounds.
    Documents without such a term cannot be found and have no place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    total, length = size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pack = shared.value, zstandard.ZstdCompressor(level=1).compress
        base, done, now = TaskContext.get().partitionId() << 32, 0, Segment()
        names = ["segment", "term", "df", "body", "ids"]

        def closed(s: Segment) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            held = 0
            for t, df, words in s.bitmaps():
                rows.append((t, df, pack(words.tobytes())))
                held += len(rows[-1][2])
                if held > 4 << 20:
                    yield batch(rows, [None] * len(rows))
                    rows, held = [], 0
            yield batch([*rows, (None, None, None)], [None] * len(rows) + [s.ids])

        def batch(rows: list[tuple], ids: list) -> pa.RecordBatch:
            t, df, body = zip(*rows)
            cols = [pa.array([base + done] * len(rows), pa.int64()), pa.array(t, pa.int32()), pa.array(df, pa.int32()), pa.array(body, pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = terms(t)
                found = Counter([known[w] for w in words if w in known])
                if not found:
                    continue
                now.add(d, found, 75 + 25 * len(words) * total // length)
                if now.full():
                    yield from closed(now)
                    done, now = done + 1, Segment()
        if now.ids:
            yield from closed(now)

    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(tidy(run), "segment long, term int, df int, body binary, ids array<long>")


def _add(s: np.ndarray, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition: three bit-sliced numbers (slices on the second axis, least first) become a sum and its carries."""
    t = s ^ c
    carry = np.zeros_like(c)
    carry[:, 1:] = ((s & c) | (t & x))[:, :-1]
    return t ^ x, carry


def _settle(s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The sum of two bit-sliced numbers, the carry rippling from slice to slice."""
    out, carry = np.empty_like(s), np.zeros_like(s[:, 0])
    for b in range(s.shape[1]):
        t = s[:, b] ^ c[:, b]
        out[:, b] = t ^ carry
        carry = (s[:, b] & c[:, b]) | (t & carry)
    return out


def multiplied(x: np.ndarray, weight: np.ndarray, bits: int) -> np.ndarray:
    """Bit-sliced numbers times a whole number each, as ``bits`` slices: shifted copies, added."""
    s = np.zeros((len(x), bits, x.shape[2]), np.uint64)
    c = np.zeros_like(s)
    for b in range(int(weight.max()).bit_length()):
        rows = np.flatnonzero(weight >> b & 1)
        if len(rows):
            shifted = np.zeros((len(rows), bits, x.shape[2]), np.uint64)
            n = min(x.shape[1], bits - b)
            shifted[:, b : b + n] = x[rows, :n]
            s[rows], c[rows] = _add(s[rows], c[rows], shifted)
    return _settle(s, c)


def best(sums: np.ndarray, k: int, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, place, sum) of the k highest sums above 0 of each row, by descending slices; of equal ones those of the lowest place in ``ids``' order.

    ``ids`` gives each place's rank among all ids.
    """
    sure = np.zeros_like(sums[:, 0])
    maybe = np.bitwise_or.reduce(sums, 1)
    for b in range(sums.shape[1] - 1, -1, -1):
        has = maybe & sums[:, b]
        more = sure | has
        many = (np.bitwise_count(more).sum(1) > k)[:, None]
        sure, maybe = np.where(many, sure, more), np.where(many, has, maybe & ~sums[:, b])
    places = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    for i in range(len(sums)):
        at, tied = places(sure[i]), places(maybe[i])
        at = np.concatenate((at, tied[np.argsort(ids[tied], kind="stable")][: k - len(at)]))
        bit = sums[i][:, at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
        score = (bit.astype(np.int64) << np.arange(len(bit))[:, None]).sum(0)
        yield from ((i, p, v) for p, v in zip(at.tolist(), score.tolist()))


def search_segment(held: dict[int, bytes], weights: dict[int, int], ids: list[int | None], items: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int | None, int]]:
    """(item, doc_id, score) of the best ``k`` documents of a segment for each item, given as (term, occurrences)."""
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))] = np.arange(len(ids))
    unpack, words = zstandard.ZstdDecompressor().decompress, -(-len(ids) // 64)
    asked = [[(t, n * weights[t]) for t, n in x if weights.get(t)] for x in items]
    asking = sorted((i for i, x in enumerate(asked) if x), key=lambda i: len(asked[i]))
    for at in range(0, len(asking), ITEMS):
        group = asking[at : at + ITEMS]
        bits = max(sum(w for _, w in asked[i]) << BITS for i in group).bit_length()
        s = np.zeros((len(group), bits, words), np.uint64)
        c = np.zeros_like(s)
        slots = sorted({x for i in group for x in asked[i]})
        for lo in range(0, len(slots), PRODUCTS):
            part = slots[lo : lo + PRODUCTS]
            maps = np.frombuffer(b"".join(unpack(held[t]) for t, _ in part), "<u8").reshape(len(part), BITS, words)
            product = multiplied(maps, np.array([w for _, w in part], np.int64), bits)
            product = np.concatenate((product, np.zeros_like(product[:1])))  # the last one stands for no term
            where = {x: n for n, x in enumerate(part)}
            rows = [[where[x] for x in asked[i] if x in where] for i in group]
            width = max(map(len, rows))
            table = np.array([r + [len(part)] * (width - len(r)) for r in rows])
            for j in range(width):
                s, c = _add(s, c, product[table[:, j]])
        for i, place, score in best(_settle(s, c), k, order):
            yield group[i], ids[place], score


def _lots(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in lots of bounded size, collected one after another."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= most else -(-2 * chars // most)
    lot = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for j in range(n):
        yield [tuple(r) for r in items.where(lot == j).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = 20, most: int = PASS_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item, of equal scores those of the least doc_id.

    Documents that score 0 do not appear, so an item without a known term has no
    rows.  Null texts have no terms.  Every row of ``docs`` is a document, rows
    of one id too; a null doc_id comes after all others.  Repeated items
    (id and text) count once; rows of one item_id with different texts are
    ranked each by itself.  Empty tables give no rows.  Only ids and texts are read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lexical")
    src = items.select("item_id", "text").distinct()
    kind = src.schema["item_id"].dataType.simpleString()
    size = corpus_size(docs)
    out = []
    for lot, rows in enumerate(_lots(src, most)):
        bags = [Counter(terms(t)) for _, t in rows]
        vocabulary = {w: n for n, w in enumerate(sorted(set().union(*bags)))}
        asked = [[(vocabulary[w], n) for w, n in bag.items()] for bag in bags]
        if not vocabulary or not size[1]:
            continue
        index = ws.write(build(docs, vocabulary, size), f"index-{lot}")
        out.append(ws.write(_searched(index, [r[0] for r in rows], asked, size[0], k, kind), f"found-{lot}").withColumn("lot", F.lit(lot)))
        ws.drop(f"index-{lot}")
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.unionAll(x)
    best_first = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for by in (["lot", "item", "part"], ["lot", "item"]):  # the best of each part first, so that no item's rows of all segments meet
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _searched(index: DataFrame, item_ids: list, asked: list[list[tuple[int, int]]], total: int, k: int, kind: str) -> DataFrame:
    """(item, item_id, part, doc_id, score): the best of every segment."""
    df = index.where("term IS NOT NULL").groupBy(F.col("term").alias("t")).agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * total + 2) / (2 * F.col("n") + 1))).cast("long")
    weights = df.select("t", weight.alias("w"))
    shared = index.sparkSession.sparkContext.broadcast((item_ids, asked))
    rows = index.join(weights, F.col("term") == F.col("t"), "left").where("term IS NULL OR w > 0").select("segment", "term", "body", "w", "ids")
    schema = pa.schema([("item", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_pylist() for c in ("term", "body", "w")}
        ids = next(x for x in t.column("ids").to_pylist() if x is not None)
        held = {a: b for a, b in zip(col["term"], col["body"]) if a is not None}
        weights = {a: w for a, w in zip(col["term"], col["w"]) if a is not None}
        got = list(search_segment(held, weights, ids, shared.value[1], k))
        part = key[0].as_py() % 1_000_003 % PARTS
        return pa.Table.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([part] * len(got), pa.int32()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], schema=schema)

    found = rows.groupBy("segment").applyInArrow(run, "item int, part int, doc_id long, score long")
    names = index.sparkSession.createDataFrame([(n, x) for n, x in enumerate(item_ids)], f"n int, item_id {kind}")
    return found.join(names, F.col("item") == F.col("n")).drop("n")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY 1),
s AS (
  SELECT q.item_id, p.doc_id, sum(q.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * n.n * c.docs) // c.len))))::BIGINT AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term JOIN n ON n.doc_id = p.doc_id CROSS JOIN c GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
