"""N-gram Jaccard self-join over a prefix tree, and the groups it links.

A document's set is its distinct 5-word shingles; two documents link where the
Jaccard similarity is at least 0.8.  No link between different sets is lost:

1.  One scan names each set (128 bits), sizes it, and counts shingles that occur
    again and again.  Documents of one set are one class from here on.
2.  By the prefix principle, two linked sets share several of each one's first
    1.5 p shingles by value, where p = n - ceil(0.8 n) + 1: these are dealt out by
    value (those on a bounded list of frequent ones salted as well), and a set
    that shares too few of them with any other set links with nothing.
    What is left, the active sets, is ordered exactly: by how many active sets
    hold a shingle, then by value.  Each is tied to the first active set with
    the same shingle among its first p: a star, never all pairs.  Components of
    the stars are *families*; linked sets are of one family.
3.  Families are joined one by one: the sets, as ordered arrays, stand in a
    compressed prefix tree.  A set descends it once for all others, shares the
    partial overlap of every common path, and leaves a subtree that its
    remaining length cannot lift to the threshold, or that is linked with it
    already.  What comes out is a forest of links.
4.  A family too large for one task is cut into blocks, which are joined each by
    itself together with a few common sets; then only sets outside the family's
    largest group meet the other blocks.

Everything between the steps is a table in the shared folder.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.llm.memory import release, tidy
from grainfold.llm.shingles import set_key, shingle_set
from grainfold.plans.components import connected_components
from grainfold.plans.workspace import Workspace

#: Link where NUM * union <= DEN * intersection, that is similarity >= 0.8.
NUM, DEN = 4, 5
#: The list of frequent shingles (it decides where rows go, not what is found): bounded in length, and what a task adds to it.
FREQUENT_MOST, FREQUENT_LEAST, LOCAL_LEAST, LOCAL_MOST = 262_144, 24, 3, 65_536
SALTS = 16
#: Shingles of a family that one task joins, and sets that all blocks of a larger one share.
FAMILY_MOST, PIVOTS = 2_000_000, 16


class FrequentCounts:
    """Counts of shingles in one task, in bounded memory; rare ones are forgotten as it goes on."""

    def __init__(self, chunk: int = 1 << 20):
        self.chunk, self.size, self.sets = chunk, 0, []
        self.values, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.sets.append(s)
        self.size += len(s)
        if self.size >= self.chunk:
            self._fold()

    def _fold(self) -> None:
        h = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        h.sort()
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        n = np.diff(np.append(at, len(h)))
        values = np.concatenate((self.values, h[at][n >= 2]))
        counts = np.concatenate((self.counts, n[n >= 2]))
        self.values, back = np.unique(values, return_inverse=True)
        self.counts = np.bincount(back, counts, len(self.values)).astype(np.int64)
        if len(self.values) > LOCAL_MOST:
            top = np.sort(np.argpartition(self.counts, -LOCAL_MOST)[-LOCAL_MOST:])
            self.values, self.counts = self.values[top], self.counts[top]
        self.sets, self.size = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        keep = self.counts >= LOCAL_LEAST
        return self.values[keep], self.counts[keep]


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, s1, s2) of documents, and rows (token, count) of shingles that a task saw often."""
    names = ["doc_id", "n", "s1", "s2", "token", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = FrequentCounts()
        seen: set[tuple[int, int]] = set()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                s = shingle_set(t)
                key = set_key(s)
                rows.append((len(s), *key))
                if key not in seen:  # copies count once a task
                    often.add(s)
                    if len(seen) < 1_000_000:
                        seen.add(key)
            none = pa.nulls(b.num_rows, pa.int64())
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [none] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, none, none], names=names)
        v, c = often.found()
        none = pa.nulls(len(v), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(v.view(np.int64)), pa.array(c)], names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def prefix_size(n: int) -> int:
    """Shingles of n that share one with any linked set's prefix."""
    return n - -(-NUM * n // DEN) + 1


def prefix_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, salt, s1): the first 1.5 p shingles by value of all sets; a task deals out equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for b in batches:
            tokens, keys = [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t)
                k = set_key(s)
                if not len(s) or k in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(k)
                p = prefix_size(len(s))
                tokens.append(s[: p + p // 2])
                keys.append(np.full(len(tokens[-1]), k[0], np.int64))
            if tokens:
                tok, key = np.concatenate(tokens), np.concatenate(keys)
                at = np.minimum(np.searchsorted(often, tok), max(len(often) - 1, 0))
                hot = often[at] == tok if len(often) else np.zeros(len(tok), bool)
                salt = np.where(hot, key % SALTS, -1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(salt), pa.array(key)], names=["token", "salt", "s1"])

    return docs.select("text").mapInArrow(tidy(run), "token long, salt byte, s1 long")


def shared_counts(rows: DataFrame) -> DataFrame:
    """(s1, c): how many of a set's rows have a shingle that another set has too; sorted rows stream through."""
    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "s1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (token, salt, s1, whether it was counted) of the row before
        for b in batches:
            if not b.num_rows:
                continue
            tok, salt, s = (b.column(i).to_numpy() for i in range(3))
            fresh = np.concatenate(([last is None or last[:3] != (tok[0], salt[0], s[0])], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]) | (s[1:] != s[:-1])))
            tok, salt, s = tok[fresh], salt[fresh], s[fresh]  # equal sets count once
            if not len(tok):
                continue
            new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])))
            run_of = np.cumsum(new) - 1
            size = np.bincount(run_of)
            hit = (size[run_of] > 1) | (salt >= 0)
            out = []
            if last is not None and last[:2] == (tok[0], salt[0]):
                hit[run_of == 0] = True
                if not last[3]:
                    out.append(last[2])
            last = (tok[-1], salt[-1], s[-1], bool(hit[-1]))
            keys, n = np.unique(np.concatenate((s[hit], np.array(out, np.int64))), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["s1", "c"])

    return dealt.mapInArrow(tidy(run), "s1 long, c long").groupBy("s1").agg(F.sum("c").alias("c"))


def active_sets(reps: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``reps`` that share enough to link: 1 + p // 2 of the smallest set that could be a partner."""
    least_n = -F.floor(-F.col("n") * NUM / DEN)
    need = 1 + F.floor((F.floor(least_n / DEN) + 1) / 2)
    c = counts.withColumnRenamed("s1", "c1")
    return reps.join(c, F.col("s1") == F.col("c1")).where(F.col("c") >= need).drop("c1", "c")


def shingle_rows(active: DataFrame) -> DataFrame:
    """(token, doc_id) of all shingles of active sets; a row whose text is not that of its set gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512).to_pylist()
                sets = [(shingle_set(r["text"]), r) for r in part]
                sets = [(s, r["doc_id"]) for s, r in sets if set_key(s) == (r["s1"], r["s2"])]
                if sets:
                    tok = np.concatenate([s for s, _ in sets]).view(np.int64)
                    ids = np.repeat(np.array([d for _, d in sets], np.int64), [len(s) for s, _ in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(ids)], names=["token", "doc_id"])

    return active.select("doc_id", "s1", "s2", "text").mapInArrow(tidy(run), "token long, doc_id long")


def star_edges(rows: DataFrame, active: DataFrame, ws: Workspace) -> DataFrame:
    """(src, dst): each active set tied to the least active set that has a shingle of its exact prefix in its own.

    Counts by shingle are written before rows meet them, so that adaptive
    execution may split the rows of one that a third of all sets hold.
    """
    held = ws.write(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "held")
    shared = rows.join(held, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    sized = shared.join(active.select("doc_id", "n"), "doc_id")
    room = F.floor(F.col("n") / DEN) + 1 - (F.col("n") - F.size("t"))  # of p, less the shingles that no other set has
    first = sized.where(room > 0).select("doc_id", F.explode(F.slice("t", F.lit(1), room.cast("int"))).alias("x")).select("doc_id", F.col("x.token").alias("token"))
    first = ws.write(first, "first")
    heads = first.groupBy("token").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").select("token", "head")
    heads = ws.write(heads, "heads")
    return first.join(heads, "token").where("doc_id <> head").select(F.col("doc_id").alias("src"), F.col("head").alias("dst")).distinct()


class PrefixTree:
    """A compressed prefix tree over ordered sets; every node is a range of the sorted sets."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        values, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))  # the most shared first: long common paths
        cuts = np.cumsum([0, *map(len, sets)])
        ranked = [np.sort(rank[back[a:b]]) for a, b in zip(cuts, cuts[1:])]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        rows = [ranked[i] for i in self.order]
        self.rows, self.vocabulary = rows, len(values)
        self.len = np.array([len(r) for r in rows])
        self.flat, self.start = np.concatenate(rows), np.cumsum([0, *self.len])[:-1]
        lcp = [0]
        for a, b in zip(rows, rows[1:]):
            n = min(len(a), len(b))
            diff = np.flatnonzero(a[:n] != b[:n])
            lcp.append(int(diff[0]) if len(diff) else n)
        self._build(lcp)

    def _build(self, lcp: list[int]) -> None:
        """Nodes (lo, hi, depth at the end of the edge, parent) from the common prefix lengths of neighbours."""
        n = len(lcp)
        lo, hi, end, parent = [0], [n], [0], [-1]
        levels, todo = [], [0]
        where: dict[int, list[int]] = {}
        for i in range(1, n):
            where.setdefault(lcp[i], []).append(i)
        least = _RangeMin(lcp)
        while todo:
            levels.append(np.array(todo))
            after = []
            for v in todo:
                if hi[v] - lo[v] == 1 and v:
                    continue
                d = end[v]
                at = where.get(d, [])
                cuts = [lo[v], *at[bisect.bisect_right(at, lo[v]) : bisect.bisect_left(at, hi[v])], hi[v]]
                for a, b in zip(cuts, cuts[1:]):
                    lo.append(a)
                    hi.append(b)
                    end.append(int(self.len[a]) if b - a == 1 else least(a + 1, b))
                    parent.append(v)
                    after.append(len(lo) - 1)
            todo = after
        self.lo, self.hi, self.end, self.parent = map(np.array, (lo, hi, end, parent))
        self.levels = levels[1:]
        self.short = np.minimum.reduceat(np.append(self.len, 1 << 60), np.stack([self.lo, self.hi], 1).ravel())[::2]
        self.long = np.maximum.reduceat(np.append(self.len, 0), np.stack([self.lo, self.hi], 1).ravel())[::2]

    def search(self, i: int, label: np.ndarray) -> np.ndarray:
        """Sorted places of the sets that link with set ``i`` and bear another label."""
        x = self.rows[i]
        has = np.zeros(self.vocabulary + 1, np.int64)
        has[x] = 1
        upto = np.cumsum(has)
        turns = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        overlap = np.zeros(len(self.lo), np.int64)
        alive = np.zeros(len(self.lo), bool)
        alive[0] = True
        found = []
        for nodes in self.levels:
            v = nodes[alive[self.parent[nodes]]]
            same = (turns[self.hi[v] - 1] == turns[self.lo[v]]) & (label[self.lo[v]] == label[i])
            v = v[~same]
            if not len(v):
                break
            p, first = self.parent[v], self.start[self.lo[v]]
            a, size = first + self.end[p], self.end[v] - self.end[p]
            ends = np.cumsum(size)
            idx = np.arange(ends[-1]) + np.repeat(a - (ends - size), size)
            sums = np.concatenate(([0], np.cumsum(has[self.flat[idx]])))
            o = overlap[p] + sums[ends] - sums[ends - size]
            depth = self.end[v]
            used = upto[self.flat[first + np.maximum(depth, 1) - 1]] * (depth > 0)
            best = o + np.minimum(self.long[v] - depth, len(x) - used)
            ok = 9 * best >= 4 * (len(x) + self.short[v])
            v, o = v[ok], o[ok]
            overlap[v] = o
            leaf = self.hi[v] - self.lo[v] == 1
            alive[v[~leaf]] = True
            hit = v[leaf][9 * o[leaf] >= 4 * (len(x) + self.len[self.lo[v[leaf]]])]
            found.append(self.lo[hit])
        return np.concatenate(found) if found else np.empty(0, np.int64)


class _RangeMin:
    """Least value of any range of a list, by doubling."""

    def __init__(self, x: list[int]):
        self.t = [np.array(x)]
        while 2 << (len(self.t) - 1) <= len(x):
            w = 1 << (len(self.t) - 1)
            self.t.append(np.minimum(self.t[-1][:-w], self.t[-1][w:]))

    def __call__(self, a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(self.t[k][a], self.t[k][b - (1 << k)]))


def link_sets(sets: list[np.ndarray], labels: list[int] | None = None, probes: list[bool] | None = None) -> list[tuple[int, int]]:
    """Forest of links (index pairs) that joins all sets that links connect; sets are distinct and not empty.

    Sets that bear one label count as linked already; only ``probes`` look for partners.
    """
    if len(sets) < 2:
        return []
    tree = PrefixTree(sets)
    label = np.array([labels[i] for i in tree.order]) if labels else np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        if probes and not probes[tree.order[i]]:
            continue
        if (label == label[0]).all():
            break
        for j in tree.search(i, label):
            if label[j] != label[i]:
                out.append((tree.order[i], tree.order[int(j)]))
                label[label == label[j]] = label[i]
    return out


def _join_families(df: DataFrame) -> DataFrame:
    """(src, dst) from rows (g, family, doc_id, s1, s2, label, probe, text): families of one g are joined one after another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [], []
        for _, f in pdf.groupby("family", sort=False):
            sets: dict[tuple, tuple] = {}  # a doc_id may stand with several texts, which are one node
            for doc, s1, s2, label, probe, text in zip(f["doc_id"], f["s1"], f["s2"], f["label"], f["probe"], f["text"]):
                s = shingle_set(text)
                if set_key(s) != (s1, s2):  # another row under the same doc_id
                    continue
                if (doc, s1, s2) not in sets or probe:
                    sets[doc, s1, s2] = (s, label, probe)
            docs, vals = [k[0] for k in sets], list(sets.values())
            known: dict[int, int] = {}
            labels = [known.setdefault(v[1], k) for k, v in enumerate(vals)]
            for a, b in link_sets([v[0] for v in vals], labels, [bool(v[2]) for v in vals]):
                src.append(docs[a])
                dst.append(docs[b])
        release()
        return pd.DataFrame({"src": pd.Series(src, dtype="int64"), "dst": pd.Series(dst, dtype="int64")})

    return df.groupBy("g").applyInPandas(run, "src long, dst long")


def link_families(docs: DataFrame, fam: DataFrame, ws: Workspace, most: int = FAMILY_MOST) -> DataFrame:
    """(src, dst): links between the representatives in ``fam`` (doc_id, s1, s2, n, family)."""
    text = docs.select("doc_id", "text")
    sizes = fam.groupBy("family").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1")
    sizes = ws.write(sizes, "sizes")
    total = sizes.agg(F.sum("total"), F.max("total")).first()
    if not total[0]:
        return docs.sparkSession.createDataFrame([], "src long, dst long")
    bundles = max(1, min(1 << 20, -(-4 * total[0] // most)))
    rows = fam.join(sizes, "family").withColumn("label", F.col("doc_id")).withColumn("probe", F.lit(True))
    small = rows.where(F.col("total") <= most)
    # Families of more than a sixteenth of a task's load go alone, so that bundles of the others stay even.
    alone = F.col("total") * 16 > most
    f, i = F.when(alone, F.col("family")).otherwise(F.pmod(F.xxhash64("family"), F.lit(bundles))), F.when(alone, -2).otherwise(-1).cast("long")
    parts = small.withColumn("g", F.struct(f.alias("f"), i.alias("i"), F.lit(-1).cast("long").alias("j")))
    cols = ["g", "family", "doc_id", "s1", "s2", "label", "probe"]
    large = total[1] > most
    if large:
        big = rows.where(F.col("total") > most)
        blocks = F.ceil(2 * F.col("total") / F.lit(most)).cast("long")
        step = F.greatest(F.lit(1), F.floor(F.col("k") / (4 * PIVOTS)))
        some = F.collect_set(F.when(F.pmod("s2", step) == 0, F.col("doc_id")))  # about 4 * PIVOTS a family, however large
        low = big.groupBy("family").agg(F.slice(F.sort_array(some), 1, PIVOTS).alias("pivots"))
        own = big.join(low, "family").withColumn("i", F.when(F.array_contains("pivots", F.col("doc_id")), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod("s2", blocks))))
        own = own.withColumn("i", F.explode("i"))
        parts = parts.select(*cols).unionByName(own.withColumn("g", F.struct(F.col("family").alias("f"), F.col("i").alias("i"), F.lit(-1).cast("long").alias("j"))).select(*cols))
    links = ws.write(_join_families(parts.select(*cols).join(text, "doc_id")), "links-1")
    if not large:
        return links
    cc = connected_components(links, ws, name="cc-blocks")
    known = rows.where(F.col("total") > most).drop("label").join(cc, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "doc_id")).drop("node", "component")
    known = ws.write(known, "labelled")
    tops = known.groupBy("family", "label").agg(F.sum("n").alias("m")).groupBy("family").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("m").alias("all"), F.max("m").alias("best"))
    tops = tops.where("labels > 1")
    known = known.join(tops, "family")
    half = F.lit(most) / 2
    n_all, n_minor = F.ceil(F.col("all") / half).cast("long"), F.ceil((F.col("all") - F.col("best")) / half).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    minor = known.where("label <> top").withColumn("i", F.pmod("s2", n_minor)).withColumn("j", F.explode(each(n_all))).withColumn("probe", F.lit(True))
    every = known.withColumn("j", F.pmod("s1", n_all)).withColumn("i", F.explode(each(n_minor))).withColumn("probe", F.lit(False))
    both = minor.unionByName(every).withColumn("g", F.struct(F.col("family").alias("f"), "i", "j")).select(*cols)
    return links.unionAll(ws.write(_join_families(both.join(text, "doc_id")), "links-2"))


def components(docs: DataFrame, most: int = FAMILY_MOST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts without a word have an empty set, size 0, and link with nothing.  A
    null doc_id gives a null component and links nothing; repeated rows come
    back as often as they stand, and are one document; so are rows of one doc_id
    with different texts, which link with whatever any of these links with.  An
    empty table gives no rows.  Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngrams")
    scanned = ws.write(scan(docs), "scan")
    found = scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= FREQUENT_LEAST)
    found = found.orderBy(F.desc("c"), "token").limit(FREQUENT_MOST).toPandas()
    frequent = found["token"].to_numpy(np.int64).view(np.uint64)
    ids = scanned.where("token IS NULL").select("doc_id", "n", "s1", "s2")
    reps = ids.where("doc_id IS NOT NULL AND n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    some = active_sets(reps, shared_counts(prefix_rows(docs, frequent))).withColumnRenamed("rep", "doc_id")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    active = ws.write(text.join(some, "doc_id"), "active")
    rows = ws.write(shingle_rows(active), "shingles")
    families = connected_components(star_edges(rows, active, ws), ws, name="cc-families")
    for name in ("shingles", "held", "first", "heads"):
        ws.drop(name)
    fam = active.select("doc_id", "s1", "s2", "n").distinct().join(families, F.col("doc_id") == F.col("node")).select("doc_id", "s1", "s2", "n", F.col("component").alias("family"))
    links = link_families(active, ws.write(fam, "families"), ws, most)
    cc = connected_components(links, ws, name="cc-links")
    reps = reps.join(cc, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("r1"), F.col("s2").alias("r2"), F.coalesce("component", "rep").alias("top"))
    both = ids.join(reps, (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")) & (F.col("n") > 0), "left")
    comp = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("top", "doc_id"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each linked group the one of the least doc_id.

    Repeated rows (one doc_id, one text) stay once; rows with a null doc_id all
    stay.  All columns are kept; an empty table gives no rows.
    """
    got = components(docs).where("component_id = doc_id").select("component_id").distinct()
    first = docs.join(got, docs["doc_id"].cast("long") == got["component_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT pairs.b, r.t FROM r JOIN pairs ON pairs.a = r.doc_id AND r.t < pairs.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.t) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
