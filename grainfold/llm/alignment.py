"""Alignment of two tokenizers' tokens over the same bytes, by an event sweep.

Each tokenizer turns a text into end events: the byte offset at which a token
ends, and its id.  Both streams are united, dealt out by document, sorted by
offset, and swept: wherever a token of A and one of B end together, a group of
tokens closes, and these two are linked.  The sweep holds the open group, the
digest of the groups so far and a few counts, whatever a document's length.

Events travel in blocks, a row for the events of one side in WINDOW bytes, which
takes a few bytes an event instead of a row each.  A is a byte-level BPE file of
the tokenizers library, encoded through tiktoken (the same vocabulary as ranks);
B is a sentencepiece model.

How often each id pair is linked is counted over the corpus, and read back by
each document's links: a pass knows at most PASS_PAIRS pairs, and more of them
take more passes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm.bpe import slices
from grainfold.llm.memory import tidy
from grainfold.llm.tokencount import PATTERN, _byte_chars
from grainfold.plans.workspace import Workspace

#: Bytes of a text whose end events make one row.
WINDOW = 1 << 15
#: Pairs whose counts a pass over the links holds (16 bytes each), and links that the sweep holds before it sums them up.
PASS_PAIRS, HELD_LINKS = 4_000_000, 1 << 18
#: Ids are below this in both vocabularies.
_IDS = 1 << 16


class ByteLevel:
    """Side A: ids and byte lengths by a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in _byte_chars().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or max(spec["model"]["vocab"].values()) >= _IDS:
            raise ValueError(f"the ids in {path} do not follow the order of its merges, so they are no ranks")
        self.encode_one = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        self.bytes = [b""] * _IDS
        for t, i in vocab.items():
            self.bytes[i] = t

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(" " + t) for t in texts]


class Pieces:
    """Side B: ids and byte lengths by a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.get_piece_size() > _IDS:
            raise ValueError(f"{path} has more than {_IDS} pieces")
        self.model = model
        self.bytes = [b""] * _IDS
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                self.bytes[i] = p.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_SIDES: dict[tuple[type, str], object] = {}


def side(kind: type, path: str):
    """One encoder per process and file, with the lengths of its tokens."""
    if (kind, path) not in _SIDES:
        got = kind(path)
        got.lengths = np.array(list(map(len, got.bytes)), np.int64)
        _SIDES[kind, path] = got
    return _SIDES[kind, path]


def events(docs: DataFrame, kind: type, path: str, name: int) -> DataFrame:
    """(doc_id, h, side, at, whole, ids): blocks of end events of one side; ``at`` is the window, ids are 16-bit.

    Every row has a block for window 0, so that none is lost; ``whole`` says there
    whether the tokens' bytes, joined, are those of a space and the text.  Tokens
    that do not give these bytes make no events.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = side(kind, path)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            for i, j in slices(texts):
                rows: list[tuple] = []
                for n, (t, ids) in enumerate(zip(texts[i:j], s.encode(texts[i:j])), i):
                    if not t or b"".join(map(s.bytes.__getitem__, ids)) != b" " + t.encode():
                        rows.append((n, 0, False, b""))
                        continue
                    flat = np.array(ids, np.uint16)
                    window = np.cumsum(s.lengths[flat]) // WINDOW
                    cuts = [0, *(np.flatnonzero(np.diff(window)) + 1).tolist(), len(flat)]
                    if window[0]:
                        rows.append((n, 0, True, b""))
                    rows += [(n, int(window[a]), True, flat[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])]
                n, at, whole, ids = zip(*rows)
                take = pa.array(n)
                cols = [b.column(0).take(take), b.column(1).take(take), pa.array([name] * len(rows), pa.int8()), pa.array(at, pa.int64()), pa.array(whole), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "side", "at", "whole", "ids"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return src.mapInArrow(tidy(run), "doc_id long, h long, side byte, at long, whole boolean, ids binary")


#: Text of each id by what follows: another of A in the group, B's, another of B, the next group.
_TEXTS = [f"{i}{c}".encode() for c in ",|,;" for i in range(_IDS)]


class Sweep:
    """The state of one document; ``window`` takes its events window by window."""

    def __init__(self):
        self.digest = hashlib.sha256()
        self.open = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ends = [0, 0]
        self.n = [0, 0]
        self.groups = self.links = 0
        self.held: list[np.ndarray] = []

    def window(self, sides: list[np.ndarray], lengths: list[np.ndarray]) -> None:
        """Takes the ids of A and B that end in the next window."""
        offsets = []
        for k in (0, 1):
            at = self.ends[k] + np.cumsum(lengths[k][sides[k]])
            offsets.append(at)
            self.n[k] += len(at)
            if len(at):
                self.ends[k] = int(at[-1])
        a, b = offsets
        place = np.searchsorted(b, a)
        meet = b[np.minimum(place, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
        ca, cb = np.flatnonzero(meet), place[meet]
        ids = [np.concatenate((o, s.astype(np.int64))) for o, s in zip(self.open, sides)]
        if not len(ca):
            self.open = ids[0], ids[1]
            return
        lasts = [ca + len(self.open[0]), cb + len(self.open[1])]
        self.groups += len(ca)
        self.links += len(ca)
        self.held.append((ids[1][lasts[1]] << 16 | ids[0][lasts[0]]).astype(np.uint32))
        order, codes = [], []
        for k in (0, 1):
            done = ids[k][: lasts[k][-1] + 1]
            last = np.zeros(len(done), np.int64)
            last[lasts[k]] = 1
            codes.append(done + _IDS * (2 * k + last))
            order.append(2 * (np.cumsum(last) - last) + k)  # the group of each token, A before B
        by = np.argsort(np.concatenate(order), kind="stable")
        text = b"".join(map(_TEXTS.__getitem__, np.concatenate(codes)[by].tolist()))
        self.digest.update(text[:-1] if self.groups == len(ca) else b";" + text[:-1])
        self.open = tuple(ids[k][lasts[k][-1] + 1 :] for k in (0, 1))


def sweep(blocks: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows (doc_id, h, copies, n_a, n_b, n_groups, n_links, groups_sha256) of documents, (doc_id, h, ids, counts) of their links, and (ids, counts) of a task's sums."""
    names = ["doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "counts"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]
    dealt = blocks.repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [side(ByteLevel, paths[0]).lengths, side(Pieces, paths[1]).lengths]
        out: list[tuple] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        state = {"key": None, "doc": None, "copies": 0, "whole": True, "at": None, "sides": None, "first": 0}

        def total() -> tuple[np.ndarray, np.ndarray]:
            pairs, back = np.unique(np.concatenate([p for p, _ in sums]), return_inverse=True)
            return pairs, np.bincount(back, np.concatenate([c for _, c in sums]), len(pairs)).astype(np.int64)

        def fold(most: int) -> None:
            """Keeps the task's sums bounded: they are handed on when there are too many."""
            if sum(len(p) for p, _ in sums) > most:
                got = total()
                sums[:] = [got]
                if len(got[0]) > most // 2:
                    out.append((*[None] * 8, got[0].tobytes(), got[1].tobytes()))
                    sums.clear()

        def linked(least: int) -> None:
            s = state["doc"]
            if s.held and sum(map(len, s.held)) > least:
                pairs, n = np.unique(np.concatenate(s.held), return_counts=True)
                s.held = []
                out.append((*state["key"], *[None] * 6, pairs.tobytes(), n.astype(np.int64).tobytes()))
                sums.append((pairs, n * state["copies"]))
                fold(1 << 21)

        def swept() -> None:
            """The window is over: both its sides are known."""
            if state["sides"] and state["whole"]:
                state["doc"].window(state["sides"], lengths)
                linked(HELD_LINKS)
            state["sides"] = None

        def ended() -> None:
            swept()
            s = state["doc"]
            if s is None:
                return
            linked(0)
            whole = state["whole"] and s.groups > 0
            got = (*s.n, s.groups, s.links, s.digest.hexdigest()) if whole else (0, 0, 0, 0, "")
            out.append((*state["key"], state["copies"], *got, None, None))

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out.clear()

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for n, (doc, h, side_no, at, whole) in enumerate(zip(*cols)):
                if state["doc"] is None or state["key"] != (doc, h):
                    ended()
                    state |= {"key": (doc, h), "doc": Sweep(), "copies": 0, "whole": True, "at": None, "sides": None, "seen": set()}
                if state["at"] != at:
                    swept()
                    state |= {"at": at, "seen": set(), "sides": [np.empty(0, np.uint16)] * 2}
                if at == 0 and side_no == 0:
                    state["copies"] += 1
                if at == 0 and not whole:
                    state["whole"] = False
                if side_no in state["seen"]:  # a repeated row has the same events
                    continue
                state["seen"].add(side_no)
                state["sides"][side_no] = np.frombuffer(b.column(5)[n].as_py(), np.uint16)
            if len(out) > 256:
                yield from flushed()
        ended()
        if sums:
            got = total()
            out.append((*[None] * 8, got[0].tobytes(), got[1].tobytes()))
        yield from flushed()

    schema = "doc_id long, h long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids binary, counts binary"
    return dealt.mapInArrow(tidy(run), schema)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): how often each id pair (B's id in the upper half) is linked in the corpus, and whether that is the most of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(p, np.uint32).astype(np.int64)), pa.array(np.frombuffer(n, np.int64))], names=["pair", "n"])

    each = swept.where("copies IS NULL AND h IS NULL").select("ids", "counts").mapInArrow(run, "pair long, n long")
    total = each.groupBy("pair").agg(F.sum("n").alias("n"))
    top = total.groupBy(F.shiftright("pair", 16).alias("b")).agg(F.max("n").alias("top"))
    return total.join(top, F.shiftright("pair", 16) == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _scored(links: DataFrame, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """(doc_id, h, n_best, count_sum) of rows of links, over the pairs given, which are sorted."""
    shared = links.sparkSession.sparkContext.broadcast((pairs, np.where(best, counts, -counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value
        for b in batches:
            rows = []
            for p, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, n = np.frombuffer(p, np.uint32), np.frombuffer(n, np.int64)
                at = np.minimum(np.searchsorted(known, p), len(known) - 1)
                hit = known[at] == p
                v, n = value[at[hit]], n[hit]
                rows.append((int(n[v > 0].sum()), int((n * np.abs(v)).sum())))
            best, total = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "h", "n_best", "count_sum"])

    return links.mapInArrow(tidy(run), "doc_id long, h long, n_best long, count_sum long")


def align(docs: DataFrame, a: str, b: str, most: int = PASS_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a`` is a byte-level BPE file, ``b`` a sentencepiece model.  A text that is
    null or empty, or whose tokens of either side do not give back its bytes, has
    zeros and an empty digest.  Special strings are plain text.  Repeated rows
    come back as often as they stand, and count as often; rows of one id with
    different texts are documents of their own; a null doc_id is carried.  Of
    equal counts all are the highest.  An empty table gives no rows.  Only doc_id
    and text are read.
    """
    ws = Workspace(docs.sparkSession, "alignment")
    both = events(docs, ByteLevel, a, 0).unionAll(events(docs, Pieces, b, 1))
    swept = ws.write(sweep(both, (a, b)), "swept")
    counts = ws.write(pair_counts(swept), "pairs")
    links = swept.where("copies IS NULL AND h IS NOT NULL").select("doc_id", "h", "ids", "counts")
    passes = max(1, -(-counts.count() // most))
    lot = F.pmod(F.xxhash64("pair"), F.lit(passes))
    parts = []
    for k in range(passes):
        got = counts.where(lot == k).orderBy("pair").toPandas()
        if len(got):
            part = _scored(links, got["pair"].to_numpy(np.uint32), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool))
            parts.append(part if passes == 1 else ws.write(part, f"scored-{k}"))
    rows = swept.where("copies IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = rows.select("doc_id", "h", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    if not parts:
        return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    scored = parts[0]
    for x in parts[1:]:
        scored = scored.unionAll(x)
    scored = scored.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.join(scored, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
