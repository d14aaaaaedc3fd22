"""Language ID by compression: the language whose dictionary makes the text smallest.

Each language's dictionary is raw content: texts of a bounded sample of its
labelled rows, one after another.  Texts are reduced to lower-case letters with
single spaces, so that case, digits and punctuation tell nothing.  A text is
compressed in blocks, each with every language's dictionary, so a long text
keeps depending on the dictionary to its end; the whole text counts.  The score
compares the sizes.  A text is rejected whose second-best size is less than
MIN_MARGIN of its best one larger, as a whole or in either half: ties and junk
are narrow as a whole, and a text of two languages is narrow in one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.llm.memory import tidy

UNKNOWN = "und"
#: At most so many labelled texts a language, of so many characters each, make its dictionary.
SAMPLE_TEXTS, SAMPLE_CHARS = 96, (300, 4000)
LEVEL, BLOCK = 6, 2048
#: Bits of difference that count as one unit of odds.
TEMPER = 12.0
#: A text with a narrower margin is rejected: (second-best size - best) / best.  Chosen on training
#: rows of sf0.01 outside the dictionaries: 98 % have more than 0.078; random letters have at most 0.027.
MIN_MARGIN = 0.03
#: Letters' bytes from which the halves of a text are looked at too.
HALVES_FROM = 512

#: Dictionaries by language, the language with most training rows first.
Model = dict[str, bytes]
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """The text's letters in lower case, each run of anything else as one space; empty without a letter."""
    kept = _OTHER.sub(" ", text).strip().lower()
    return f" {kept} ".encode() if any(map(str.isalpha, kept)) else b""


def in_training(key: str = "doc_id"):
    """Whether a row may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, chars: tuple[int, int] = SAMPLE_CHARS) -> Model:
    """Dictionaries by language, from a bounded sample of labelled rows (documented bound: ``texts`` x ``chars[1]`` a language).

    The sample is the same however the rows are dealt: those of least hash.
    Where no text of a language has a fitting length, its shortest ones serve.
    All training rows are counted by language, for the order of ties.
    """
    rows = docs.where(in_training(key) & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
    size = F.length(text)
    fits = F.when(size.between(*chars), 0).otherwise(size)
    rows = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), fits.alias("f"), F.xxhash64(F.col(key)).alias("h"))
    w = Window.partitionBy("l").orderBy("f", "h", "t")
    got = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= texts).select("l", F.substring("t", 1, chars[1]).alias("t"), "r").orderBy("l", "r").collect()
    sizes = {x["l"]: x["count"] for x in rows.groupBy("l").count().collect()}
    out: dict[str, list[bytes]] = {k: [] for k in sorted(sizes, key=lambda k: (-sizes[k], k))}
    for x in got:
        out[x["l"]].append(letters(x["t"]))
    return {k: b"".join(v) for k, v in out.items()}


class Classifier:
    def __init__(self, model: Model):
        self.langs = list(model)
        self.zs = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.zs.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und`` with score 0 for a text without a letter."""
        b = letters(text) if text and self.langs else b""
        if not b:
            return UNKNOWN, 0.0, False
        step = -(-len(b) // -(-len(b) // BLOCK))  # blocks of one size, so that the halves weigh the same
        blocks = [b[i : i + step] for i in range(0, len(b), step)]
        each = [[len(z(x)) for x in blocks] for z in self.zs]
        sizes = [sum(x) for x in each]
        best = min(sizes)
        k = sizes.index(best)
        score = 1 / sum(math.exp(min(0.0, (best - s) * 8 * math.log(2) / TEMPER)) for s in sizes)
        return self.langs[k], score, min(_margin(x, k) for x in (sizes, *self._halves(b, each))) >= MIN_MARGIN

    def _halves(self, b: bytes, each: list[list[int]]) -> list[list[int]]:
        """Sizes by language of the text's first and second half; nothing for a short text."""
        if (n := len(each[0])) > 1:
            return [[sum(x[: n // 2]) for x in each], [sum(x[n // 2 :]) for x in each]]
        if len(b) < HALVES_FROM:
            return []
        mid = b.rfind(b" ", 0, len(b) // 2) + 1 or len(b) // 2
        return [[len(z(x)) for z in self.zs] for x in (b[:mid], b[mid:])]


def _margin(sizes: list[int], k: int) -> float:
    """How much larger the least other size is than that of language ``k``, relative to it; a single language has no rival."""
    return (min((s for i, s in enumerate(sizes) if i != k), default=math.inf) - sizes[k]) / sizes[k]


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """key, lang_pred, score, accepted for every row (and the columns in ``keep``); only ``text`` is looked at.

    A null, empty or letterless text is ``und``, score 0, not accepted; ties go
    to the language with most training rows and are not accepted.  One row per
    input row; a column of ``docs`` with the name of a new one gives way to it.
    """
    new = ("lang_pred", "score", "accepted")
    src = docs.select(key, text, *[k for k in keep or [] if k not in (key, text, *new)])
    names = [f.name for f in src.schema]
    more = T.StructType().add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    schema = T.StructType([*src.schema.fields, *more.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shared.value)
        for b in batches:
            lang, score, ok = [], [], []
            for t in b.column(1).to_pylist():
                x = c.classify(t)
                lang.append(x[0]), score.append(x[1]), ok.append(x[2])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=[*names, "lang_pred", "score", "accepted"])

    return src.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document, learned from the training rows of the same table."""
    got = predict(docs, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
