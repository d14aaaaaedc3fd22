"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

Ioffe, "Improved Consistent Sampling, Weighted Minhash and L1 Sketching" (2010).
A text is a set of weighted terms: its five-word shingles, each as heavy as it
is frequent.  For a term of weight S and sample d, r and c are drawn from
Gamma(2, 1) and b from (0, 1), by hashes of term and d alone; then

    t = floor(ln S / r + b),   ln a = ln c - r (t - b + 1),

and the sample is the term, with its t, of the least a.  Two texts have the same
sample with a probability that equals their generalised Jaccard similarity, the
sum of the lesser weights by the sum of the greater ones.

a is never less than c exp(-r) / S, which takes no logarithm to bound: terms for
which that bound is above CUT / (sum of weights) are left out before the rest is
computed.  a follows an exponential law of rate S, so that a sample without any
term left has a probability of exp(-CUT); it would be the sample 0, in equal
texts alike.

Samples are minima, so what two texts share is sampled once for both: a text and
its edited form are taken apart into what only one has and what both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.plans.ranges import running
from grainfold.plans.workspace import Workspace

SAMPLES, WORDS = 40, 5
#: A term is one number: hash above, weight in the lower WEIGHT_BITS bits; heavier terms weigh 2^20 - 1.
WEIGHT_BITS = 20
CUT = 20.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MOST = (1 << WEIGHT_BITS) - 1


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; null and white texts have none."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", -1), "")


def _shingles(column: str) -> str:
    """SQL: hashes of the runs of WORDS words of an array column; of fewer words all are one, none are one too."""
    run = ", ".join(["w", *(f"{column}[i + {k}]" for k in range(1, WORDS))])
    return f"IF(size({column}) < {WORDS}, array(xxhash64({column})), transform(slice({column}, 1, greatest(size({column}) - {WORDS - 1}, 1)), (w, i) -> xxhash64({run})))"


def with_terms(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds, by output name, the distinct weighted terms of text columns, as numbers."""
    for out, text in texts.items():
        df = df.withColumn(f"__w_{out}", words(F.coalesce(text, F.lit(""))))
    df = df.select("*", *[F.sort_array(F.expr(_shingles(f"`__w_{out}`"))).alias(f"__s_{out}") for out in texts])
    last = "filter(sequence(0, size({s}) - 1), i -> i = size({s}) - 1 OR {s}[i] <> {s}[i + 1])"  # where the run of a shingle ends
    df = df.select("*", *[F.expr(last.format(s=f"`__s_{out}`")).alias(f"__e_{out}") for out in texts])
    term = "transform({e}, (e, j) -> ({s}[e] & {mask}L) | least(e - IF(j = 0, -1, {e}[j - 1]), {most}))"
    df = df.select("*", *[F.expr(term.format(e=f"`__e_{out}`", s=f"`__s_{out}`", mask=~_MOST, most=_MOST)).alias(out) for out in texts])
    return df.drop(*[f"__{k}_{out}" for k in "wse" for out in texts])


def sample(term: str, bound: str, d: int) -> Column:
    """The d-th sample's value of a term (a number as ``with_terms`` makes it); null where the cheap bound is above ``bound``.

    The leading bits are ln a, so that the least value is the sample; the others
    tell terms and their t apart.  ``bound`` is in units of 2^-31.
    """
    h, g, weight = f"xxhash64({term} & {~_MOST}L, {2 * d})", f"xxhash64({term} & {~_MOST}L, {2 * d + 1})", f"({term} & {_MOST}L)"
    u, v = (f"({h} & 65535L)", f"(shiftrightunsigned({h}, 16) & 65535L)"), (f"(shiftrightunsigned({h}, 32) & 65535L)", f"shiftrightunsigned({h}, 48)")
    # exp(-r) from below and, as c >= 2 z / (2 - z) for z = 1 - exp(-c), c from below
    z = f"(1D - (({v[0]} + 1L) * ({v[1]} + 1L)) / 4294967296D)"
    low = f"({u[0]} * {u[1]}) * {z} / (2D - {z})"
    fine = lambda x, at: f"({x} + ((shiftrightunsigned({g}, {at}) & 4095L) + 0.5D) / 4096D)"
    r = f"(-ln({fine(u[0], 0)} * {fine(u[1], 12)} / 4294967296D))"
    c = f"(-ln({fine(v[0], 24)} * {fine(v[1], 36)} / 4294967296D))"
    b = f"((shiftrightunsigned({g}, 48) + 0.5D) / 65536D)"
    t = f"floor(ln({weight}) / {r} + {b})"
    a = f"(ln({c}) - {r} * ({t} - {b} + 1D))"
    value = f"(shiftleft(CAST(({a} + 64D) * 4294967296D AS BIGINT), 24) | (xxhash64({g}, {t}) & 16777215L))"
    return F.expr(f"CASE WHEN {low} <= {bound} * {weight} THEN {value} END")


def signatures(terms: DataFrame, by: list[str], term: str, bound: str, samples: int = SAMPLES) -> DataFrame:
    """``by`` and s0, s1, ...: the samples of the rows of ``terms`` with equal ``by``."""
    return terms.groupBy(*by).agg(*[F.min(sample(term, bound, d)).alias(f"s{d}") for d in range(samples)])


def _symbols(of, samples: int) -> Column:
    return F.array(*[F.when(of(d).isNull(), F.lit(0)).otherwise(F.hash(of(d))) for d in range(samples)])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples of two fingerprints, an estimate of generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")


def text_of(print_: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a sample."""
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32)))), 8, "0")), "")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``key``, fingerprint (array of ``samples`` numbers) of every distinct pair of key and text."""
    src = df.select(F.col(key).alias("__k"), F.coalesce(text, F.lit("")).alias("__t"))
    src = with_terms(src.withColumn("__h", F.xxhash64("__t")), {"__own": "__t"}).drop("__t")
    src = src.withColumn("__bound", _bound("__own"))
    one = src.select("__k", "__h", "__bound", F.explode(F.array("__own")).alias("__p"))  # else a filter on the array's size moves below and makes it again for each element
    got = signatures(one.select("__k", "__h", "__bound", F.explode("__p").alias("__x")), ["__k", "__h"], "__x", "__bound", samples)
    return got.select(F.col("__k").alias(key), _symbols(lambda d: F.col(f"s{d}"), samples).alias("fingerprint"))


def _bound(terms: str) -> Column:
    """CUT by the sum of weights, in units of 2^-31."""
    total = F.aggregate(F.col(terms), F.lit(0.0), lambda n, x: n + x.bitwiseAND(F.lit(_MOST).cast("long")).cast("double"))
    return F.lit(CUT * 2.0**31) / total


def _neighbours(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(id, next, n): each distinct key, the key after it (after the last: the first), and the length of its longest text."""
    ids = ws.write(docs.groupBy("id").agg(F.max("n").alias("n")).where("id IS NOT NULL"), "ids")
    ranked = running(ids, [F.col("id").desc()], ws, "order", carry="id")
    least = ids.agg(F.min("id").alias("least"))
    pairs = ranked.crossJoin(F.broadcast(least)).select("id", F.coalesce("__previous", "least").alias("next"), "n")  # one row
    none = docs.where("id IS NULL").groupBy("id").agg(F.max("n").alias("n")).crossJoin(F.broadcast(least)).select("id", F.col("least").alias("next"), "n")
    return ws.write(pairs.unionAll(none), "next")


def edited(docs: DataFrame, ws: Workspace, part: int = 4) -> DataFrame:
    """(k0, k1, next, n, text, edited): texts with their last floor(n / part) code points replaced by the first as many of the next document's.

    Only ids are ordered.  The beginnings that are asked for meet the texts on
    the next document's id; of several texts of that id the least counts.  k0 and
    k1 are the id and whether it is null; rows lie by them.
    """
    sized = docs.select("id", F.char_length("text").cast("long").alias("n"))
    asked = _neighbours(sized, ws).select(*_keys("id", "a"), "next", *_keys("next", "g"), F.floor(F.col("n") / part).cast("int").alias("take"))
    keyed = docs.select(*_keys("id", "k"), "text")
    tails = keyed.join(asked, (F.col("k0") == F.col("g0")) & (F.col("k1") == F.col("g1"))).select("a0", "a1", "next", F.substring("text", F.lit(1), F.col("take")).alias("tail"))
    tails = tails.groupBy("a0", "a1").agg(F.min("tail").alias("tail"), F.min("next").alias("next"))
    out = keyed.join(tails, (F.col("k0") == F.col("a0")) & (F.col("k1") == F.col("a1"))).withColumn("n", F.char_length("text"))
    cut = F.floor(F.col("n") / part).cast("int")
    whole = F.concat(F.substring("text", F.lit(1), F.col("n") - cut), F.substring("tail", F.lit(1), cut))
    return out.select("k0", "k1", "next", F.col("n").cast("long").alias("n"), "text", whole.alias("edited"))


def _keys(id_: str, name: str) -> list[Column]:
    """An id as two columns without nulls, so that every step can use one partitioning."""
    return [F.coalesce(id_, F.lit(0).cast("long")).alias(f"{name}0"), F.col(id_).isNull().alias(f"{name}1")]


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Null texts are empty; a text without words is one term, the same for all such
    texts, so that their fingerprints are equal.  Repeated rows (one id, one
    text) come back once; rows of one id with different texts are documents of
    their own with one next document, and where that has several texts the least
    one is taken.  A null id comes after no document; its next is the first
    (where all are null, the least text, with which near_next is 0).  A
    lone document is its own next.  An empty table gives no rows.  Only ``key``
    and ``text`` are read.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "sampling")
    docs = df.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = edited(docs, ws).select("k0", "k1", "next", "n", F.xxhash64("text").alias("h"), F.sha2("edited", 256).alias("sha"), "text", "edited")
    rows = with_terms(rows, {"own": "text", "new": "edited"}).drop("text", "edited")
    rows = rows.withColumn("bound", F.greatest(_bound("own"), _bound("new")))
    kept = [F.struct(F.lit(k).alias("k"), x.alias("x")) for k, x in enumerate((F.array_intersect("own", "new"), F.array_except("own", "new"), F.array_except("new", "own")))]
    by = ["k0", "k1", "next", "n", "h", "sha"]
    parts = rows.select(*by, "bound", F.explode(F.array(*kept)).alias("p")).select(*by, "bound", F.col("p.k").alias("k"), F.explode("p.x").alias("x"))
    sampled = signatures(parts, [*by, "k"], "x", "bound", samples)
    each = sampled.groupBy(*by).agg(*[F.min(F.when(F.col("k") != off, F.col(f"s{d}"))).alias(f"{c}{d}") for c, off in (("a", 2), ("b", 1)) for d in range(samples)])
    prints = each.select(F.when(~F.col("k1"), F.col("k0")).alias("id"), "next", "n", "sha", _symbols(lambda d: F.col(f"a{d}"), samples).alias("own"), _symbols(lambda d: F.col(f"b{d}"), samples).alias("new"))
    prints = ws.write(prints, "prints")
    after = prints.groupBy(F.col("id").alias("i")).agg(F.min("own").alias("after"))
    out = prints.join(after, F.col("next") == F.col("i"), "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), F.coalesce(likeness(F.col("own"), F.col("after")), F.lit(0.0)).alias("near_next"),
    )
