"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed to two 64-bit values; distinct
documents are counted per hash (partial aggregation first, so a line that a
third of all documents hold sends one row per map task and document set), the
lines over the threshold are found by an equi-join that adaptive execution may
split, and each document is put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.plans.workspace import Workspace

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def drop_common_lines(df: DataFrame, min_docs: int = 5, min_chars: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the text's common lines dropped, and columns n_lines and n_dropped (long).

    A key of at least ``min_chars`` code points held by at least ``min_docs``
    documents loses all its lines but those of the largest ``key`` that holds it.
    A null text counts as one empty line and stays null.  Rows with a null
    ``key`` count as no document and hold no line for good.  Repeated rows with
    one key are one document, and each keeps or loses the same lines.  An empty
    table gives an empty result.  Columns named n_lines or n_dropped are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("k"), body.alias("body"), F.xxhash64(body).alias("r"))
    lines = src.select("k", "r", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).select("k", "r", "pos", line_key(F.col("line")).alias("line"))
    lines = lines.where(F.char_length("line") >= min_chars).select("k", "r", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(20261), "line").alias("h2"))
    common = lines.groupBy("h1", "h2").agg(F.countDistinct("k").alias("n"), F.max("k").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    common = Workspace(df.sparkSession, "lines").write(common, "common")  # written: a join with an aggregate itself would not be split
    gone = lines.join(common, ["h1", "h2"]).where(~F.col("k").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("k").alias("gk"), F.col("r").alias("gr")).agg(F.collect_set("pos").alias("gone"))
    both = src.join(gone, F.col("k").eqNullSafe(F.col("gk")) & (F.col("r") == F.col("gr")), "left")
    # explode() of one element makes the split lines a stored column: the lambda below then looks them up in constant time.
    split = F.when(F.col("gone").isNotNull(), F.split("body", "\n", -1)).otherwise(F.array().cast("array<string>"))
    both = both.select("row", "body", "gone", F.explode(F.array(split)).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = (F.char_length("body") - F.char_length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    cols = [kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*cols, n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_gone).cast("long").alias("n_dropped"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
