"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes one transcript, ``<turn ROLE>TEXT</turn>`` per turn.
Inside roles and texts ``\\`` is written ``\\b``, ``<`` ``\\l`` and (roles) ``>``
``\\g``, so no text can hold a mark, and reading back is exact.  Every assistant
turn is its own example: its context is the transcript's first ``context_chars``
characters (all turns before, and the mark that opens the reply), and only what
stands between there and ``loss_end``, the reply's text, bears loss.  Contexts
are kept as lengths, since writing each one out grows with the square of a
conversation; ``write_out`` does so where it is wanted.  ``digests`` reads turns
and losses back from the transcripts, and finds each loss by its context alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "<turn ", ">", "</turn>"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    c = _swap(c, ("\\", "\\b"), ("<", "\\l"))
    return _swap(c, (">", "\\g")) if role else c


def unescape(c: Column) -> Column:
    return _swap(c, ("\\g", ">"), ("\\l", "<"), ("\\b", "\\"))


def transcripts(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, transcript, turns (array of formatted turns with role): a row per conversation.

    Turns stand in the order of ``turn``, ties by role, then text; a null turn
    comes first; a null role or text is empty; rows with a null conversation form
    one conversation; repeated rows are repeated turns.  A conversation's turns
    meet in one row, as its digest and transcript are one value each.
    """
    t = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    g = df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit(OPEN), escape(x["role"], True), F.lit(MID)).alias("head"), escape(x["text"]).alias("body")))
    g = g.select("conv_id", F.explode(F.array(turns)).alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("transcript"), "turns")


def examples(t: DataFrame, reply: str = "assistant") -> DataFrame:
    """conv_id, turn_no, context_chars, loss_end: a row per turn of role ``reply`` of ``transcripts()``.

    A conversation without such a turn has no row; a null conversation's turns
    are examples like any other; an empty reply bears no loss.
    """
    e = t.select("conv_id", F.posexplode("turns").alias("turn_no", "x"))
    size = F.char_length("x.head") + F.char_length("x.body") + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))).where(F.col("x.role") == reply)
    context = F.col("at") + F.char_length("x.head")
    return e.select("conv_id", "turn_no", context.alias("context_chars"), (context + F.char_length("x.body")).alias("loss_end"))


def write_out(t: DataFrame, e: DataFrame) -> DataFrame:
    """Examples with their contexts as text: conv_id, turn_no, prompt, target, and the loss span of prompt || target.

    One row per example, those of a null conversation included; other columns
    of ``t`` and ``e`` are left behind.
    """
    x = e.select(F.col("conv_id").alias("__c"), "turn_no", "context_chars", "loss_end")
    j = t.select("conv_id", "transcript").join(x, F.col("conv_id").eqNullSafe(F.col("__c")))
    part = lambda a, b: F.substr("transcript", (a + 1).cast("int"), (b - a).cast("int"))
    start, end = F.col("context_chars"), F.col("loss_end")
    return j.select("conv_id", "turn_no", part(F.lit(0), start).alias("prompt"), part(start, end + len(CLOSE)).alias("target"), start.alias("loss_start"), "loss_end")


def read_back(t: DataFrame) -> DataFrame:
    """conv_id, turn_no, body_at, role, body: the turns as parsed from the transcripts, a row each; ``body`` is escaped still.

    ``body_at`` counts the transcript's characters before the turn's text.  Only
    conv_id and transcript are read; an empty transcript has no turn.
    """
    parts = F.split("transcript", CLOSE, -1)
    p = t.select("conv_id", F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("turn_no", "part"))
    head = F.substring_index("part", MID, 1)
    before = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum(F.char_length("part") + len(CLOSE)).over(before), F.lit(0).cast("long"))).withColumn("skip", F.char_length(head) + 1)
    return p.select("conv_id", "turn_no", (F.col("at") + F.col("skip")).alias("body_at"), unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), F.substr("part", F.col("skip") + 1).alias("body"))


def digest_turns(t: DataFrame, e: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of transcripts ``t`` under the loss mask of examples ``e``.

    A turn bears loss where an example's context ends at its text, as far as
    ``loss_end``; an example whose context ends elsewhere adds nothing.  A null
    conversation is one like any other.
    """
    mask = e.select(F.col("conv_id").alias("__c"), F.col("context_chars").alias("__s"), F.col("loss_end").alias("__e"))
    turns = read_back(t).join(mask, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("body_at") == F.col("__s")), "left")
    loss = F.coalesce(unescape(F.substr("body", F.lit(1), (F.col("__e") - F.col("__s")).cast("int"))), F.lit(""))
    said = F.concat("role", F.lit("\n"), unescape(F.col("body")), F.lit("\n"))
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", said.alias("said"), loss.alias("loss")))).alias("x"), F.max(F.col("body_at") + F.char_length("body")).alias("end"))
    joined = lambda k: F.array_join(F.transform("x", lambda v: v[k]), "")
    return g.select(
        "conv_id", F.size("x").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"), F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"), (F.col("end") + len(CLOSE)).alias("formatted_chars"),
    )


def digests(df: DataFrame) -> DataFrame:
    """``digest_turns`` of the transcripts of turn rows and of their examples; an empty table gives no rows."""
    t = transcripts(df)
    return digest_turns(t, examples(t))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(14 + length(role) + length(text) + length(text) - length(replace(replace(text, '\', ''), '<', ''))
             + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', ''))) AS formatted
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, cast(formatted AS BIGINT) AS formatted_chars
FROM g
"""
