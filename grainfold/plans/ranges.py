"""Global ranks without one big sort: rows dealt into ranges of the order, counted within each.

The number of ranges follows the number of rows, so no task grows with the
table.  The dealt rows are written once, with their range, so that every later
step sees the same ranges; what passes between ranges is a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.plans.workspace import Workspace

#: Rows that a range holds about, and ranges at least.
ROWS, LEAST = 1_000_000, 8


def running(df: DataFrame, order: list[Column], ws: Workspace, name: str, weight: str | None = None, carry: str | None = None) -> DataFrame:
    """Adds __upto: rows (or the sum of ``weight``) up to and with each row in ``order``, which must leave no ties; with ``carry`` also __previous: that column in the row before."""
    src = ws.write(df, f"{name}-rows")
    n = max(LEAST, -(-src.count() // ROWS))
    dealt = ws.write(src.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), name)
    ws.drop(f"{name}-rows")
    w = Window.partitionBy("__range").orderBy(*order)
    each = F.col(weight) if weight else F.lit(1).cast("long")
    rows = dealt.withColumn("__at", F.sum(each).over(w))
    if carry:
        rows = rows.withColumn("__previous", F.lag(carry).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    last = F.max_by(carry, "__at") if carry else F.lit(None)
    ends = rows.groupBy(F.col("__range").alias("__r")).agg(F.max("__at").alias("__sum"), last.alias("__last"))
    ahead = Window.orderBy("__r")  # over ranges, not rows
    before = F.coalesce(F.sum("__sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ends = ws.write(ends.select("__r", before.alias("__before"), F.lag("__last").over(ahead).alias("__ahead")) if carry else ends.select("__r", before.alias("__before")), f"{name}-ends")
    out = rows.join(F.broadcast(ends), F.col("__range") == F.col("__r")).withColumn("__upto", F.col("__at") + F.col("__before"))
    if carry:
        out = out.withColumn("__previous", F.when(F.col("__first"), F.col("__ahead")).otherwise(F.col("__previous")))
    return out.drop("__range", "__r", "__at", "__before", "__ahead", "__first")
