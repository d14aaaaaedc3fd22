"""What plans leave on disk while they run."""

from pyspark.sql import functions as F

from grainfold.plans.components import connected_components
from grainfold.plans.workspace import DROPS_SHUFFLES, Workspace


def test_written_tables_leave_no_shuffles_behind(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffles()
    ws = Workspace(spark, "lean")
    counts = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("c"))
    got = ws.write(counts, "counts")
    assert shuffles() <= before
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") * 7 % 300).alias("dst"))
    cc = connected_components(edges, ws)
    assert shuffles() <= before  # those of all rounds
    assert cc.count() == 294  # six rows link with themselves only
    assert sorted(map(tuple, got.collect())) == [(k, 715 if k < 2 else 714) for k in range(7)]
    assert spark.conf.get(DROPS_SHUFFLES, None) is None
