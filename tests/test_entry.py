"""The driver's contract, with and without the llm subpackage."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from grainfold import batch_queries, registry

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    if importlib.util.find_spec("grainfold.llm") is None:
        assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())


@pytest.mark.parametrize("name", ["exposure_score", "recommend_topn", "resize_targets", "cache_hit_tiers", "text_grid_dhash", "hamming_pairs", "incremental_groups", "ranking_slice", *batch_queries.QUERIES])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["live_rerank", "ranked_group_markers"])
def test_ranks_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)
    assert len(want) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
