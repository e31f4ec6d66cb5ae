"""The driver's entry: names, SQL for queries, and results equal to DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lattica import queries as core

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["golden_star_costars", "golden_chain_4hop_same_school", "entity_degrees", "neighbors_in_page", "shortest_paths_pairs", "vector_topk", "text_link_candidates", "title_rule", "answer_parse", "reward_breakdown", "latency_percentiles", "curriculum_mixed", "incremental_embed_text"]


def test_names():
    assert set(core.ORACLES) <= set(core.QUERIES) <= set(entry.queries())
    assert len(core.QUERIES) - len(core.ORACLES) <= 1


def test_entry_has_rows(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FEW)
def test_equal_to_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    want, got = c.execute(core.ORACLES[name]).df(), core.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
