"""Queries that run over every row: equal to DuckDB, and as many rows as the tables give."""

import os

import pytest

from lattica import queries as core
from lattica.catalogue import ingest

duckdb = pytest.importorskip("duckdb")


def tables(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{os.path.join(sf_dir, f)}')")
    return c


def same(spark, sf_dir, name):
    want, got = tables(sf_dir).execute(core.ORACLES[name]).df(), core.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
    return got


@pytest.mark.parametrize("name", list(ingest.RECORDS))
def test_every_order_is_a_record(spark, sf_dir, name):
    got = same(spark, sf_dir, name)
    n = tables(sf_dir).execute("select count(*) from orders").fetchone()[0]
    if name in ("curriculum_off", "curriculum_sorted", "curriculum_mixed", "rl_rows", "jsonl_tolerant_load"):
        assert len(got) == n
    if name == "hash_split_counts":
        assert got["n"].sum() == n


def test_every_title_is_asked(spark, sf_dir):
    c = tables(sf_dir)
    got = same(spark, sf_dir, "title_lookup_variants")
    assert set(got["title"]) >= {t for (t,) in c.execute("select p_name from part union select p_brand from part").fetchall()}
    got = same(spark, sf_dir, "title_list_to_ids")
    assert len(got) == c.execute("select count(*) from part").fetchone()[0]


@pytest.mark.parametrize("name", ["golden_star_costars", "golden_chain_4hop_same_school", "eval_report_by_source", "reward_breakdown"])
def test_golden_sets_of_any_size(spark, sf_dir, name):
    same(spark, sf_dir, f"{name}_uncapped")


def test_large_sets_stay(spark):
    from pyspark.sql import functions as F

    from lattica.plans.templates import TEMPLATES, golden

    t = TEMPLATES["chain_film_director_school"]
    films = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("src"), F.lit("d").alias("dst"))
    edges = {"P57": films, "P69": spark.createDataFrame([("d", "s")], "src string, dst string")}.get
    assert golden(t, edges).count() == 0
    assert golden(t, edges, None).count() == 1


def test_random_policy_draws_from_the_whole_pool(spark, sf_dir):
    from lattica.operators.evaluation import random_policy

    got = same(spark, sf_dir, "random_policy")
    assert got["predicted"].nunique() > 4
    rows = [(f"q{i}", [f"Q{2 * i}"], [f"Q{2 * i + 1}"]) for i in range(10)]
    golden = spark.createDataFrame(rows, "id string, answers array<string>, bridges array<string>")
    for n, want in ((7, 7), (50, 20)):
        lists = [r.predicted for r in random_policy(golden, n).collect()]
        assert len(lists) == 10 and all(len(x) == len(set(x)) == want for x in lists)
    assert len({tuple(x) for x in lists}) > 5
