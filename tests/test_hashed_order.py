"""Scores of sets of any size: their first ids by hash without a sort of all, and a hub's arrays without a copy an anchor."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_findings import SAME, brute, graph, schools  # noqa: F401

from lattica.catalogue import metrics
from lattica.functions.ranking import hashed_gains, size_without
from lattica.plans.templates import golden_parts

PARTS = ("answers", "less_answers", "bridges", "less_bridges", "more_bridges")


def first(key, sets, k):
    """The first gains by a sort of all ids."""
    rows = sorted((hashlib.sha256(f"{key}|{q}".encode()).hexdigest(), q, gain) for ids, less, gain in sets for q in set(ids) - set(less))
    return [r[2] for r in rows[:k]]


CASES = {
    "few": ([f"Q{i}" for i in range(20)], [], [f"R{i}" for i in range(5)]),
    "at the bound": ([f"Q{i}" for i in range(150)], [], [f"R{i}" for i in range(151)]),
    "many": ([f"Q{i}" for i in range(4000)], ["Q7", "Q11", "X"], [f"R{i}" for i in range(3000)]),
    "nearly all are lacked": ([f"Q{i}" for i in range(4000)], [f"Q{i}" for i in range(3990)], ["R1", "R2"]),
    "none": ([], [], []),
}


@pytest.mark.parametrize("k", [1, 10, 50])
def test_first_by_hash_equals_a_sort_of_all(spark, k):
    rows = [(f"kg-{name}{i}", a, less, b) for name, (a, less, b) in CASES.items() for i in range(4)]
    df = spark.createDataFrame(rows, "id string, a array<string>, less array<string>, b array<string>")
    got = df.select("id", hashed_gains(F.col("id"), [(F.col("a"), F.col("less"), 2.0), (F.col("b"), None, 1.0)], k).alias("g"), size_without(F.col("a"), F.col("less")).alias("n")).collect()
    assert {r.id: list(r.g) for r in got} == {i: first(i, [(a, less, 2.0), (b, [], 1.0)], k) for i, a, less, b in rows}
    assert {r.id: r.n for r in got} == {i: len(set(a) - set(less)) for i, a, less, _ in rows}


def test_parts_are_the_sets(spark, schools):  # noqa: F811
    rows = golden_parts(SAME, graph(spark, *schools), None).collect()
    got = {(tuple(sorted(set(r.answers) - set(r.less_answers))), tuple(sorted((set(r.bridges) - set(r.less_bridges)) | set(r.more_bridges)))) for r in rows}
    want = brute(*schools, None)
    assert len(rows) == len(want) and got == {(tuple(a), tuple(b)) for a, b in want.values()}
    for r in rows:
        assert not set(r.more_bridges) & (set(r.bridges) - set(r.less_bridges))
        assert all(len(set(r[c])) == len(r[c]) for c in ("answers", "bridges", "more_bridges"))


def test_junk_that_a_set_holds_counts_once(spark):
    rows = [("a", "s", ["Q1", "Q5"], ["Q5"], ["Q2", "Q9"], ["Q2"], ["Q3"])]
    got = metrics.with_predictions(spark.createDataFrame(rows, "id string, source string, " + ", ".join(f"{c} array<string>" for c in PARTS))).first()
    assert (got.n_answers, got.n_bridges, got.n_predicted, got.n_hits) == (1, 2, 4, 1)
    assert list(got.gains) == first("a", [(["Q1"], [], 2.0), (["Q9", "Q3"], [], 1.0), (["Q2"], [], 0.0)], 50)


def test_no_array_is_made_for_an_anchor(spark, sf_dir):
    """Where sets have any size, scores neither make an anchor's arrays from the hub's nor sort them."""
    plan = metrics.scored(spark, sf_dir, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(concat(CASE WHEN" not in plan and "array_distinct(concat(answers" not in plan
