"""Scores of sets of any size: a hub's ids are hashed where they are joined, with the gains that the sets' arrays give."""

import pytest
from pyspark.sql import functions as F
from test_findings import SAME, graph, schools  # noqa: F401

from lattica.catalogue import metrics
from lattica.functions.ranking import hashed_gains
from lattica.operators.evaluation import gains_at_hubs
from lattica.plans.templates import golden_hubs

SETS = (("answers", "less_answers", 2.0), ("bridges", "less_bridges", 1.0), ("more_bridges", None, 1.0), ("junk", None, 0.0))


@pytest.mark.parametrize("k", [1, 3, 50])  # of 1, some rows have no id below their bound; of 50, none has a bound
def test_gains_of_a_join_equal_those_of_arrays(spark, schools, k):  # noqa: F811
    own, _, held = golden_hubs(SAME, graph(spark, *schools))
    rows = metrics.counted(own.withColumn("source", F.lit("s"))).checkpoint()
    tiers = [(F.col(c), F.col(less) if less else None, gain) for c, less, gain in SETS]
    want = {r.id: list(r.gains) for r in rows.select("id", hashed_gains(F.col("id"), tiers, k).alias("gains")).collect()}
    got = gains_at_hubs(rows.drop("answers", "bridges"), held, k).collect()
    assert len(got) == len(want) and {r.id: list(r.gains) for r in got} == want


def test_rows_equal_those_of_whole_sets(spark, schools, monkeypatch):  # noqa: F811
    monkeypatch.setattr(metrics, "edges_of", lambda *_: graph(spark, *schools))
    monkeypatch.setattr(metrics, "USED", (SAME.name,))
    rows = lambda df: sorted((r.id, r.source, list(r.gains), r.n_answers, r.n_bridges, r.n_predicted, r.n_hits) for r in df.collect())
    got = rows(metrics.predictions(spark, None, None))
    assert got and got == rows(metrics.with_predictions(metrics.parts(spark, None, None)))


@pytest.mark.parametrize("query", ["per_question", "reward_breakdown"])
def test_ids_of_a_hub_are_hashed_in_a_join(spark, sf_dir, query):
    """A lambda over a hub's array takes twice the time of the join's generated code."""
    plan = getattr(metrics, query)(spark, sf_dir, None)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in x and "sha2" in x for x in plan.splitlines())
