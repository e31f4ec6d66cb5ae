"""What the second review found: letters of several capitals, and golden sets whose arms meet in a hub."""

import random

import pytest
from test_whole import same

from lattica.catalogue import metrics
from lattica.plans import templates
from lattica.plans.templates import TEMPLATES, golden

duckdb = pytest.importorskip("duckdb")
SAME = TEMPLATES["chain_same_school_directors"]


def test_titles_letter_by_letter(spark, tmp_path):
    starts = ["großes", "Ißt du", "ßßß ß", "ŉa ﬁx", "ﬀﬁﬂ x", "İstanbul", "ΟΔΟΣΑ ΟΔΟΣ", "ΑΣ ΒΣ ΓΣ", "ᾳῃῳ ᾀ", "ΐΰǰ", "\U00010428\U00010429x", "x", "", " "]
    rows = [(k, f"{t} and more") for k, t in enumerate(starts * 6) if t] + [(1000, None), (1001, ""), (1003, "ß")]
    c = duckdb.connect()
    c.execute("create table d(doc_id bigint, text varchar)")
    c.executemany("insert into d values (?, ?)", rows)
    c.execute(f"copy d to '{tmp_path}/documents.parquet' (format parquet)")
    got = same(spark, str(tmp_path), "title_rule")
    assert {"ẞẞẞ", "İST"} <= set(got["title"])


def brute(directed, educated, most):
    """Golden sets of chain_same_school_directors by nested loops: {anchor: (answers, bridges)}."""
    out = {}
    for film in {f for f, _ in directed}:
        rows = [(d2, s, f1, d1) for f, d2 in directed if f == film for d, s in educated if d == d2 for f1, d1 in directed if (d1, s) in educated and d1 != d2 and f1 != film]
        answers = {r[2] for r in rows}
        if answers and (most is None or len(answers) <= most):
            out[film] = (sorted(answers), sorted({film, *(x for r in rows for x in (r[0], r[1], r[3]))} - answers))
    return out


def graph(spark, directed, educated):
    frames = {"P57": spark.createDataFrame(sorted(directed), "src string, dst string"), "P69": spark.createDataFrame(sorted(educated), "src string, dst string")}
    return frames.get


@pytest.fixture(scope="module")
def schools():
    """Films of several directors, directors of several schools, a school that one director owns nearly whole, an id of two kinds."""
    r = random.Random(5)
    directed = {(f"f{r.randrange(40)}", f"d{r.randrange(25)}") for _ in range(60)} | {(f"g{i}", "d90") for i in range(30)} | {("g1", "d91"), ("g31", "d91"), ("g32", "d92"), ("g33", "f3"), ("alone", "d99")}
    educated = {(f"d{i}", f"s{r.randrange(8)}") for i in range(25) for _ in range(r.randrange(3))} | {("d90", "s90"), ("d91", "s90"), ("d92", "s90"), ("f3", "s90"), ("d99", "s99"), ("d3", "s3"), ("d4", "s3")}
    return directed, educated


@pytest.mark.parametrize("most", [1, 3, 8, 33, None])
def test_hub_equals_brute_force(spark, schools, most):
    got = {r.anchors: (r.answers, r.bridges) for r in golden(SAME, graph(spark, *schools), most).collect()}
    assert got == brute(*schools, most)
    assert got or most == 1


def test_hub_is_counted_not_joined(spark):
    """Two thousand films at one school are four million pairs; none is made, nor where one director owns nearly all."""
    films = {(f"f{i}", f"d{i % 700}") for i in range(2000)} | {(f"g{i}", "e0") for i in range(2000)} | {("g", "e1")}
    edges = graph(spark, films, {(f"d{i}", "s") for i in range(700)} | {("e0", "t"), ("e1", "t")})
    rows = templates._few_bindings(SAME, templates.hub(SAME), edges, 30)
    assert {(r.film, r.f1) for r in rows.collect()} == {(f"g{i}", "g") for i in range(2000)}


@pytest.mark.parametrize("most", [30, None])
@pytest.mark.parametrize("query", ["per_question", "report", "reward_breakdown"])
def test_golden_sets_are_made_once(spark, sf_dir, query, most):
    """Scores need each template's joins once: no set is made twice and joined to itself."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    once = plan(metrics.questions(spark, sf_dir, most)).count("Relation [")
    assert plan(getattr(metrics, query)(spark, sf_dir, most)).count("Relation [") <= once
