"""Templates, neighbours, paths and the API on small graphs."""

import random
from collections import defaultdict

import pytest

from lattica.api import Retrieval, intersect_neighbors
from lattica.operators import graph
from lattica.plans.templates import TEMPLATES, anchor_pool, bindings, describe, golden
from lattica.plans.triples import RELATIONS

EDGES = [("Q1", "P57", "Q2"), ("Q1", "P57", "Q2"), ("Q2", "P69", "Q3"), ("Q4", "P69", "Q3"), ("Q5", "P57", "Q4"), ("Q3", "P17", "Q6"), ("Q6", "P127", "Q6")]


@pytest.fixture(scope="module")
def triples(spark):
    return spark.createDataFrame(EDGES, "src string, rel string, dst string")


@pytest.fixture(scope="module")
def api(spark, triples):
    entities = spark.createDataFrame([("Q1", "film", "A film. More."), ("Q3", "school", None), ("Q9", "alone", "x")], "qid string, title string, abstract string")
    aliases = spark.createDataFrame([("Q1", 1, "b"), ("Q1", 0, "a")], "qid string, pos int, alias string")
    vecs = spark.createDataFrame([("Q1", [1.0, 0.0]), ("Q3", [0.6, 0.8]), ("Q9", [0.0, 1.0])], "id string, vec array<double>")
    return Retrieval(spark, triples, entities, aliases, spark.createDataFrame(sorted(RELATIONS.items()), "pid string, label string"), vecs)


def test_inventory():
    assert len(TEMPLATES) == 11
    used = set()
    for t in TEMPLATES.values():
        names = {v for a, _, b in t.edges for v in (a, b)}
        assert 2 <= t.hops <= 4 and t.hops == len(t.relations) and {*t.anchors, t.answer, *t.bridges} <= names and t.kind in ("chain", "star", "intersection")
        used |= set(t.relations)
        assert describe(t).count("->") == t.hops
    assert used == set(RELATIONS)


@pytest.mark.parametrize("name", TEMPLATES)
def test_bindings_against_nested_loops(spark, name):
    rng = random.Random(name)
    t = TEMPLATES[name]
    edges = {(f"Q{rng.randrange(9)}", r, f"Q{rng.randrange(9)}") for r in RELATIONS for _ in range(14)}
    df = spark.createDataFrame(sorted(edges), "src string, rel string, dst string")
    found = [{}]
    for a, r, b in t.edges:
        found = [{**m, a: s, b: d} for m in found for s, rel, d in edges if rel == r and m.get(a, s) == s and m.get(b, d) == d and (a != b or s == d)]
    op = {"<": lambda x, y: x < y, "<>": lambda x, y: x != y}
    found = [m for m in found if all(op[o](m[x], m[y]) for x, o, y in t.guards)]
    of = lambda rel: df.where(f"rel = '{rel}'").select("src", "dst")
    got = bindings(t, of)
    names = sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted({tuple(m[c] for c in names) for m in found})
    sets = defaultdict(set)
    for m in found:
        sets["|".join(m[a] for a in t.anchors)].add(m[t.answer])
    want = {}
    for k, v in sets.items():
        v -= set(k.split("|"))
        if 1 <= len(v) <= 3:
            want[k] = sorted(v)
    rows = golden(t, of, max_answers=3).collect()
    assert {r.anchors: r.answers for r in rows} == want
    assert all(not set(r.bridges) & set(r.answers) and r.id.startswith("kg-") for r in rows)
    assert anchor_pool(t, of).count() <= len(sets)


def test_degrees_and_cards(triples, api):
    d = {r.qid: (r.degree_out, r.degree_in) for r in graph.degrees(triples).collect()}
    assert d["Q6"] == (1, 2) and d["Q1"] == (2, 0) and d["Q3"] == (1, 2)
    r = api.get_entity("Q1").first()
    assert (r.title, r.aliases, r.degree_out) == ("film", ["a", "b"], 2)
    assert api.get_entity("Q2").first().title == "Q2"
    with pytest.raises(LookupError):
        api.get_entity("Q77")
    with pytest.raises(ValueError):
        api.get_entity("x1")


def test_neighbors(api):
    rows = api.get_neighbors("Q3").collect()
    assert [(r.src, r.rel, r.dst) for r in rows] == [("Q3", "P17", "Q6"), ("Q2", "P69", "Q3"), ("Q4", "P69", "Q3")] and {r.total for r in rows} == {3}
    assert rows[1].dst_title == "school" and rows[0].dst_title == "Q6" and rows[0].rel_label == "country"
    assert [r.src for r in api.get_neighbors("Q3", "P69", "in", 1, 1).collect()] == ["Q4"]
    assert api.get_neighbors("Q6").count() == 2  # the self-loop once
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"direction": "up"}, {"relation": "x"}):
        with pytest.raises(ValueError):
            api.get_neighbors("Q3", **bad)
    assert [r.qid for r in intersect_neighbors(api, "Q2", "Q4").collect()] == ["Q3"]


def test_paths(api):
    assert sorted(r.path for r in api.find_paths("Q1", "Q2").collect()) == ["Q1-P57>Q2"] * 2
    (r,) = api.find_paths("Q5", "Q3").collect()
    assert (r.length, r.path) == (2, "Q5-P57>Q4-P69>Q3")
    assert api.find_paths("Q1", "Q5", 3).collect() == [] and len(api.find_paths("Q1", "Q5", 4).collect()) == 2
    assert api.find_paths("Q1", "Q77").collect() == []
    with pytest.raises(ValueError):
        api.find_paths("Q1", "Q1")
    with pytest.raises(ValueError):
        api.find_paths("Q1", "Q2", 5)


def test_paths_against_breadth_first(spark):
    rng = random.Random(2)
    edges = [(f"Q{rng.randrange(25)}", f"P{rng.randrange(2)}", f"Q{rng.randrange(25)}") for _ in range(45)]
    near = defaultdict(list)
    for s, r, d in edges:
        near[s].append((f"-{r}>", d))
        if s != d:
            near[d].append((f"<{r}-", s))
    pairs = [(f"Q{rng.randrange(25)}", f"Q{rng.randrange(25)}") for _ in range(30)]
    want = []
    for s, t in {p for p in pairs if p[0] != p[1]}:
        walks = [(s, s)]
        for n in range(1, 5):
            walks = [(v, p + lab + v) for u, p in walks for lab, v in near[u]]
            hit = sorted(p for v, p in walks if v == t)
            if hit:
                want += [(s, t, n, p) for p in hit[:20]]
                break
    got = graph.shortest_paths(spark.createDataFrame(edges, "src string, rel string, dst string"), spark.createDataFrame(pairs, "s string, t string"), 4, 20)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vector_search(api):
    rows = api.vector_search([2.0, 0.0], 2).collect()
    assert [(r.qid, r.score) for r in rows] == [("Q1", 1.0), ("Q3", 0.6)] and rows[0].snippet == "A film. More."
    with pytest.raises(ValueError):
        api.vector_search([1.0, 0.0], 51)


def test_run_sql(api):
    got = api.run_sql("SELECT rel, count(*) AS n FROM triple GROUP BY rel ORDER BY rel", timeout_s=60)
    assert got["n"] == 4 and got["rows"][0] == {"rel": "P127", "n": 1}
    assert api.run_sql("SELECT * FROM triple a, triple b, triple c LIMIT 500", timeout_s=60)["n"] == 100
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)", "EXPLAIN SELECT 1"):
        assert api.run_sql(bad)["error"] and api.run_sql(bad)["rows"] == []
    assert "error" in api.run_sql("SELECT nope FROM triple", timeout_s=60)
    with pytest.raises(ValueError):
        api.run_sql("x" * 4001)
