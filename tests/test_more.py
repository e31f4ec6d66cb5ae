"""Record builders, draws, guards, tools, and vectors with ties and nulls."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import api as A
from lattica.functions import parsing
from lattica.operators import evaluation, graph, records, splits, vectors
from lattica.plans.templates import TEMPLATES
from lattica.sources import files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict(recursive=True)


@pytest.fixture(scope="module")
def api(spark):
    t = spark.createDataFrame([("Q1", "P57", "Q2"), ("Q2", "P69", "Q3"), ("Q4", "P17", "Q3")], "src string, rel string, dst string")
    e = spark.createDataFrame([("Q1", "one", None), ("Q2", "two", "text"), ("Q3", None, None)], "qid string, title string, abstract string")
    a = spark.createDataFrame([("Q1", 0, "uno")], "qid string, pos int, alias string")
    labels = spark.createDataFrame([("P57", "director")], "pid string, label string")
    v = spark.createDataFrame([("Q1", [1.0, 0.0]), ("Q2", [0.0, 1.0]), ("Q3", None)], "id string, vec array<double>")
    return A.Retrieval(spark, t, e, a, labels, v, model=lambda texts: [[1.0, 0.1] if "one" in x else [0.1, 1.0] for x in texts])


BAD = [
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.System', 'lineSeparator')",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM parquet.`/root`",
    "SELECT * FROM other_table",
    "SELECT (SELECT max(value) FROM text.`/etc/hostname`)",
    "SELECT * FROM triple WHERE src IN (SELECT value FROM text.`/etc/hostname`)",
    "WITH x AS (SELECT * FROM csv.`/etc/hostname`) SELECT * FROM x",
    "SELECT * FROM triple JOIN text.`/etc/hostname` ON true",
    "INSERT INTO triple SELECT * FROM triple",
    "DROP VIEW triple",
    "CREATE TABLE x AS SELECT 1",
    "SET spark.sql.shuffle.partitions = 1",
    "SHOW TABLES",
    "SELECT * FROM range(10)",
    "SELECT input_file_name() FROM triple",
    "SELECT java_method('a', 'b') FROM triple",
    "SELECT 1) SELECT (2",
    "ADD JAR 'x'",
    "SELECT TRANSFORM (src) USING 'cat' AS (x) FROM triple",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'lineSeparator'))",
    "VALUES (reflect('java.lang.System', 'lineSeparator'))",
]


@pytest.mark.parametrize("query", BAD)
def test_refused(api, query):
    got = api.run_sql(query, timeout_s=60)
    assert got["rows"] == [] and got["error"]


@pytest.mark.parametrize("query,want", [
    ("SELECT replace('a', 'a', 'b') AS x", [{"x": "b"}]),
    ("SELECT 'drop; set' AS x -- insert", [{"x": "drop; set"}]),
    ("WITH t AS (SELECT dst FROM triple) SELECT count(*) AS n FROM t", [{"n": 3}]),
    ("SELECT count(*) AS n FROM triple WHERE src IN (SELECT qid FROM entity WHERE title LIKE '%o%')", [{"n": 2}]),
    ("SELECT date'2024-01-02' AS d, 1.50BD AS x, map('a', array(1)) AS m", None),
    ("SELECT d.x FROM (VALUES (1), (2)) AS d(x) ORDER BY x DESC LIMIT 1", [{"x": 2}]),
    ("(SELECT src FROM triple) EXCEPT (SELECT dst FROM triple) ORDER BY src", [{"src": "Q1"}, {"src": "Q4"}]),
])
def test_allowed(api, query, want):
    got = api.run_sql(query, timeout_s=60)
    if want is None:
        assert "map" in got["error"]  # not in the list
    else:
        assert got == {"rows": want, "n": len(want)}


def test_views_of_the_caller_stay(api, spark):
    spark.range(7).createOrReplaceTempView("triple")
    assert api.run_sql("SELECT count(*) AS n FROM triple", timeout_s=60)["rows"] == [{"n": 3}]
    assert spark.table("triple").count() == 7
    spark.catalog.dropTempView("triple")


def test_paths_have_titles_and_labels(api):
    (r,) = api.find_paths("Q1", "Q4").collect()
    assert [tuple(n) for n in r.nodes] == [("Q1", "one"), ("Q2", "two"), ("Q3", "Q3"), ("Q4", "Q4")]
    assert [tuple(e) for e in r.edges] == [("Q1", "P57", "director", "Q2"), ("Q2", "P69", "P69", "Q3"), ("Q4", "P17", "P17", "Q3")]


def test_paths_against_all_walks(spark):
    rng = random.Random(12)
    for _ in range(3):
        edges = [(f"Q{rng.randrange(14)}", f"P{rng.randrange(3)}", f"Q{rng.randrange(14)}") for _ in range(22)] + [("Q90", "P1", f"Q{i}") for i in range(14)]
        pairs = list({(f"Q{rng.randrange(14)}", f"Q{rng.randrange(14)}") for _ in range(12)})
        near = {}
        for a, r, b in edges:
            near.setdefault(a, []).append((f"-{r}>", b))
            if a != b:
                near.setdefault(b, []).append((f"<{r}-", a))
        want = set()
        for s, t in pairs:
            walks = [(s, s)]
            for n in range(1, 5) if s != t else ():
                walks = [(p + lab + v, v) for p, u in walks for lab, v in near.get(u, [])]
                if hit := sorted(p for p, v in walks if v == t):
                    want |= {(s, t, n, p, hit[:6].count(p)) for p in hit[:6]}
                    break
        got = Counter((r.s, r.t, r.length, r.path) for r in graph.shortest_paths(spark.createDataFrame(edges, "src string, rel string, dst string"), spark.createDataFrame(pairs, "s string, t string"), 4, 6).collect())
        assert {(*k, n) for k, n in got.items()} == want


def test_search_by_text_and_tools(api):
    client = A.Client(api)
    got = client.call("vector_search", {"query": "about one", "k": 1})
    assert got["rows"][0]["qid"] == "Q1"
    assert "error" in client.call("nope", {}) and "needs qid" in client.call("get_entity", {})["error"] and "error" in client.call("vector_search", {"query": "x", "k": 99})
    assert "error" in client.call("get_entity", {"qid": "Q999"})
    mock = A.Mock({"get_entity": [{"qid": "a"}, {"qid": "b"}]})
    assert [A.Client(mock).call("get_entity", {"qid": "Q1"})["qid"] for _ in range(3)] == ["a", "b", "b"] and len(mock.calls) == 3
    names = [t["function"]["name"] for t in A.tool_schemas()]
    assert names == list(A.TOOLS) and [t["input_schema"]["required"] for t in A.tool_schemas("input")][3] == ["src_qid", "dst_qid"]


def test_repeated_parameters_and_numbers(spark):
    text = F.lit("<function=f><parameter=k>1</parameter><parameter=k> -7 </parameter><parameter=z>7x</parameter></function> <function=bad name></function><function=g></function>")
    got = one(spark, c=parsing.with_numbers(parsing.parse_function_calls(text)))["c"]
    assert got == [{"name": "f", "arguments": {"k": "-7", "z": "7x"}, "numbers": {"k": -7}}, {"name": "g", "arguments": {}, "numbers": {}}]
    judged = parsing.parse_judge(F.lit('{"pids": ["p1", "P2 "], "unique": true}'))
    assert one(spark, a=parsing.judge_accepts(judged, F.array(F.lit("p2"), F.lit("P1"))))["a"]


def test_vectors_ties_nulls_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)] + [(2000, None)]
    df = spark.createDataFrame(base, "id long, vec array<double>").repartition(3)
    asked = [(i, v) for i, v in base if i % 100 == 0 and v is not None] + [(9999, None)]
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "SENT_BYTES", 100)
    monkeypatch.setattr(vectors, "CELLS", 64)
    got = {(r.q, r["rank"]): r.id for r in vectors.top_k(spark.createDataFrame(asked, "id long, vec array<double>"), df, 7).collect()}
    for q, v in asked:
        if v is None:
            assert (q, 1) not in got
            continue
        unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
        want = sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in base if w is not None)[:7]
        assert [got[q, k + 1] for k in range(7)] == [i for _, i in want]
    with pytest.raises(Exception, match="finite"):
        df.select(vectors.check_dim(F.col("vec"), 4).alias("v")).collect()
    with pytest.raises(Exception, match="the model gave"):
        vectors.embed(spark.createDataFrame([(1, "a")], "id long, text string"), vectors.hashed_words(8), 16).collect()


def test_collection(spark, tmp_path):
    path = f"{tmp_path}/c"
    assert vectors.collection(spark, path, 2) and not vectors.collection(spark, path, 2)
    spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, vec array<float>").write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="vectors of 3"):
        vectors.collection(spark, path, 2)
    assert vectors.collection(spark, path, 2, recreate=True) and spark.read.parquet(path).count() == 0


def test_render_takes_longer_names_first(spark):
    values = {"qid_film": F.lit("Q1"), "qid_film_a": F.lit("Q2")}
    assert one(spark, x=records.render(F.lit("  a $qid_film_a b $qid_film "), values))["x"] == "a 'Q2' b 'Q1'"
    assert records.query_of(TEMPLATES["star_costars"]) == "($fa)-[P161]->(x), ($fb)-[P161]->(x) => x"


def test_anchors(spark):
    df = spark.createDataFrame([("Q1", "", "Q2", "two")], "qid_a string, title_a string, qid_b string, title_b string")
    assert df.select(records.anchors_of(("a", "b")).alias("x")).first().x.asDict(recursive=True) == {"a": {"qid": "Q1", "title": "Q1"}, "b": {"qid": "Q2", "title": "two"}}
    with pytest.raises(Exception, match="no anchor a"):
        df.withColumn("qid_a", F.lit(None).cast("string")).select(records.anchors_of(("a",))).collect()


def test_mix_and_draws(spark):
    assert splits.parse_mix("40,35,25") == {2: 0.4, 3: 0.35, 4: 0.25}
    for bad in ("1,2", "1,2,x", "0,0,0", "-1,1,1", "nan,1,1", ""):
        with pytest.raises(ValueError):
            splits.parse_mix(bad)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    got = Counter(r.e for r in splits.draw_weighted(rows, {"a": 3, "b": 0, "c": 1}, "e").collect())
    assert set(got) == {"a", "c"} and abs(got["a"] - 3000) < 150
    assert {r.difficulty for r in splits.next_difficulty(rows, {2: 0.5, 3: 0.5}, 10, {2: 5}).collect()} == {3}
    assert {r.difficulty for r in splits.next_difficulty(rows, {2: 0.5, 3: 0.5}, 10, {2: 5, 3: 6}).collect()} == {2, 3}
    records_ = rows.withColumn("difficulty", (F.col("id").cast("int") % 3 + 1))
    counts = Counter(r.difficulty for r in splits.quota(records_, {1: 0.5, 2: 0.5}, 100, reached={1: 20}).collect())
    assert counts == {1: 30, 2: 50}


def test_windows_without_one_task(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x long, y long").repartition(5)
    best, want = None, []
    for _, x, y in sorted(rows, key=lambda r: (r[1], -r[2])):
        if best is None or y > best:
            want.append((x, y))
            best = y
    assert sorted((r.x, r.y) for r in evaluation.frontier(df, "x", "y").collect()) == want
    spent, keep = 0, []
    for k, x, _ in rows:
        spent += x
        if spent <= 3000:
            keep.append((k, spent))
    assert sorted((r.k, r.spent) for r in splits.within_budget(df, 3000, order="k", cost="x").collect()) == keep
    got = evaluation.latency(df.withColumn("g", F.col("k") % 2), "g", "x").collect()
    for r in got:
        v = sorted(x for k, x, _ in rows if k % 2 == r.g)
        assert (r.p50, r.p90, r.p99) == tuple(v[min(len(v) - 1, int(p * len(v)))] for p in (0.5, 0.9, 0.99)) and r.n == len(v)


def test_first_and_last_rows_over_files(spark, tmp_path):
    for name, rows in (("b", ["Q1\tlate", "Q2\tx"]), ("a", ["Q1\tearly", "Q1\tmid"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(rows) + "\n")
    assert {r.qid: r.abstract for r in files.read_texts(spark, str(tmp_path)).collect()} == {"Q1": "late", "Q2": "x"}
    assert {r.pid: r.label for r in files.read_relations(spark, str(tmp_path)).collect()} == {"Q1": "early", "Q2": "x"}


def test_dataset(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n')
    assert files.dataset(spark, f"{tmp_path}/x.jsonl").count() == 2 and files.dataset(spark, f"{tmp_path}/x.jsonl", 1).count() == 1
    assert files.dataset(spark, f"{tmp_path}/x.csv").first().b == "x\ny"


def test_lines(spark):
    n, mean = F.lit(3), F.lit(0.5)
    assert one(spark, x=evaluation.summary(F.lit("p"), n, mean, mean, F.lit(0.25)))["x"] == "p: n=3  NDCG=0.5000  recall@50=0.5000  F1=0.2500"
    assert one(spark, x=evaluation.progress(F.lit(2), F.lit(4), 10, F.lit(8.0)))["x"] == "2/10 accepted, 50.0% of 4 attempts, 0.50/s, 32 s to go"
    assert one(spark, x=splits.stop_reason(F.lit(1), F.lit(9), F.lit(1.0), 2, 9, 0.5))["x"] == "attempts"
