"""Sources, sinks, splits and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import evaluation, splits, vectors
from lattica.sources import files
from lattica.streaming import incremental


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines))
    return str(path)


def test_ragged_and_triples(spark, tmp_path):
    p = put(tmp_path / "a.txt", 'Q1\tone "x"\ttwo', "", "Q2", "Q1\tlast\t\ttabs")
    assert sorted((r.qid, list(r["values"])) for r in files.read_ragged(spark, p).collect()) == [("Q1", ["last", "", "tabs"]), ("Q1", ['one "x"', "two"]), ("Q2", [])]
    assert {r.qid: r.abstract for r in files.read_texts(spark, p).collect()}["Q1"] == "last\t\ttabs"
    assert {r.pid: r.label for r in files.read_relations(spark, p).collect()} == {"Q1": 'one "x"'}
    t = put(tmp_path / "t.txt", "a\tb\tc", "a\tb", "a\tb\tc\td", "")
    assert [tuple(r) for r in files.read_triples(spark, t).collect()] == [("a", "b", "c")]


def test_question_records(spark, tmp_path):
    good = {"id": "a", "question": "q", "answer_qids": ["Q1", "Q1", "Q2"], "source": "kg_pattern", "difficulty": 2}
    (r,) = files.read_questions(spark, put(tmp_path / "g.jsonl", json.dumps(good), "")).collect()
    assert r.answer_qids == ["Q1", "Q2"] and r.bridge_qids == []
    for change in ({"answer_qids": ["x"]}, {"source": "other"}, {"difficulty": 0}, {"question": None}):
        with pytest.raises(Exception):
            files.read_questions(spark, put(tmp_path / "b.jsonl", json.dumps(good | change))).collect()
    with pytest.raises(Exception):
        files.read_questions(spark, put(tmp_path / "c.jsonl", "{torn")).collect()


def test_tolerant_and_resume(spark, tmp_path):
    rec = lambda i, q: json.dumps({"id": i, "question": q, "answer_qids": ["Q1"], "difficulty": "3"})
    put(tmp_path / "in" / "b.jsonl", rec("x", "second"), "{bad", rec("y", "why"))
    put(tmp_path / "in" / "a.jsonl", rec("x", "first"), json.dumps({"id": "z", "question": "no answers"}), "")
    got = {r.id: r.question for r in files.read_questions_tolerant(spark, str(tmp_path / "in")).collect()}
    assert got == {"x": "first", "y": "why"}
    with pytest.raises(Exception):
        files.read_questions_tolerant(spark, str(tmp_path / "none")).collect()
    done, counts = files.resume_counts(spark, put(tmp_path / "r.jsonl", '{"id": "a", "difficulty": 1}', '{"id": "a", "difficulty": 1}', '{"id": "b", "diff'))
    assert [r.id for r in done.collect()] == ["a"] and [tuple(r) for r in counts.collect()] == [(1, 1)]
    assert files.resume_counts(spark, str(tmp_path / "missing"))[0].collect() == []


def test_append_leaves_nulls_out(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "id string, cypher string")
    files.append_records(rows, str(tmp_path / "out"))
    assert files.append_new(rows.union(spark.createDataFrame([("c", None)], "id string, cypher string")), str(tmp_path / "out")) is not None
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"id": "a"}, {"id": "b", "cypher": "x"}, {"id": "c"}]))


def test_verify_manifest_status_config(spark, tmp_path):
    p = put(tmp_path / "l.txt", "a", "b")
    rows = {r.path: r.ok for r in files.verify_lines(spark, {p: 2, str(tmp_path / "no"): 0, str(tmp_path / "none"): 1}).collect()}
    assert rows[p] and not rows[str(tmp_path / "none")]
    (m,) = files.manifest(spark, str(tmp_path)).collect()
    assert (m.name, m.bytes) == ("l.txt", 3) and len(m.sha256) == 64
    assert {r.name: r.rows for r in files.status({"x": spark.range(3), "y": spark.range(0)}).collect()} == {"x": 3, "y": 0}
    assert files.load_config(put(tmp_path / "c.json", '{"k": 5, "odd": 1}'), ("k",)) == {"k": 5} and files.load_config("/none", ("k",)) == {}
    assert files.download("file:///none", p) is False


def records(spark, n=2000):
    return spark.range(n).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), (F.col("id") % 4).cast("double").alias("rank"), (F.col("id") % 4 + 1).cast("int").alias("difficulty"))


def test_splits(spark):
    n = splits.split(records(spark)).where("split = 'val'").count()
    assert 0.03 * 2000 <= n <= 0.07 * 2000
    assert splits.validation(records(spark), 0.5, 20).count() == 20
    order = [r["rank"] for r in splits.curriculum(records(spark, 200), "sorted").orderBy("place").collect()]
    assert order == sorted(order)
    rows = splits.curriculum(records(spark, 200), "mixed").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(200)) and all({x["rank"] for x in rows[i : i + 4]} == {0, 1, 2, 3} for i in range(0, 200, 4))
    off = [[r.id for r in splits.curriculum(records(spark, 50), "off", s).orderBy("place").collect()] for s in (1, 1, 2)]
    assert off[0] == off[1] != off[2]
    with pytest.raises(ValueError):
        splits.curriculum(records(spark), "other")
    got = {r.difficulty: r["count"] for r in splits.quota(records(spark), {1: 0.1, 2: 0.3, 3: 0.6}, 100).groupBy("difficulty").count().collect()}
    assert got == {1: 10, 2: 30, 3: 60}


def test_vectors(spark):
    a = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, vec array<double>")
    assert vectors.parity(a, a).first().asDict() == {"n": 4, "mean_cosine": 1.0, "min_cosine": 1.0, "missing": 0, "ok": True}
    assert vectors.parity(a, a.where("id > 0")).first().missing == 1
    hits = vectors.top_k(a, a, 2)
    assert sorted((r.q, r.id, r["rank"]) for r in hits.collect()) == sorted([(i, i, 1) for i in range(4)] + [(i, 0 if i else 1, 2) for i in range(4)])
    assert vectors.top_k(a.where("false"), a, 2).count() == 0
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([1.0, float("nan")],)], "v array<double>").select(vectors.check_dim(F.col("v"), 2)).collect()


def test_latency_takes_the_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)], "e string, v double")
    got = {r.e: (r.p50, r.p90, r.p99) for r in evaluation.latency(rows, "e", "v").collect()}
    assert got == {"a": (5.0, 9.0, 9.0), "b": (5.0, 5.0, 5.0)}


def test_stream_takes_each_file_once(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    rows = lambda *r: spark.createDataFrame(r, incremental.ENTITY)
    go = lambda: incremental.run_available(spark, at("in"), at("index"), at("state"))
    rows(("Q1", "one", "x y", 1), ("Q2", None, None, 1)).write.mode("append").parquet(at("in"))
    go()
    go()
    rows(("Q1", "uno", "z", 2), ("Q1", "old", "z", 0)).write.mode("append").parquet(at("in"))
    go()
    got = {r.qid: (r.doc_text, r.version) for r in incremental.current(spark, at("index")).collect()}
    assert got == {"Q1": ("uno. z", 2), "Q2": ("Q2. ", 1)}
