"""Crashes of an earlier state, one small test each, and work that must be linear."""

import re
import time

from pyspark.sql import functions as F

from lattica.llm import decontaminate, exact_dedup, line_dedup, quality

WORDS = "the quick brown fox jumps over the lazy dog and runs far away"


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, WORDS), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, WORDS), (7, WORDS), (None, WORDS + " today")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert got[1]["items"] == ["7", None] and got[2]["items"] == []


def test_n_chars_that_is_no_number(spark):
    docs = spark.createDataFrame([(i, WORDS, "many") for i in range(40)] + [(1, WORDS, "9")], "doc_id long, text string, n_chars string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)


def test_a_document_of_very_many_lines(spark):
    n = 300_000
    many = "\n".join("same line" if i % 3 == 0 else f"own {i}" for i in range(n))
    docs = spark.createDataFrame([(0, many), *((i, "Same line \nother") for i in range(1, 12))], "doc_id long, text string").cache()
    docs.count()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    took = time.time() - began
    assert got[0].n_lines == n and got[0].n_dropped == n // 3 and got[0].kept_text == "\n".join(f"own {i}" for i in range(n) if i % 3)
    assert got[5].n_dropped == 2 and got[5].kept_text == ""
    assert took < 120


def test_the_text_is_hashed_below_the_explode(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    split = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), line_dedup._lines(F.col("text")).alias("lines")).select("d", "t", F.posexplode("lines"))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate[^\n]*\n(.*\n)*.*xxhash64", plan)


def test_a_group_of_very_many_copies(spark):
    docs = spark.createDataFrame([(i, WORDS if i % 2 else f"own {i}") for i in range(2000)], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == 2000 and all(r.keep_id == (1 if d % 2 else d) and r.group_size == (1000 if d % 2 else 1) for d, r in got.items())
