import numpy as np
import pytest

from lattica.llm import langid as L
from lattica.llm import quality as Q


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = Q.Machine(0.3, rng.normal(size=Q.DIMS), rng.normal(size=(Q.DIMS, Q.RANK)))
    at, x = rng.choice(Q.DIMS, 12, replace=False), rng.normal(size=12)
    want = 0.3 + (m.w[at] * x).sum() + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(12) for j in range(i))
    got, _ = m.raw(np.zeros(12, np.int64), at, x)
    assert got[0] == pytest.approx(want, rel=1e-5)


def test_quality_is_learnt_and_held_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(i, ("good words here and there " * 20) if i % 2 else "BAD!! $$$ " * 30, "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = Q.score(docs, Q.train(docs, labels)).where("held_out").collect()
    assert len(got) > 50 and all((r.score >= 0.7) == bool(r.doc_id % 2) for r in got)


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, 0), (8, None)], "doc_id long, quality int")
    got = Q.score(odd, Q.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = Q.train(odd, labels.where("false"))
    assert {round(r.score, 1) for r in Q.score(odd, empty).collect()} == {0.5}
    assert Q.score(none, empty).collect() == []
    assert Q.score(odd.drop("n_chars"), empty).count() == odd.count()


def test_scores_ignore_what_is_no_feature(odd, spark):
    from pyspark.sql import functions as F

    m = Q.fit([(np.array([3, Q.WORD_DIMS + 5]), np.array([1.0, 0.3]))] * 4, np.array([1.0, 0.0, 1.0, 1.0]))
    other = odd.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("zz"))
    score = lambda df: sorted((str(r.doc_id), r.score) for r in Q.score(df, m).collect())
    assert score(odd) == score(other)


def test_suffix_automaton_knows_every_substring():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 3, 60)
    a = L.suffix_automaton(s)
    have = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}

    def known(t):
        state = 1
        for c in t:
            state = int(a[state, c])
            if not state:
                return False
        return True

    assert all(known(t) for t in have)
    for _ in range(300):
        t = tuple(rng.integers(0, 3, rng.integers(1, 9)))
        assert known(t) == (t in have)


def test_phrases_against_a_plain_parse():
    rng = np.random.default_rng(6)
    train = rng.integers(0, 4, 80)
    parser = L.Parser(["a"], L.Symbols([]), [L.suffix_automaton(train)])
    have = {tuple(train[i:j]) for i in range(80) for j in range(i + 1, 81)}
    texts = [rng.integers(0, 5, n) for n in (0, 1, 7, L.PIECE - 1, L.PIECE, L.PIECE + 1, 3 * L.PIECE + 5)]

    def plain(t):
        total = 0
        for b in range(0, len(t), L.PIECE):
            piece, i = t[b : b + L.PIECE], 0
            while i < len(piece):
                j = i + 1
                while j < len(piece) and tuple(piece[i : j + 1]) in have:
                    j += 1
                i, total = j, total + 1
        return total

    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert parser.phrases(np.concatenate(texts).astype(np.uint8), off)[0].tolist() == [plain(t) for t in texts]


def test_langid_odd_rows(odd, none):
    parser = L.train(odd, 10)
    rows = {(r.doc_id, r.lang_pred): r.score for r in L.identify(odd, parser).collect()}
    assert len(L.identify(odd, parser).collect()) == odd.count()
    assert {k[0] for k in rows if k[1] == "und"} >= {4, 5, 6, 9} and all(0 <= s <= 1 for s in rows.values())
    assert L.identify(none, parser).collect() == []
    nothing = L.train(none)
    assert {r.lang_pred for r in L.identify(odd, nothing).collect()} == {"und"}
    kept = L.known_only(odd, parser)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 9})


def test_langid_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n = got.count()
    assert n and got.where("lang = lang_pred").count() >= 0.95 * n
