"""Languages of short texts, of rare scripts, and many of them."""

import random

from pyspark.sql import functions as F

from lattica.llm import langid as L


def guess(spark, docs, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.lang_pred for r in L.identify(rows, L.train(docs)).orderBy("doc_id").collect()]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").cache()


def test_short_texts_and_rare_scripts(spark):
    rng = random.Random(5)
    scripts = {"la": range(0x61, 0x7B), "gr": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450), "a1": range(0x561, 0x587), "a2": range(0x561, 0x587), "ko": range(0xAC00, 0xAC00 + 900)}
    words = {k: ["".join(rng.choices([chr(c) for c in r], k=6)) for _ in range(60 if k != "ko" else 2000)] for k, r in scripts.items()}
    say = lambda k, n: " ".join(rng.choices(words[k], k=n))
    rows = [(say(k, 150 if k in ("la", "gr", "ru") else 60), k) for k in scripts for _ in range(20)]
    rows += [(t, "sh") for t in ["zug wuz gub", "wuz zug gub zug"] * 10]
    assert guess(spark, table(spark, rows), [say("a1", 8), say("a2", 8), say("ru", 8), say("ko", 30), "gub wuz zug"]) == ["a1", "a2", "ru", "ko", "sh"]


def test_more_languages_than_documents_fit(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGS", 3)
    docs = table(spark, [(f"{chr(97 + i) * 3} {chr(98 + i) * 4} " * 20, f"l{i:02}") for i in range(24) for _ in range(12)])
    parser = L.train(docs.withColumn("doc_id", F.col("doc_id")), 10)
    assert parser.langs == [f"l{i:02}" for i in range(24)]


SYLLABLES = {"aa": "ka lo mi tu re", "bb": "ka lo mi su ne"}


def told(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_close_languages_with_unequal_samples(spark):
    rng = random.Random(4)
    rows = [(i, told(rng, "aa", 200), "aa") for i in range(60)] + [(1000 + i, told(rng, "bb", 40), "bb") for i in range(6)]
    parser = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(i, told(rng, "aa" if i % 2 else "bb", 60)) for i in range(40)]
    got = L.identify(spark.createDataFrame(tests, "doc_id long, text string"), parser).collect()
    assert sum(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in got) >= 38


def test_rows_without_ids_are_learned_from(spark):
    rng = random.Random(6)
    rows = [(None, told(rng, lang, 100), lang) for lang in ("aa", "bb") for _ in range(20)] * 3
    parser = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.langs == ["aa", "bb"]
    got = L.identify(spark.createDataFrame([(1, told(rng, "bb", 80))], "doc_id long, text string"), parser).collect()
    assert got[0].lang_pred == "bb"


def test_foreign_texts_are_rejected(spark):
    rng = random.Random(8)
    rows = [(i, told(rng, lang, 120), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    parser = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = told(rng, "aa", 50)
    tests = [own, "ka.", told(rng, "bb", 3), "".join(rng.sample(own * 3, len(own))), "это другой язык, которого не учили", "xqzw vbfg xwq zzv", "12 34", None]
    df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    assert sorted(r.doc_id for r in L.known_only(df, parser).collect()) == [0, 1, 2]
