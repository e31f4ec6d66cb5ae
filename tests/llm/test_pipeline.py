import re

import corpus_pipeline as C
from lattica.llm import decontaminate, langid, minhash, mixing, registry, token_output


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    rows = {r.doc_id: r for r in docs.collect()}
    d = C.language(spark, docs, sf_dir)
    assert d.columns == docs.columns
    assert {r.doc_id for r in d.collect()} == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    kept = C.near_duplicates(spark, d, sf_dir)
    classes = minhash.near_classes(d).collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in classes}) and kept.columns == docs.columns
    clean = C.decontaminated(spark, kept, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r.doc_id for r in decontaminate.find_leaks(kept, bench).where("n_hit > 0").collect()}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect()} - hit
    mixed = C.mix(spark, clean, sf_dir)
    times = {r.doc_id: r.times for r in mixing.mix(clean).collect()}
    count = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert count == {k: v for k, v in times.items() if v}
    out = C.tokens(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count() and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    whole = C.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out))


def test_language_rejects_what_no_language_parses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "xqzw vbfgk wxq zzvk jjxq bvqk" * 9, None, "a", 9), (10**9 + 1, "это текст на другом языке " * 9, None, "a", 9)], docs.schema)
    kept = {r.doc_id for r in C.language(spark, docs.unionByName(odd), sf_dir).select("doc_id").collect()}
    assert not kept & {10**9, 10**9 + 1} and len(kept) > 100


def test_odd_rows_go_through(odd, none, spark, sf_dir):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in C.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert name == "tokens" or docs.columns == columns
        docs.collect()


def test_registry():
    names = {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES}
    assert names == set(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert langid.SYMBOLS == 64 and token_output.END == 2
