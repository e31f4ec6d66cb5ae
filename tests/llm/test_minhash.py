import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import minhash as M
from lattica.llm.components import components


def plain_jp(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def random_pair(rng):
    x = {int(i): float(rng.integers(1, 5)) for i in rng.choice(40, 20, replace=False)}
    y = {i: w if rng.random() < 0.7 else float(rng.integers(1, 5)) for i, w in x.items() if rng.random() < 0.9} | {100 + i: 1.0 for i in range(int(rng.integers(0, 4)))}
    return x, y


def arrays(x):
    k = np.array(sorted(x), np.uint64)
    return k, np.array([x[int(i)] for i in k])


def test_exact_similarity():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = random_pair(rng)
        assert M.probability_jaccard(*arrays(x), *arrays(y)) == pytest.approx(plain_jp(x, y))


def test_signatures_estimate_it():
    rng = np.random.default_rng(2)
    for _ in range(4):
        x, y = random_pair(rng)
        (hx, wx), (hy, wy) = arrays(x), arrays(y)
        doc = np.repeat([0, 1], [len(hx), len(hy)])
        sig = M.signatures(doc, np.concatenate([hx, hy]), np.concatenate([wx, wy]), 2, 4096)
        assert (sig[0] == sig[1]).mean() == pytest.approx(plain_jp(x, y), abs=0.04)


def classes(rows):
    sets = M._sets(__import__("pyarrow").array([t or "" for _, t in rows]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and M.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("block", [M.BLOCK, 8])
def test_groups_against_all_pairs(spark, block):
    rng = random.Random(7)
    rows, base = [], [f"w{rng.randrange(3000)}" for _ in range(150)]
    for i in range(70):  # near copies of one text at all distances, so that a leader alone would miss links
        rows.append((i, " ".join(edited(rng, base, rng.randrange(0, 9)))))
    for i in range(70, 110):
        own = [f"v{rng.randrange(3000)}" for _ in range(60)]
        rows += [(i * 10, " ".join(own)), (i * 10 + 1, "  ".join(own).upper()), (i * 10 + 2, " ".join(edited(rng, own, 1)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in M.near_classes(df, block=block).collect()}
    assert got == classes(rows)


def test_units_against_all_pairs():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = [(i, " ".join(edited(rng, base if i % 3 else base + base[:40], rng.randrange(0, 12)))) for i in range(120)]
    sets = M._sets(pa.array([t for _, t in rows]))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in M.spanning_links([i for i, _ in rows], [i // 2 for i, _ in rows], sets, 0.8):
        assert M.probability_jaccard(*sets[a], *sets[b]) >= 0.8
        root[find(a)] = find(b)
    for i, _ in rows:
        root[find(i)] = find(i // 2 * 2)
    want = classes(rows)
    for a in range(120):
        for b in range(a):
            assert want[a] != want[b] or find(a) == find(b)
    met = M._first_met(2, [[{"band": 0, "bh": 5}, {"band": 2, "bh": 9}], [{"band": 0, "bh": 5}, {"band": 2, "bh": 9}], [{"band": 2, "bh": 9}]])
    assert met[0, 2] and met[1, 2] and not met[0, 1]


def test_many_near_copies_are_one_class(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 7)))) for i in range(500)]
    got = {r.doc_id: r.class_id for r in M.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), block=64).collect()}
    assert got == classes(rows)


def test_odd_rows(odd, none):
    got = M.near_classes(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].class_id == by[3].class_id == by[2].class_id == 1 and not by[2].kept
    assert all(by[d].class_id == d and by[d].kept for d in (4, 5, 6, 7, 8))
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    assert M.near_classes(none).collect() == []
    kept = M.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3)").count() == 1 and kept.where("doc_id is null").count() == 2


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.n: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


def test_ids_of_other_types_and_reserved_names(spark):
    words = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, words, 1, 2), (2, words + " x", 3, 4), (3, "other text", 5, 6)], "doc_id int, text string, key_ int, __key int")
    for kind in ("smallint", "decimal(20,0)", "string", "int"):
        got = M.near_classes(df.withColumn("doc_id", df.doc_id.cast(kind))).collect()
        assert sorted(str(r.class_id) for r in got) == ["1", "1", "3"]
    kept = M.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.doc_id: r.class_id for r in M.near_classes(docs).collect()} == classes(rows)
