import re
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import mixing as X


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(df, weights=X.WEIGHTS):
    rows, got = df.collect(), X.mix(df, weights).collect()
    assert sorted((str(r.doc_id), size(r.text)) for r in rows) == sorted((str(r.doc_id), r.size) for r in got)
    total = defaultdict(int)
    for r in rows:
        total[r.source] += size(r.text)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, X.targets([(s, total[s]) for s in names], weights)))
    pairs = {(total[s], round(want[s], 6)) for s in names}
    assert {(r.source_size, round(r.target, 6)) for r in got} == pairs
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.times <= 3
        taken[(r.source_size, round(r.target, 6))] += r.times * r.size
    return taken


def test_odd_rows(odd, none):
    check(odd)
    assert X.mix(none).collect() == []
    assert X.mixed_rows(none).collect() == []
    mixed = X.mixed_rows(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0


def test_targets_stop_at_three_times_the_source():
    got = X.targets([("a", 1), ("b", 1000), ("c", 10), (None, 3)])
    assert got[0] == 3 and sum(got) == pytest.approx(1014) and all(t <= 3 * n + 1e-9 for t, n in zip(got, (1, 1000, 10, 3)))
    assert X.targets([("a", 0)]) == [0.0] and X.targets([]) == []


def test_sums_come_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (i * 7919 % 301)), f"s{i % 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for (_, target), taken in check(df).items():
        assert abs(taken - target) <= 1
    again = X.mix(df).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, X.mix(df.repartition(7)).collect()))


def test_fit_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = np.unique(rng.integers(0, 12, 4))
        c = rng.integers(0, 5, len(n))
        budget = int(rng.integers(0, 60))
        sums = {0}
        for k, m in zip(n, c):
            sums = {s + k * j for s in sums for j in range(m + 1)}
        best = max(s for s in sums if s <= budget)
        take = X.fit(n, c, budget, dp_words=int(rng.integers(1, 64)))
        assert (take >= 0).all() and (take <= c).all() and (take * n).sum() <= best
        full = X.fit(n, c, budget)
        assert (full >= 0).all() and (full <= c).all() and (full * n).sum() == best


def test_equal_sizes_are_ranked_in_buckets(spark):
    df = spark.createDataFrame([(i, "one two", "a" if i % 10 else "b") for i in range(3000)], "doc_id long, text string, source string")
    for (_, target), taken in check(df).items():
        assert abs(taken - target) <= 2


def test_mixed_rows_repeat_rows(spark):
    df = spark.createDataFrame([(i, "w " * (5 + i % 3), "a" if i else "b") for i in range(50)], "doc_id long, text string, source string")
    want = sum(r.times for r in X.mix(df).collect())
    assert X.mixed_rows(df).count() == want


def test_reserved_names(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 3), "a", 1, 2, 3, "x") for i in range(9)], "doc_id long, text string, source string, __key int, key_ int, times int, `a b` string")
    assert X.mixed_rows(df).columns == df.columns and X.mixed_rows(df).count() == 9
