import re

import pytest

from lattica.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, k=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(k, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("page", [D.MAX_ITEM_BYTES, 20])
def test_odd_rows(odd, bench_items, page):
    items = [(r.item_id, r.text) for r in bench_items.collect()]
    rows = D.find_leaks(odd, bench_items, max_item_bytes=page).collect()
    want = sorted([(r.doc_id, *brute(r.text, items)) for r in odd.collect()], key=str)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str) == want
    assert sum(r.n_hit > 0 for r in rows) == 5


def test_spans_point_into_the_original(odd, bench_items):
    text = {r.doc_id: r.text for r in odd.where("doc_id = 1").collect()}[1]
    (r,) = D.find_leaks(odd.where("doc_id = 1"), bench_items).collect()
    assert [text[s.start : s.end] for s in r.spans] == ["quick brown fox jumps over the lazy dog and runs far away"]


def test_nothing_to_find(odd, none, bench_items):
    assert D.find_leaks(none, bench_items).collect() == []
    assert {r.n_hit for r in D.find_leaks(odd, bench_items.where("false")).collect()} == {0}
    assert D.clean_only(odd, bench_items.where("false")).count() == odd.count()


def test_clean_only_keeps_columns_and_rows(odd, bench_items):
    kept = D.clean_only(odd, bench_items)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 5


def test_random_against_brute_force(spark):
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items, rows = [(i, text(rng.randrange(0, 16))) for i in range(12)], [(i, text(rng.randrange(0, 120))) for i in range(40)]
    got = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=7).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == [(d, *brute(t, items, 7)) for d, t in rows]
