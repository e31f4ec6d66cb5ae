"""Awkward tables for every operator: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, t string, k string, n int, h1 long, fp long, id string, words string, lines int, bits int, class string, host string, label string, size long, bucket int, r long, y double, x int"
TAIL = (7, "t", "k", 1, 2, 3, "i", "w", 4, 5, "c", "h", "l", 6, 7, 8, 0.5, 9)
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here today"
TEXTS = [
    (1, PROSE, "en", "a"),
    (2, PROSE + " again", "en", "a"),
    (3, PROSE, "en", None),
    (3, PROSE, "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \t\n\x0b\x0c\r ", None, "b"),
    (7, "A b\n\nA b\nÉté ÀÉ\n", "fr", "a"),
    (8, LONG, "en", "c"),
    (9, "12 34 !!", "en", "c"),
    (None, "no id at all in this row, is there one?", "en", "a"),
    (None, None, None, None),
    (10, "le chat noir dort sur la table et le chien aussi dans la maison verte", "fr", "c"),
    (11, "x\x00y \U0001f600 日本語 ſ", "xx", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *TAIL) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench_items(spark):
    return spark.createDataFrame([(1, "QUICK brown, fox jumps over the lazy dog and runs far! away"), (2, "chat noir"), (3, None), (4, "..."), (5, "chat noir")], "item_id long, text string")
