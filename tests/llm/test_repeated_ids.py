"""Rows that share a doc_id but not a text."""

from lattica.llm import minhash as M


def test_each_text_of_a_doc_id_is_a_document(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    other = " ".join(f"c{i}" for i in range(60))
    rows = [(1, one), (5, one + " more"), (5, two), (7, other), (7, other), (-3, two + " more"), (9, None), (9, "x y z")]
    got = M.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted([(1, one), (7, other), (-3, two + " more"), (9, ""), (9, "x y z")])


def test_a_clean_text_stays_beside_a_copy(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    got = M.one_of_each(spark.createDataFrame([(1, one), (5, one + " more"), (5, two)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, one), (5, two)]
