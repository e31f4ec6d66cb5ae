import hashlib
from collections import defaultdict

import pytest

from lattica.llm.line_dedup import keep_bitmaps, line_dedup

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(WS)


def brute(rows, least, keep="none"):
    docs = defaultdict(set)
    first = {}
    for d, text in rows:
        for p, line in enumerate((text or "").split("\n")):
            if key(line):
                docs[key(line)].add(d)
                at = (d is not None, d or 0, p)
                first[key(line)] = min(first.get(key(line), at), at)
    often = {k for k, v in docs.items() if len(v) >= least}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        stay = [x for p, x in enumerate(lines) if key(x) not in often or (keep == "first" and first[key(x)] == (d is not None, d or 0, p))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(line_dedup(odd, min_docs=2)) == brute(rows, 2)
    assert got(line_dedup(odd, min_docs=10)) == brute(rows, 10)
    assert line_dedup(none).collect() == []


@pytest.mark.parametrize("keep", ["none", "first"])
def test_many_lines(spark, keep):
    rows = [(i, "\n".join(f" Line {(i * j) % 7} " if j % 3 else f"own {i} {j}" for j in range(150 + i))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup(df, 10, keep)) == brute(rows, 10, keep)


def test_bitmaps_leave_out_kept_words(spark):
    rows = [(i, "\n".join(["same"] + [f"{i} {j}" for j in range(200)] + ["same"])) for i in range(12)]
    for r in keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [(w.word, w.bits) for w in r.words] == [(0, 1), (3, 1 << 9)] and r.n_dropped == 2


def test_no_python_in_the_plan(odd):
    plan = line_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digest_of_nothing_kept(spark):
    df = spark.createDataFrame([(i, "same") for i in range(10)], "doc_id long, text string")
    assert {r.kept_text for r in line_dedup(df).collect()} == {""}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
