import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lattica.llm import exact_dedup as E

DROP = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for d, text in rows:
        groups[(text or "").translate(DROP)].append((-len(text or ""), d is None, d or 0))
    out = []
    for d, text in rows:
        s = (text or "").translate(DROP)
        n, null, keep = min(groups[s])
        keep = None if null else keep
        out.append((d, keep, len(groups[s]), d == keep, hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(E.exact_dedup(odd)) == brute(rows)
    assert got(E.exact_dedup(odd, chunk=1000)) == brute(rows)
    assert E.exact_dedup(none).collect() == []


def test_equal_fingerprints_of_different_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(E.exact_dedup(df, primes=(3, 2))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, E.PIECE, E.PIECE + 1, 5 * E.PIECE + 17])
def test_pieces_combine(n):
    raw = bytes(random.Random(n).randrange(33, 126) for _ in range(n))
    want = [sum((c + 1) * pow(b, n - 1 - i, p) for i, c in enumerate(raw)) % p for b, p in zip(E.BASES, E.PRIMES)]
    data = np.frombuffer(b"  " + raw + b"\n", np.uint8)
    _, _, size, fp = E.fingerprint_slice(data, np.array([0, len(data)]), E._weights(E.PRIMES), E.PRIMES)
    assert size.tolist() == [n] and fp[0].tolist() == want
    half = n // 3
    parts = [[sum((c + 1) * pow(b, len(x) - 1 - i, p) for i, c in enumerate(x)) % p for b, p in zip(E.BASES, E.PRIMES)] for x in (raw[:half], raw[half:])]
    assert [E.combine(l, r, n - half, b, p) for l, r, b, p in zip(*parts, E.BASES, E.PRIMES)] == want
