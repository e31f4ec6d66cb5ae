"""The deduced template against explicit occurrence vectors, and pages where it decides."""

import random
from collections import Counter, defaultdict

import pyarrow as pa

from lattica.llm import html_extract as H


def texts(spark, rows):
    pages = spark.createDataFrame([(i, f"http://h.example.org/{i}", s) for i, s in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in H.extract(pages).orderBy("page_id").collect()]


def page(rng, i):
    items = "".join(f"<li><a href=/{k}>{rng.choice('abcdef') * 4}</a></li>" for k in range(rng.randrange(1, 4)))
    extra = "<section class=note><p>always here</p></section>" if rng.random() < 0.7 else ""
    return f"<html><body><div class=top><ul>{items}</ul></div>{extra}<article><h1>Head {i}</h1>{''.join(f'<p>Part {rng.randrange(10**6)} of {i}</p>' for _ in range(rng.randrange(1, 5)))}</article><div class=low>fixed words</div></body></html>"


def test_classes_against_explicit_vectors():
    rng = random.Random(3)
    for _ in range(20):
        rows = [page(rng, i) for i in range(rng.randrange(3, 9))]
        counts = []
        for s in rows:
            p = H.Page(s)
            counts.append(Counter(["", *p.paths, *(H.text_token(b[0], b[1]) for b in p.blocks if not b[4])]))
        vectors = defaultdict(set)
        for token in set().union(*counts):
            vectors[tuple(c[token] for c in counts)].add(token)
        want = {frozenset(x) for x in vectors.values() if len(x) > 1}
        batch = pa.RecordBatch.from_pydict({"host": ["h"] * len(rows), "h": [rng.getrandbits(62) for _ in rows], "html": rows})
        got = [x for b in H._tokens([batch]) for x in b.to_pylist()]
        classes = H.valid_classes([(x["token"], x["pages"], (x["hi"], x["lo"]), x["chars"], x["links"]) for x in got])
        assert {frozenset(r[0] for r in c) for c in classes} == want


def test_repeated_template_block_in_articles_goes(spark):
    pages = [f"<html><body><article><h1>Head {i}</h1><p>Sign up for our letter today</p><p>The story of day {i} tells of {i * 7} things and of many more.</p><p>It ends with {i * 3} words.</p><p>Read it again tomorrow</p></article></body></html>" for i in range(8)]
    assert texts(spark, pages) == [f"Head {i}\n\nThe story of day {i} tells of {i * 7} things and of many more.\n\nIt ends with {i * 3} words." for i in range(8)]
    assert "Sign up" in H.main_text(H.Page(pages[0]), None)  # without the template it stays


def test_copies_of_an_article_stay(spark):
    pages = ["<html><body><article><h1>Head</h1><p>One story that every page of the host tells.</p></article><footer>foot</footer></body></html>"] * 6
    assert texts(spark, pages) == ["Head\n\nOne story that every page of the host tells."] * 6


def test_half_of_the_pages_copy_a_passage(spark):
    pages = [f"<html><body><article><h1>Head {i}</h1><p>{'A passage that half of the pages share.' if i % 2 else f'Own words {i * 11} here.'}</p><p>Story {i} goes on for long.</p></article></body></html>" for i in range(8)]
    got = texts(spark, pages)
    assert all("half of the pages" in t for t in got[1::2])


def test_box_beside_an_article_without_a_telling_name(spark):
    pages = [f"<html><body><div class=x1><p>Seen {i * 31} times</p></div><article><h1>Head {i}</h1><p>Story {i} is long enough to be the main text of the page.</p></article><div class=x2>Number {i * 17}</div></body></html>" for i in range(6)]
    assert texts(spark, pages) == [f"Head {i}\n\nStory {i} is long enough to be the main text of the page." for i in range(6)]
