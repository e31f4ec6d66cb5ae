"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, one scan of each text.

Texts and items are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Every window of WINDOW
consecutive item words is a key of the automaton, as a sequence of word numbers; an item of fewer words, but not
none, is one key. A text is scanned once as word numbers; a match ending at word e marks the words it covers, and
word positions map back to code-point offsets of the original text where spans are asked for.

The automaton's items are broadcast in pages of MAX_ITEM_BYTES at most. A benchmark of one page is one scan of the texts;
a larger one is scanned page by page, each adding to the marks of the pages before it, so that neither the driver nor a
worker ever holds more than a page.

Cases: a null or empty text or item has no words; equal items are each listed; items with a null id
count as one item, listed last as null; repeated rows each get a row; columns
other than doc_id, text and item_id are ignored; no benchmark rows means nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._text import TO_WORDS, limits, tidy
from lattica.session import ensure_checkpoint_dir, ship, table

WINDOW = 10
#: Bytes of item text of a page; its automaton takes about 60 times that.
MAX_ITEM_BYTES = 2 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


def windows_of(words: list, k: int = WINDOW) -> list[tuple]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


class Matcher:
    """The automaton of some items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple], k: int = WINDOW):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            for w in windows_of(words_of(text), k):
                owners.setdefault(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(who)))
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words (merged, end exclusive) and the items found."""
        if not self.some or not words:
            return [], set()
        found, spans = set(), []
        for end, (n, who) in self.automaton.iter(tuple(map(self.number.get, words, repeat(0)))):
            found |= who
            a, b = end - n + 1, end + 1
            while spans and spans[-1][1] >= a:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))
        return spans, found


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in the original text of spans of words."""
    at = [m.span() for m in _WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_made: list = [None, None, None]


def _matcher(items: list[tuple], k: int) -> Matcher:
    """The automaton of a broadcast page; a worker builds it once and keeps the last."""
    if _made[0] is not items or _made[1] != k:
        _made[:] = items, k, Matcher(items, k)
    return _made[2]


def _scan(batches: Iterable[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """Adds a page's matches to those of the pages before it (hits are spans of words)."""
    matcher = _matcher(sent.value, k)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_words, hits, items, where = [], [], [], []
        for text, had, known in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "items"))):
            words = words_of(text)
            found, who = matcher.scan(words)
            if had:
                found = _merge(found + [(x["start"], x["end"]) for x in had])
            n_words.append(len(words))
            hits.append([{"start": a, "end": b} for a, b in found])
            items.append(sorted(who.union(known), key=lambda i: (i is None, i or "")))
            where.append([{"start": a, "end": b} for a, b in original_spans(text or "", found)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(hits, span), pa.array(items, pa.list_(pa.string())), pa.array(where, span)], names=["doc_id", "text", "n_words", "hits", "items", "spans"])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pages(benchmark: DataFrame, max_item_bytes: int) -> Iterator[list[tuple]]:
    """The items in pages of max_item_bytes of text (an item that is longer is a page), of which the driver holds one; at least one page."""
    page: list[tuple] = []
    size = sent = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("text is not null").toLocalIterator():
        n = len(row["text"].encode("utf-8", "replace"))
        if page and size + n > max_item_bytes:
            yield page
            page, size, sent = [], 0, sent + 1
        page.append((row["i"], row["text"]))
        size += n
    if page or not sent:
        yield page


def _each_page(rows: DataFrame, benchmark: DataFrame, max_item_bytes: int, step) -> DataFrame:
    """step(rows, broadcast page) for one page after the other; between pages rows are checkpointed, so a worker has one automaton."""
    ensure_checkpoint_dir(rows.sparkSession)
    for i, page in enumerate(_pages(benchmark, max_item_bytes)):
        rows = step(rows.checkpoint() if i else rows, rows.sparkSession.sparkContext.broadcast(page))
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (code points of the original) of every row."""
    ship(docs.sparkSession)
    limits(docs.sparkSession)
    spans = "array<struct<start: long, end: long>>"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_words long, hits {spans}, items array<string>, spans {spans}"
    rows = docs.select("doc_id", "text", F.array().cast(spans).alias("hits"), F.array().cast("array<string>").alias("items"))
    found = _each_page(rows, benchmark, max_item_bytes, lambda df, sent: df.mapInArrow(lambda it: _scan(it, sent, window), schema))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _clean(batches: Iterable[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(sent.value, k)
    for batch in batches:
        found = [not matcher.scan(words_of(t))[1] for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array(found, pa.bool_()))


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item."""
    ship(docs.sparkSession)
    limits(docs.sparkSession)
    return _each_page(docs, benchmark, max_item_bytes, lambda df, sent: df.mapInArrow(lambda it: tidy(_clean(it, sent, window)), docs.schema))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside occurrences of ten-word windows of the benchmark's items."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bk AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)
), dk AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM dw, (SELECT DISTINCT n FROM bk))
), m AS (
  SELECT dk.doc_id, dk.i, dk.n, bk.item_id FROM dk JOIN bk ON dk.n = bk.n AND dk.k = bk.k
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
