"""Language identification by cross-parsing entropy: suffix automata of labelled text per language.

Of each language, a bounded sample of labelled text (of documents whose crc32(doc_id as text) mod 4 is not 2) goes into a
suffix automaton. A text is then parsed with each automaton into the longest phrases that occur in the sample: follow
transitions while there are any, then begin a phrase anew. The language that needs the fewest phrases per symbol wins.
As phrases get longer with the logarithm of a sample, counts are normalised by that of each language's own sample.

A text is *foreign* if the language that wins still needs as many phrases as for its own sample with the symbols shuffled,
one phrase aside: its letters then are in no order that a learned language knows. ``known_only`` rejects such texts.

The sample prefers texts of LONG_TEXT code points and more, but takes shorter ones where a language has too few; every
language gets its first document before any gets its second, up to SAMPLE_DOCS * MAX_LANGS documents. Of equal rows
(doc_id, text and lang) one is taken.

Texts are normalised to symbols: letters in lower case, by a table of the SYMBOLS - 2 commonest ones of each language's own sample,
its other letters as one symbol, letters that its sample lacks as none, and each run of anything else as one space. The automata are dense tables; thousands of
pieces of PIECE symbols step through them together, for all languages, so a step is a few numpy operations.
A phrase ends where a piece ends; that adds at most one phrase in PIECE symbols to every language alike.

Cases: null text and text without a letter are ``und`` with score 0; ties go to the language first by code point; with
no labelled text everything is ``und``; a null doc_id counts as not held out, and its rows are learned from; repeated rows get equal
answers; lang is read from learning rows only, and source and other columns never.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm._text import limits, slices, tidy
from lattica.llm.quality import held_out
from lattica.session import ship, table

#: The sample: documents a language, code points taken of each, symbols a language and of all languages (which bounds the
#: tables at about 100 MB); languages at most.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SYMBOLS, SAMPLE_ALL, MAX_LANGS = 48, 1500, 20_000, 400_000, 400
LONG_TEXT = 80
SYMBOLS, PIECE = 64, 512
SPACE, OTHER = 0, SYMBOLS - 1
_POINTS = 0x10000


def letter_table() -> np.ndarray:
    """Code point -> its lower-case code point for letters of the first plane, 0 for what is no letter; 1 for letters beyond."""
    out = np.zeros(_POINTS + 1, np.int32)
    for i in range(_POINTS):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[_POINTS] = 1
    return out


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice and the offsets of its texts in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]


class Symbols:
    """Letters as 1, 2, ... in the order of an alphabet; the symbol after the last is any other letter."""

    def __init__(self, alphabet: list[int]):
        self.alphabet = alphabet
        self.other = len(alphabet) + 1
        self.low = None

    def map(self, letters: list[int], seen: list[int], far: bool) -> np.ndarray:
        """Symbols -> those of a language: its letters as 1, 2, ..., its other letters as OTHER, and what its sample lacks as OTHER + 1 (OTHER if that is free)."""
        at = lambda x: np.searchsorted(self.alphabet, x) + 1
        out = np.full(self.other + 1, OTHER + 1 if far or len(seen) > len(letters) else OTHER, np.uint8)
        out[SPACE] = SPACE
        out[at(seen)] = OTHER
        out[at(letters)] = np.arange(1, len(letters) + 1)
        out[self.other] = OTHER if far else out[self.other]
        return out

    def of(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, the offsets of texts in them, and whether each text has a letter."""
        if self.low is None:
            low = letter_table()
            number = np.full(_POINTS + 1, self.other, np.int32)
            number[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self.low = np.where(low > 0, number[np.minimum(low, _POINTS)], SPACE).astype(np.int32)
        s = self.low[np.minimum(points, _POINTS)]
        far = np.flatnonzero(points >= _POINTS)
        if len(far):
            s[far] = [self.other if unicodedata.category(chr(p))[0] == "L" else SPACE for p in points[far]]
        has = np.diff(np.concatenate([[0], np.cumsum(s != SPACE)])[off]) > 0
        keep = np.ones(len(s), bool)
        if len(s):
            keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
            begin = off[:-1][off[:-1] < len(s)]
            keep[begin] = True
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[off], has


def suffix_automaton(text: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of a sequence of symbols; 0 is none, 1 the start."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.zeros((len(nexts), symbols), np.uint16 if len(nexts) < 1 << 16 else np.int32)
    for i, n in enumerate(nexts):
        for c, j in n.items():
            out[i, c] = j
    return out


class Parser:
    """The automata of some languages, and what each makes of the symbols."""

    def __init__(self, langs: list[str], symbols: Symbols, automata: list[np.ndarray], maps: list[np.ndarray] | None = None, sizes: list[int] | None = None, shuffled: list[float] | None = None):
        self.langs, self.symbols, self.automata = langs, symbols, automata
        self.maps = maps
        #: What makes counts of samples of different sizes comparable, and phrases per symbol of each sample with its symbols shuffled.
        logs = np.log(np.maximum(sizes or [2] * len(langs), 2))
        self.even = logs / logs.max() if len(langs) else np.zeros(0)
        self.shuffled = np.array(shuffled or [1.0] * len(langs))

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text of a slice: its language, the score, and whether it is foreign."""
        syms, soff, has = self.symbols.of(*code_points(data, off))
        if not self.langs:
            return ["und"] * len(has), np.zeros(len(has)), np.zeros(len(has), bool)
        n = np.maximum(np.diff(soff), 1)
        phrases = self.phrases(syms, soff)
        cost = phrases / n * self.even[:, None]
        best, least = cost.argmin(0), cost.min(0)
        rest = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else least + 1
        sure = np.where(least + rest > 0, rest / np.maximum(least + rest, 1e-12), 0.0)
        foreign = phrases[best, np.arange(len(n))] - 1 >= self.shuffled[best] * n
        return [self.langs[i] if ok else "und" for i, ok in zip(best, has)], np.where(has, np.clip(sure, 0, 1), 0.0), foreign & has

    def phrases(self, syms: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases that each text needs with each language's automaton, [language, text]."""
        n = np.diff(off)
        pieces = -(-n // PIECE)
        total = int(pieces.sum())
        doc = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = off[doc] + nth * PIECE
        size = np.minimum(PIECE, off[doc + 1] - begin) if total else np.zeros(0, np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size, doc = begin[order], size[order], doc[order]
        live = np.searchsorted(-size, -np.arange(PIECE), "left")  # pieces longer than k
        out = np.zeros((len(self.langs), len(n)))
        padded = np.append(syms, np.zeros(PIECE, syms.dtype))
        grid = np.ascontiguousarray(padded[begin[:, None] + np.arange(PIECE)].T).astype(np.int64) if total else np.zeros((PIECE, 0), np.int64)
        for i, t in enumerate(self.automata):
            # State 0 has no transitions: a piece begins there, and goes there on a symbol that the sample lacks.
            flat, root = t.ravel(), t[1].astype(np.int64)
            own = self.maps[i].astype(np.int64) if self.maps is not None else None
            lacks = own is not None and int(own.max()) > OTHER
            state, count = np.zeros(total, np.int64), np.zeros(total)
            for k in range(PIECE):
                m = live[k]
                if not m:
                    break
                c = grid[k, :m] if own is None else own[grid[k, :m]]
                if lacks:
                    gone = c > OTHER
                    c[gone] = OTHER
                to = flat[(state[:m] << 6) + c].astype(np.int64)
                if lacks:
                    to[gone] = 0
                stop = np.flatnonzero(to == 0)
                to[stop] = root[c[stop]]
                if lacks:
                    to[gone] = 0
                state[:m] = to
                count[stop] += 1
            out[i] = np.bincount(doc, count, minlength=len(n))
        return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Parser:
    """Fits the automata; the sample is bounded by the constants above."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", (F.length("text") < LONG_TEXT).alias("short"), F.xxhash64("doc_id", "text").alias("r"))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("short", "r"))
    few = known.select("lang", "short", "r").withColumn("k", rank).where(F.col("k") <= sample_docs).select("lang", "r", "k").distinct().orderBy("k", "lang", "r").limit(sample_docs * MAX_LANGS)
    taken = [r["r"] for r in few.select("r").collect()]  # at most sample_docs * MAX_LANGS
    rows = known.where(F.col("r").isin(taken)).groupBy("lang", "r").agg(F.first(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).collect() if taken else []
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    low = letter_table()
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    langs = sorted(texts)
    seen = []
    for lang in langs:
        p = low[np.minimum(points("\n".join(texts[lang])), _POINTS)]
        n = zip(*(x.tolist() for x in np.unique(p[p > 1], return_counts=True)))
        seen.append(([c for c, _ in sorted(n, key=lambda x: (-x[1], x[0]))], bool((p == 1).any())))
    symbols = Symbols(sorted({c for x, _ in seen for c in x}))
    maps = [symbols.map(sorted(x[: SYMBOLS - 2]), x, far) for x, far in seen]
    automata, sizes, shuffled = [], [], []
    for lang, own in zip(langs, maps):
        p = points("\n".join(texts[lang]))
        syms = symbols.of(p, np.array([0, len(p)]))[0][: min(SAMPLE_SYMBOLS, SAMPLE_ALL // len(langs))]
        automata.append(suffix_automaton(own[syms]))
        sizes.append(len(syms))
        mixed = np.random.default_rng(len(syms)).permutation(syms)
        shuffled.append(float(Parser([lang], symbols, automata[-1:], [own]).phrases(mixed, np.array([0, len(mixed)]))[0, 0]) / max(len(mixed), 1))
    symbols.low = None
    return Parser(langs, symbols, automata, maps, sizes, shuffled)


def _predict(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    parser = sent.value
    for batch in batches:
        lang, score = [], []
        for a, b, data, off in slices(batch.column("text")):
            one, sure, _ = parser.judge(data, off)
            lang += one
            score += sure.tolist()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, held_out, lang_pred and score (second-best phrases over best plus second-best) of every row."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    sent = spark.sparkContext.broadcast(parser)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(lambda it: _predict(it, sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _known(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for _, _, data, off in slices(batch.column("text")):
            lang, _, foreign = sent.value.judge(data, off)
            keep += [x != "und" and not f for x, f in zip(lang, foreign.tolist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def known_only(docs: DataFrame, parser: Parser) -> DataFrame:
    """The rows of docs, all columns, in a learned language: neither ``und`` nor foreign."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    sent = spark.sparkContext.broadcast(parser)
    return docs.mapInArrow(lambda it: tidy(_known(it, sent)), docs.schema)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from lang of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
