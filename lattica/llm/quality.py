"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the pairwise interactions of
all features thus cost time linear in the features of a text. Features: words hashed to WORD_DIMS slots, weighted by
frequency and length-normalised; STATS statistics of the text's structure, each in one of BINS bins; the bin of
the document's n_chars as metadata, where that column exists. The label, lang, source and doc_id are no features.

The machine is fitted on the driver by minibatch Adagrad on SAMPLE labelled rows at most, of FEATURES features at most (those first by a hash of
doc_id; rows that repeat a doc_id count once), of documents whose crc32(doc_id as text) mod 4 is not 2. Texts are scored whole, batch by batch.

Cases: null or empty text has its statistics and no words, and gets a score; without labelled rows every score is 0.5;
several labels of one document are averaged; an n_chars that is no number counts as 0; a null doc_id isn't held out; repeated rows get equal scores; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm._text import CODE, U, limits, slices, splitmix, words
from lattica.session import ship, table

WORD_DIMS, BINS, RANK = 1 << 15, 16, 8
#: Labelled rows at most, and their features together; minibatch steps at least, and passes over the sample at least.
SAMPLE, FEATURES, STEPS, EPOCHS, BATCH, RATE, DECAY, SEED = 4000, 8_000_000, 1000, 8, 64, 0.1, 1e-4, 11
_LOGS = np.arange(1, BINS) * 1.25
_RATIOS = np.array([0.001, 0.003, 0.006, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.22, 0.3, 0.4, 0.55, 0.7, 0.85])
_SIZES = np.arange(1, BINS) * 0.75 + 1.5
EDGES = [_LOGS, _LOGS, _LOGS, _LOGS, _SIZES, *[_RATIOS] * 8, _LOGS]
STATS = len(EDGES)
DIMS = WORD_DIMS + STATS * BINS
_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[:] = (CODE > 0) & ~_DIGIT
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[33:127] = True
_SYMBOL &= (CODE == 0)
_SYMBOL[[44, 46]] = False


def _per_doc(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flag)])[off]).astype(np.float64)


def featurise(data: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of a slice, by document; every document has its STATS statistics."""
    n = len(off) - 1
    starts, ends, h, first = words(data, off)
    count = np.diff(first).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    key, times = np.unique((doc.astype(U) << U(40)) | (h >> U(24)), return_counts=True)  # 40 bits tell words of one text apart
    wdoc = (key >> U(40)).astype(np.int64)
    distinct = np.bincount(wdoc, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, wdoc, times)
    slot = (splitmix(key & U((1 << 40) - 1)) % U(WORD_DIMS)).astype(np.int64)
    norm = np.sqrt(np.bincount(wdoc, times.astype(np.float64) ** 2, minlength=n))
    value = times / norm[wdoc]
    size = np.diff(off).astype(np.float64)
    one = lambda x: np.maximum(x, 1.0)
    letters, lines = _per_doc(_LETTER[data], off), _per_doc(data == 10, off) + 1
    stats = [
        np.log2(size + 1), np.log2(count + 1), np.log2(lines), np.log2(size / lines + 1), (ends - starts).sum() and np.bincount(doc, ends - starts, minlength=n) / one(count) if n else count,
        1 - distinct / one(count), top / one(count), _per_doc(_UPPER[data], off) / one(letters), _per_doc(_SYMBOL[data], off) / one(size),
        _per_doc(_DIGIT[data], off) / one(size), _per_doc(_SPACE[data], off) / one(size), _per_doc(data >= 128, off) / one(size), _per_doc(data == 46, off) / one(count), np.log2(np.maximum(n_chars, 0) + 1),
    ]
    bins = np.stack([np.searchsorted(e, np.broadcast_to(s, n), "right") + BINS * j for j, (e, s) in enumerate(zip(EDGES, stats))], 1) + WORD_DIMS
    d = np.concatenate([wdoc, np.repeat(np.arange(n), STATS)])
    order = np.argsort(d, kind="stable")
    return d[order], np.concatenate([slot, bins.ravel()])[order], np.concatenate([value, np.full(n * STATS, STATS**-0.5)])[order]


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, doc: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums of v x, by the sum-of-squares identity; ``doc`` runs from 0 without gaps."""
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        vx = self.v[at] * x[:, None].astype(np.float32)
        s = np.add.reduceat(vx, cut, axis=0)
        pairs = 0.5 * (s**2 - np.add.reduceat(vx**2, cut, axis=0)).sum(1)
        return self.w0 + np.add.reduceat(self.w[at] * x, cut) + pairs, s


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, seed: int = SEED) -> Machine:
    """A machine from (features, values) and labels."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(DIMS), rng.normal(0, 0.01, (DIMS, RANK)).astype(np.float32))
    if not len(y):
        return m
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    m.w0 = float(np.log(mean / (1 - mean)))
    gw, gv = np.full(DIMS, 1e-2), np.full((DIMS, RANK), 1e-2, np.float32)
    for _ in range(max(epochs, -(-steps // max(1, len(y) // BATCH)))):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            n = np.array([len(rows[i][0]) for i in part])
            doc, at, x = np.repeat(np.arange(len(part)), n), np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            raw, s = m.raw(doc, at, x)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            g = err[doc] * x
            used, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, g) + DECAY * m.w[used]
            each = (g[:, None] * (s[doc] - m.v[at] * x[:, None])).astype(np.float32)
            dv = DECAY * m.v[used]
            np.add.at(dv, where, each)
            gw[used] += dw**2
            gv[used] += dv**2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.w0 -= RATE * float(err.sum())
    return m


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        meta, at, x = _numbers(batch.column("n_chars")), [], []
        for a, b, data, off in slices(batch.column("text")):
            doc, f, v = featurise(data, off, meta[a:b])
            cut = np.searchsorted(doc, np.arange(1, b - a))
            at += np.split(f.astype(np.int32), cut)
            x += np.split(v.astype(np.float32), cut)
        yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["r", "y", "at", "x"])


def _scores(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        meta, out = _numbers(batch.column("n_chars")), [np.zeros(0)]
        for a, b, data, off in slices(batch.column("text")):
            raw, _ = m.raw(*featurise(data, off, meta[a:b]))
            out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(out), pa.float64())], names=["doc_id", "held_out", "score"])


def held_out(doc_id: F.Column) -> F.Column:
    """crc32(doc_id as text) mod 4 is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    meta = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(0.0)
    return docs.select("doc_id", "text", meta.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fits on the first ``sample`` labelled documents by hash that aren't held out."""
    ship(docs.sparkSession)
    limits(docs.sparkSession)
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.avg(label).alias("y"))
    few = named.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` rows are broadcast
    rows = _inputs(docs).join(F.broadcast(few), F.col("doc_id") == F.col("id")).select(F.xxhash64("id").alias("r"), "y", "text", "n_chars").mapInArrow(_features, "r long, y double, at array<int>, x array<float>")
    each = rows.groupBy("r").agg(F.min(F.struct(F.size("at").alias("n"), F.xxhash64("at").alias("h"), "y", "at", "x")).alias("one"))  # rows that repeat a doc_id count once
    total = F.sum("one.n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    got = each.withColumn("total", total).where((F.col("total") <= FEATURES) | (F.col("total") == F.col("one.n"))).select("one.y", "one.at", "one.x").toArrow()
    at, x = (got.column(k).combine_chunks() if got.num_rows else None for k in ("at", "x"))
    y = got.column("y").to_numpy() if got.num_rows else np.zeros(0)
    pairs = [(at[i].values.to_numpy().astype(np.int64), x[i].values.to_numpy().astype(np.float64)) for i in range(len(y))]
    order = np.lexsort(([p[0][: 1].sum() for p in pairs], [len(p[0]) for p in pairs], y)) if pairs else []
    return fit([pairs[i] for i in order], y[order] if len(y) else y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    sent = spark.sparkContext.broadcast(machine)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _inputs(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(lambda it: _scores(it, sent), f"doc_id {kind}, held_out boolean, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learnt from labels.quality of documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
