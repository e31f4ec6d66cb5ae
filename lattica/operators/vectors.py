"""Exact vector search: blocked matrix products with a partial top-k in each batch, parity and overlap of indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.ids import seeded
from lattica.session import ship

#: Queries of a block, bytes of blocks that are broadcast for one scan, and scores that a step holds.
QUERY_BLOCK, SENT_BYTES, CELLS = 4096, 64 << 20, 1 << 22


def check_dim(vec: Column, dim: int) -> Column:
    """The vector, or an error where it is null, its size differs or a value is NaN or infinite."""
    bad = vec.isNull() | (F.size(vec) != dim) | F.exists(vec, lambda x: x.isNull()) | F.exists(vec, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit(f"a vector isn't {dim} finite numbers"))).otherwise(vec)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's candidates the first k by score to nine places, then by id."""
    order = np.lexsort((ids, -np.round(score, 9), q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.flatnonzero(np.diff(q, prepend=-1))
    nth = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
    return q[nth < k], ids[nth < k], score[nth < k]


def _best(batches: Iterable[pa.RecordBatch], sent, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """The k best of a partition for each query of some blocks; a step scores CELLS pairs at most."""
    blocks = sent.value
    held: list = [None] * len(blocks)
    for batch in batches:
        column, own = batch.column("vec"), np.array(batch.column("id").to_pylist())
        if not batch.num_rows:
            continue
        rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        norm = np.linalg.norm(rows, axis=1)
        rows = rows / np.where(norm > 0, norm, 1)[:, None]
        for b, (ids, matrix) in enumerate(blocks):
            width = max(k, CELLS // len(ids))
            for at in range(0, len(rows), width):
                part, names = rows[at : at + width], own[at : at + width]
                score = matrix @ part.T
                if skip_self:
                    score[ids[:, None] == names[None, :]] = -np.inf
                keep = min(k, len(part))
                cut = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                q, c = np.nonzero((score >= cut[:, None] - 1e-9) & np.isfinite(score))
                found = (q, names[c], score[q, c])
                if held[b] is not None:
                    found = tuple(np.concatenate(x) for x in zip(held[b], found))
                held[b] = _first_k(*found, k)
    for (ids, _), found in zip(blocks, held):
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], names=["q", "id", "score"])


def top_k(queries: DataFrame, base: DataFrame, k: int = 10, skip_self: bool = False) -> DataFrame:
    """(q, id, score, rank): the k nearest of base (id, vec) by cosine for each query (id, vec); ties by id.

    Queries go out in blocks of QUERY_BLOCK rows, as many blocks a scan of base as hold SENT_BYTES. A partition scores its
    rows block by block and returns k rows a query. Rows without a vector are near to nothing, queries without one have no row.
    """
    spark = base.sparkSession
    ship(spark)
    kind = base.schema["id"].dataType.simpleString()
    parts: list[DataFrame] = []
    blocks: list = []
    block: list = []

    def close() -> None:
        m = np.array([r["vec"] for r in block], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        blocks.append((np.array([r["id"] for r in block]), m))
        block.clear()

    def send() -> None:
        sent = spark.sparkContext.broadcast(list(blocks))
        parts.append(base.where("vec is not null").select("id", "vec").mapInArrow(_of(sent, k, skip_self), f"q {kind}, id {kind}, score double"))
        blocks.clear()

    for row in queries.where("vec is not null").select("id", "vec").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            close()
            if sum(m.nbytes for _, m in blocks) >= SENT_BYTES:
                send()
    if block:
        close()
    if blocks:
        send()
    if not parts:
        return spark.createDataFrame([], f"q {kind}, id {kind}, score double, rank long")
    best = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    rows = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best).cast("long"))
    return rows.where(F.col("rank") <= k)


def _of(sent, k: int, skip_self: bool) -> Callable:
    return lambda it: _best(it, sent, k, skip_self)


def _embed(batches: Iterable[pa.RecordBatch], load: Callable, dim: int) -> Iterator[pa.RecordBatch]:
    model = load()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        vec = np.asarray(model(texts), np.float32) if texts else np.zeros((0, dim), np.float32)
        if vec.shape != (len(texts), dim) or not np.isfinite(vec).all():
            raise ValueError(f"the model gave {vec.shape}, not {len(texts)} finite vectors of {dim}")
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(vec.ravel()), dim).cast(pa.list_(pa.float32()))], names=["id", "vec"])


def embed(texts: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> DataFrame:
    """(id, vec) of texts (id, text) by any model: ``load`` runs once a task and gives a function from texts to rows of ``dim`` numbers.

    A null text goes to the model as an empty one; anything but finite vectors of that size fails the job.
    """
    ship(texts.sparkSession)
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(lambda it: _embed(it, load, dim), f"id {kind}, vec array<float>")


def hashed_words(dim: int = 16) -> Callable[[], Callable]:
    """A model that needs no weights: counts of a text's words in lower case by MD5, modulo ``dim`` (16 at most)."""

    def load() -> Callable:
        import hashlib

        def model(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split(" "):
                    out[i, int(hashlib.md5(word.encode("utf-8", "replace")).hexdigest()[0], 16) % dim] += word != ""
            return out

        return model

    return load


def collection(spark, path: str, dim: int, recreate: bool = False) -> bool:
    """A Parquet collection of vectors (id, vec) at path; made empty if it isn't there or ``recreate``. True if it was made.

    An existing one of another dimension raises ValueError, so that nothing is written to it.
    """
    schema = "id string, vec array<float>"
    try:
        rows = spark.read.parquet(path)
        there = True
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = False
    if there and not recreate:
        first = rows.select(F.size("vec").alias("n")).first()
        if first is not None and first["n"] != dim:
            raise ValueError(f"{path} holds vectors of {first['n']}, not {dim}")
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return True


def sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points in the order of a seeded hash of their id."""
    return points.orderBy(seeded(seed, F.col("id").cast("string")), "id").limit(n)


def parity(a: DataFrame, b: DataFrame, least: float = 0.98) -> DataFrame:
    """Mean and least cosine of vectors of one id in two indexes, ids that miss in the other, and whether all is well."""
    both = a.select("id", F.col("vec").alias("va")).join(b.select("id", F.col("vec").alias("vb")), "id", "full")
    paired = F.col("va").isNotNull() & F.col("vb").isNotNull()
    c = F.when(paired, cosine(F.col("va"), F.col("vb")))
    out = both.agg(F.count(c).alias("n"), F.avg(c).alias("mean_cosine"), F.min(c).alias("min_cosine"), F.count_if(~paired).alias("missing"))
    return out.withColumn("ok", (F.col("min_cosine") >= least) & (F.col("missing") == 0))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(q, n): ids that two results of top_k share."""
    lists = lambda x, name: x.groupBy("q").agg(F.collect_set("id").alias(name))
    return lists(a, "x").join(lists(b, "y"), "q").select("q", F.size(F.array_intersect("x", "y")).cast("long").alias("n"))


def upsert(old: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Rows of old and new, of each id the one of the latest version."""
    w = Window.partitionBy("id").orderBy(F.col(version).desc())
    return old.unionByName(new).withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
