"""Exact dedup by composable polynomial fingerprints, confirmed by chunkwise comparison.

A text without white space ``[\\x20\\x09-\\x0D]`` is cut into pieces of PIECE bytes. All pieces of a slice of
documents are hashed in one matrix product (byte + 1 times powers of BASE, modulo two primes, exact in float64),
and the piece hashes of a document are combined by length-shifted arithmetic, H(ab) = H(a) * BASE^|b| + H(b).
Texts longer than CHUNK code points come to the kernel as several rows and are combined the same way, so a worker
never holds more than a chunk of them. Documents of equal fingerprint and length form a group; its rows are
compared with the group's stayer chunk by chunk in a join that can be split under skew. Should a comparison fail,
the groups with that fingerprint are formed anew from the texts themselves; so the result is exact.

Cases: null is the empty text, equal to texts of white space alone; of equal texts the row with the most code points
of the original text stays, then the smallest doc_id (null last); rows that repeat a doc_id get a row each, and all
rows of the doc_id that stays are marked kept; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._text import limits, slices
from lattica.session import ensure_checkpoint_dir, ship, table

PIECE = 1024
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1000033)
#: Code points that a row gives the kernel at most, and that a comparison holds at once.
CHUNK = 1 << 20
COMPARE = 1 << 15
#: Parts that the rows of a group are dealt to where they meet their stayer; adaptive execution splits what is still too large.
SALTS = 8
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
WS = " \t\n\x0b\x0c\r"


def combine(left: int, right: int, right_bytes: int, base: int, prime: int) -> int:
    """The fingerprint of a text from those of its halves."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def _weights(primes: tuple[int, ...]) -> np.ndarray:
    return np.array([[pow(b, PIECE - 1 - j, p) for b, p in zip(BASES, primes)] for j in range(PIECE)], np.float64)


def fingerprint_slice(data: np.ndarray, off: np.ndarray, weights: np.ndarray, primes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stripped bytes, their offsets, stripped lengths, fingerprints [document, prime]) of a slice."""
    keep = ~_IS_WS[data]
    noff = np.concatenate([[0], np.cumsum(keep)])[off]
    text, size = data[keep], np.diff(noff)
    n = len(size)
    pieces = -(-size // PIECE)
    first = np.concatenate([[0], np.cumsum(pieces)])
    grid = np.zeros(first[-1] * PIECE, np.float64)  # each text is right-aligned in its pieces: zeros in front change nothing
    at = np.repeat(first[1:] * PIECE - noff[1:], size) + np.arange(len(text))
    grid[at] = text + 1.0
    part = (grid.reshape(-1, PIECE) @ weights).astype(np.int64)
    out = np.zeros((n, len(primes)), np.int64)
    for j, (b, p) in enumerate(zip(BASES, primes)):
        h, shift = part[:, j] % p, pow(b, PIECE, p)
        for k in range(int(pieces.max(initial=0))):
            on = np.flatnonzero(pieces > k)
            out[on, j] = (out[on, j] * shift + h[first[on] + k]) % p
    return text, noff, size, out


def _fingerprints(batches: Iterable[pa.RecordBatch], primes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    weights = _weights(primes)
    open_sha = open_state = None
    for batch in batches:
        ids, last, out = batch.column("d"), batch.column("last").to_pylist(), []
        text_hash, n_chars = batch.column("t"), batch.column("n_chars")
        rows = []
        for a, b, data, off in slices(batch.column("chunk")):
            text, noff, size, fp = fingerprint_slice(data, off, weights, primes)
            raw = text.tobytes()
            for i in range(b - a):
                piece = raw[noff[i] : noff[i + 1]]
                if open_sha is None and last[a + i]:
                    rows.append(a + i)
                    out.append((int(size[i]), int(fp[i, 0]) * primes[1] + int(fp[i, 1]), hashlib.sha256(piece).hexdigest()))
                    continue
                if open_sha is None:
                    open_sha, open_state = hashlib.sha256(), (0, [0] * len(primes))
                open_sha.update(piece)
                open_state = (open_state[0] + int(size[i]), [combine(h, int(fp[i, j]), int(size[i]), BASES[j], p) for j, (h, p) in enumerate(zip(open_state[1], primes))])
                if last[a + i]:
                    rows.append(a + i)
                    out.append((open_state[0], open_state[1][0] * primes[1] + open_state[1][1], open_sha.hexdigest()))
                    open_sha = None
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(take), text_hash.take(take), n_chars.take(take), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
            names=["d", "t", "n_chars", "n_bytes", "fp", "sha"],
        )


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """d, t, n_chars, n_bytes (of the stripped text), fp and sha (SHA-256 of the stripped text) of every row."""
    spark = docs.sparkSession
    ship(spark)
    limits(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), text.alias("x"), F.char_length(text).cast("long").alias("n_chars"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / chunk)).cast("int")
    cut = rows.withColumn("parts", parts).select("d", "t", "n_chars", "x", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    piece = F.when(F.col("parts") == 1, F.col("x")).otherwise(F.expr(f"substring(x, i * {chunk} + 1, {chunk})"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.select("d", "t", "n_chars", piece.alias("chunk"), (F.col("i") == F.col("parts") - 1).alias("last")).mapInArrow(
        lambda it: _fingerprints(it, primes), f"d {kind}, t long, n_chars long, n_bytes long, fp long, sha string"
    )


def _best() -> F.Column:
    return F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("d").isNull().alias("b"), F.col("d").alias("d"), F.col("t").alias("t")))


def _stripped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The stripped texts of some rows (d, t and more)."""
    text = docs.select(F.col("doc_id").alias("d_"), F.xxhash64("text").alias("t_"), F.coalesce("text", F.lit("")).alias("x"))
    return rows.join(text, F.col("d").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_"))).drop("d_", "t_").withColumn("x", F.translate("x", WS, ""))


def exact_dedup(docs: DataFrame, primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    marks = fingerprints(docs, primes, chunk).checkpoint()
    groups = marks.groupBy("fp", "n_bytes").agg(F.count("*").alias("n"), _best().alias("best")).where("n > 1").checkpoint()
    named = groups.select(F.col("fp").alias("g"), F.col("n_bytes").alias("gb"), "n", F.col("best.d").alias("keep"), F.col("best.t").alias("keep_t"))
    salted = marks.withColumn("salt", F.pmod(F.hash("d", "t"), F.lit(SALTS)))
    named = named.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    verdict = salted.join(named, (F.col("fp") == F.col("g")) & (F.col("n_bytes") == F.col("gb")) & (F.col("salt") == F.col("salt2")), "left").drop("salt", "salt2")
    # Chunkwise comparison of each member with its group's stayer; repeats of one doc_id and text are compared once.
    stay = F.col("d").eqNullSafe(F.col("keep")) & (F.col("t") == F.col("keep_t"))
    pieces = F.expr(f"transform(sequence(0, cast(greatest(char_length(x) - 1, 0) div {COMPARE} as int)), i -> struct(i as i, substring(x, i * {COMPARE} + 1, {COMPARE}) as c))")
    copies = verdict.where("n > 1").select("d", "t", "g", "gb", stay.alias("stay")).distinct()
    texts = _stripped(docs, copies).select("d", "t", "g", "gb", "stay", F.inline(pieces).alias("i", "c"))
    stayers = texts.where("stay").select(F.col("g").alias("g2"), F.col("gb").alias("gb2"), F.col("i").alias("i2"), F.col("c").alias("c2")).distinct()
    same = texts.where("not stay").join(stayers, (F.col("g") == F.col("g2")) & (F.col("gb") == F.col("gb2")) & (F.col("i") == F.col("i2")), "left")
    differ = same.where(~F.col("c").eqNullSafe(F.col("c2"))).select("g", "gb").distinct().checkpoint()
    out = lambda rows: rows.select(F.col("d").alias("doc_id"), F.when(F.col("n").isNull(), F.col("d")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("n").isNull() | F.col("d").eqNullSafe(F.col("keep"))).alias("kept"), F.col("sha").alias("text_sha256"))
    if differ.isEmpty():
        return out(verdict)
    # Different texts share a fingerprint: their groups are formed from the texts themselves.
    clash = differ.select(F.col("g").alias("cg"), F.col("gb").alias("cb"))
    on = (F.col("fp") == F.col("cg")) & (F.col("n_bytes") == F.col("cb"))
    fine = verdict.join(clash, on, "left_anti")
    again = _stripped(docs.dropDuplicates(["doc_id", "text"]), marks.join(clash, on, "left_semi"))
    exact = again.groupBy(F.col("x").alias("x2")).agg(F.count("*").alias("n"), _best().alias("best"))
    redone = again.join(exact.select("x2", "n", F.col("best.d").alias("keep")), F.col("x") == F.col("x2"))
    return out(fine).unionByName(out(redone))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space, one row a document."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS s FROM documents
), w AS (
  SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM w
"""
