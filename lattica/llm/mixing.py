"""Mixing sources to target weights: subset-sum budget fitting over counts of exact lengths.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. The sources share the budget by weight; a target stops
at MOST times its source's size and the excess goes to the others by weight. A source whose target is more than its
size takes every document as often as fits whole; for the rest it fits a subset of its documents:

1. documents are counted by exact size (map-side combined, one row a source and size);
2. each size gives its proportional share, rounded down; sizes then fill the remaining budget from the largest, and
   a bounded-knapsack bitset over what still remains finds the sum nearest below the budget, and how many
   more documents of each size reach it. If that misses the budget, shares are given back, as many as the bitset covers,
   and fitted again: a budget of DP_WORDS words or less gets the best sum there is;
3. of each size, the first documents by a seeded hash are taken.

Ranks by hash are made in BUCKETS hash buckets a size: a row number within a bucket plus the documents in the buckets
before it, so no group of equal sizes is sorted in one task. A source's plan reads one row a distinct size, of which
there are at most the square root of twice its words.

Cases: null text has size 0; documents of size 0 are never taken; null is a source of its own, the last; repeated
rows are documents of their own; of rows equal in doc_id and size it isn't told which is taken; no
words at all makes all targets 0; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm._text import unused
from lattica.session import ensure_checkpoint_dir, ship, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BUCKETS = 1024
#: Words of budget that the bitset covers; sizes fill what is above it.
DP_WORDS = 1 << 16
SEED = 17


def word_count(text: F.Column) -> F.Column:
    """The number of runs of characters other than [\\x20\\x09-\\x0D]."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> list[float]:
    """Targets of (source, size) in the order given, which must be by code point with null last."""
    left, budget = {}, share * sum(n for _, n in sizes)
    out = [0.0] * len(sizes)
    left = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while left:
        total = sum(left.values())
        over = [i for i in left if budget * left[i] / total > most * sizes[i][1]]
        if not over:
            for i, w in left.items():
                out[i] = budget * w / total
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
            del left[i]
        budget -= sum(out[i] for i in over)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as near below the budget as the bitset finds; the best sum for budgets up to dp_words."""
    total = int((lengths * counts).sum())
    if total <= budget:
        return counts.copy()
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    take = np.where(lengths > 0, counts * budget // total, 0) if total < 2**31 else np.array([int(c) * budget // total if n else 0 for n, c in zip(lengths, counts)], np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= dp_words:
            break
        if lengths[i] > 0:
            k = min(int(counts[i] - take[i]), (left - dp_words + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            take[i] += max(k, 0)
            left -= max(k, 0) * int(lengths[i])
    more, missing = knapsack(lengths, counts - take, left, order)
    if missing and take.any():  # a share is given back, all of it where the bitset covers the budget, and fitted again
        used, room = int((lengths * take).sum()), dp_words - left
        back = take if used <= room else np.array([int(t) * max(room, 0) // used for t in take], np.int64)
        if back.any():
            take, left = take - back, left + int((lengths * back).sum())
            more, _ = knapsack(lengths, counts - take, left, order)
    return take + more


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents of each length reach the largest sum within the budget, and what that sum lacks of it.

    Bit s of a bitset says that sum s can be had; counts are split in powers of two.
    """
    take = np.zeros(len(lengths), np.int64)
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for i in order:
        n, spare = int(lengths[i]), int(counts[i])
        if n <= 0 or n > budget or spare <= 0:
            continue
        spare, part = min(spare, budget // n), 1
        while spare > 0:
            k = min(part, spare)
            steps.append((i, k, reach))
            reach = (reach | (reach << (k * n))) & mask
            spare -= k
            part *= 2
        if reach >> budget & 1:
            break
    s = reach.bit_length() - 1
    missing = budget - s
    for i, k, before in reversed(steps):
        if not before >> s & 1:
            take[i] += k
            s -= k * int(lengths[i])
    return take, missing


def _plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    n, c, target = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0])
    whole = int((n * c).sum())
    times = int(target // whole) if whole else 0
    more = fit(n, c, int(round(target)) - times * whole)
    return pd.DataFrame({"source_id": pdf["source_id"], "size": n, "times": times, "more": more})


def _shares(weights: tuple[float, ...], share: float, most: float) -> Callable:
    def run(parts):
        pdf = pd.concat(list(parts), ignore_index=True)
        rows = sorted(((None if pd.isna(s) else s, int(i), int(n)) for s, i, n in zip(pdf["source"], pdf["source_id"], pdf["source_size"])), key=lambda x: (x[0] is None, x[0] or ""))
        got = targets([(s, n) for s, _, n in rows], weights, share, most)
        yield pd.DataFrame({"source_id": [i for _, i, _ in rows], "source_size": [n for _, _, n in rows], "target": got})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and times (how often the mix takes the document) of every row."""
    spark = docs.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    source_id = F.when(F.col("source").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("source"))
    rows = docs.select("doc_id", "source", source_id.alias("source_id"), word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("r")).checkpoint()
    bucket = F.pmod(F.shiftrightunsigned("r", 20), F.lit(BUCKETS)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    by_bucket = rows.groupBy("source_id", "size", "bucket").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    by_size = by_bucket.groupBy("source_id", "size").agg(F.sum("n").alias("n"), F.first("source").alias("source"))
    by_source = by_size.groupBy("source_id").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.first("source").alias("source"))
    shares = by_source.coalesce(1).mapInPandas(_shares(weights, share, most), "source_id long, source_size long, target double")
    plan = by_size.join(shares, "source_id").groupBy("source_id").applyInPandas(_plan, "source_id long, size long, times long, more long")
    before = F.sum("n").over(Window.partitionBy("source_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_bucket.select("source_id", "size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    cells = starts.join(plan, ["source_id", "size"]).join(shares, "source_id").select("source_id", "size", "bucket", "before", "times", "more", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source_id", "size", "bucket").orderBy("r", "doc_id"))
    return rows.withColumn("k", rank).join(cells, ["source_id", "size", "bucket"]).select(
        "doc_id", "size", "source_size", "target", (F.col("times") + (F.col("before") + F.col("k") <= F.col("more")).cast("long")).alias("times")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    key_, size_, id_, picks_, nth_, times_, copy_ = unused(docs, "key", "size", "id", "picks", "nth", "times", "copy")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.xxhash64("text").cast("string")))
    keyed = docs.withColumn(key_, key).withColumn(size_, word_count(F.col("text")))
    picks = mix(keyed.select(F.col(key_).alias("doc_id"), "text", "source"), **options).where("times > 0")
    # Rows of one key (repeats) are matched by place in order of size.
    lists = picks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("size", "times"))).alias(picks_)).withColumnRenamed("doc_id", id_)
    nth = F.row_number().over(Window.partitionBy(key_, size_).orderBy(F.xxhash64("text")))
    joined = keyed.withColumn(nth_, nth).join(lists, F.col(key_) == F.col(id_))
    own = F.expr(f"get(filter({picks_}, x -> x.size = {size_}), {nth_} - 1).times")
    joined = joined.withColumn(times_, F.coalesce(own, F.lit(0)).cast("int")).where(F.col(times_) > 0)
    return joined.withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1, repeating, over the sources in order."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
