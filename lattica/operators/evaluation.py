"""Evaluation: policies against golden sets, reports by source, telemetry rollups, latency and figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.ids import seeded
from lattica.functions.ranking import f1_set, hash_bound, hashed_gains, ndcg_of, ndcg_two_tier, recall_at_k
from lattica.operators.splits import PART, indexed, ordered
from lattica.session import ensure_checkpoint_dir


def score_questions(golden: DataFrame, predictions: DataFrame, k: int = 50) -> DataFrame:
    """id, source, n_predicted, ndcg, recall and f1 of golden (id, source, answers, bridges) and predictions (id, predicted)."""
    none = F.array().cast("array<string>")
    return score_rows(golden.join(predictions, "id", "left").withColumn("predicted", F.coalesce("predicted", none)), k)


def score_rows(rows: DataFrame, k: int = 50) -> DataFrame:
    """The same of rows that hold both (id, source, answers, bridges, predicted): no set is shuffled."""
    p, a, b = F.col("predicted"), F.col("answers"), F.col("bridges")
    return rows.select("id", "source", F.size(p).cast("long").alias("n_predicted"), ndcg_two_tier(p, a, b, k).alias("ndcg"), recall_at_k(p, a, k).alias("recall"), f1_set(p, a).alias("f1"))


def score_gains(rows: DataFrame, k: int = 50) -> DataFrame:
    """The same of rows (id, source, gains of the first k, n_predicted, n_hits, n_answers, n_bridges), sets apart from each other."""
    n, hits = F.col("n_answers"), F.col("n_hits")
    recall = F.when(n > 0, F.size(F.filter("gains", lambda g: g == 2.0)) / n).otherwise(0.0)
    f1 = F.when(hits > 0, 2.0 * hits / (F.col("n_predicted") + n)).otherwise(0.0)
    return rows.select("id", "source", F.col("n_predicted").cast("long").alias("n_predicted"), ndcg_of(F.col("gains"), n, F.col("n_bridges"), k).alias("ndcg"), recall.alias("recall"), f1.alias("f1"))


def gains_at_hubs(rows: DataFrame, held: DataFrame, k: int = 50) -> DataFrame:
    """``gains`` (see ``hashed_gains``) of rows whose sets are a hub's all_ and by_ (held, by hub_ and part_), without their own few.

    Rows have hub_, part_, anchor_, id, less_answers, less_bridges, more_bridges, junk, n_answers and n_bridges; other columns stay. Ids
    are hashed in the condition of a join, which is generated code, and only those below the bound leave it; they are gathered
    where they are, as the join's keys are a part of the group's. A member without an id brings a row's own columns. Rows
    with fewer than k ids below their bound take the hub's arrays.
    """
    keys, a, b = ["hub_", "part_"], F.col("all_"), F.col("by_")
    member = lambda ids, answer, bridge: F.transform(ids, lambda q: F.struct(q.alias("q"), F.lit(answer).alias("answer"), F.lit(bridge).alias("bridge")))
    none = F.array(F.lit(None).cast("string"))
    members = F.concat(member(none, False, False), member(F.array_except(a, b), True, False), member(F.array_intersect(a, b), True, True), member(F.array_except(b, a), False, True))
    members = held.select(*keys, F.explode(members).alias("m")).select(*keys, "m.q", "m.answer", "m.bridge")
    q, columns = F.col("q"), [c for c in rows.columns if c not in (*keys, "anchor_")]
    rows = rows.withColumns({"key_": F.concat("id", F.lit("|")), "bound_": hash_bound(F.col("n_answers") + F.col("n_bridges") + F.size("junk"), k)})
    hashed = F.sha2(F.concat("key_", q), 256)
    gain = F.when(F.col("answer") & ~F.array_contains("less_answers", q), 2.0).when(F.col("bridge") & ~F.array_contains("less_bridges", q), 1.0)
    met = rows.join(members, keys).where(q.isNull() | F.col("bound_").isNull() | (hashed < F.col("bound_")))
    met = met.select(*keys, "anchor_", F.when(q.isNull(), F.struct(*columns, "bound_")).alias("own"), F.when(gain.isNotNull(), F.struct(F.unhex(hashed).alias("hash"), gain.alias("gain"))).alias("place"))
    met = met.groupBy(*keys, "anchor_").agg(F.first("own", ignorenulls=True).alias("own"), F.collect_list("place").alias("places")).select(*keys, "own.*", "places")
    placed = lambda ids, g: F.transform(ids, lambda q: F.struct(F.unhex(F.sha2(F.concat("id", F.lit("|"), q), 256)).alias("hash"), F.lit(g).alias("gain")))
    first = F.slice(F.sort_array(F.concat("places", placed("more_bridges", 1.0), placed("junk", 0.0))), 1, k)
    short = F.col("bound_").isNotNull() & (F.size("places") < k)
    met = met.select(*keys, *columns, F.transform(first, lambda x: x["gain"]).alias("gains"), short.alias("short_"))
    whole = [(a, F.col("less_answers"), 2.0), (F.array_except(b, F.array_except(a, F.col("less_answers"))), F.col("less_bridges"), 1.0), (F.col("more_bridges"), None, 1.0), (F.col("junk"), None, 0.0)]
    held = held.select(*(F.col(c).alias(f"{c}2") for c in keys), "all_", "by_")
    got = met.join(held, F.col("short_") & (F.col("hub_") == F.col("hub_2")) & (F.col("part_") == F.col("part_2")), "left")
    return got.select(*columns, F.when(F.col("short_"), hashed_gains(F.col("id"), whole, k)).otherwise(F.col("gains")).alias("gains"))


def report(scored: DataFrame) -> DataFrame:
    """Means overall (source 'all') and by source, in one pass of grouping sets."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("ndcg", "recall", "f1")]
    sets = scored.groupingSets([[], ["source"]], "source").agg(F.grouping("source").alias("g"), F.count("*").alias("n"), *means)
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col("source")).alias("source"), "n", "mean_ndcg", "mean_recall", "mean_f1")


def golden_pool(golden: DataFrame) -> DataFrame:
    """Distinct ids of all golden sets."""
    return golden.select(F.explode(F.concat("answers", "bridges")).alias("qid")).distinct()


def random_policy(golden: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """(id, predicted): min(n, pool) ids of the whole pool for each question, each question its own.

    The pool is put into a seeded order; a question begins at a place and goes on in strides that its hash gives, round
    the pool. Strides share no divisor with the pool's size, so no id comes twice. The pool is checkpointed before it is
    ordered, as drawing ranges would make all golden sets once more.
    """
    return _own_draws(golden, n, seed)


def _own_draws(golden: DataFrame, n: int, seed: int) -> DataFrame:
    ensure_checkpoint_dir(golden.sparkSession)
    pool = indexed(golden_pool(golden).checkpoint(), seeded(seed, F.col("qid")), F.col("qid"))
    size = pool.count()
    if not size or n < 1:
        return golden.select("id", F.array().cast("array<string>").alias("predicted"))
    strides = F.array(*(F.lit(b) for b in range(1, min(size, 1024) + 1) if math.gcd(b, size) == 1))
    h = seeded(seed, F.col("id"))
    part = lambda at: F.conv(F.substring(h, at, 12), 16, 10).cast("long")
    stride = F.element_at(strides, (part(13) % F.size(strides) + 1).cast("int")).cast("long")
    asked = golden.select("id", (part(1) % size).alias("first"), stride.alias("stride")).select("id", "first", "stride", F.explode(F.sequence(F.lit(0), F.lit(min(n, size) - 1))).alias("n"))
    drawn = asked.select("id", "n", ((F.col("first") + F.col("n") * F.col("stride")) % size).alias("place")).join(pool.select("place", "qid"), "place")
    return drawn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "qid"))).alias("x")).select("id", F.transform("x", lambda v: v["qid"]).alias("predicted"))


def summary(policy: Column, n: Column, ndcg: Column, recall: Column, f1: Column, k: int = 50) -> Column:
    """A report in one line, means to four places, halves to even."""
    return F.format_string(f"%s: n=%d  NDCG=%.4f  recall@{k}=%.4f  F1=%.4f", policy, n, *(F.bround(x, 4) for x in (ndcg, recall, f1)))


def progress(accepted: Column, attempts: Column, target: int, seconds: Column) -> Column:
    """A line on how far a run is: accepted of its target, the share of attempts that were, attempts a second, seconds to go (-1: unknown)."""
    rate = F.when(attempts > 0, accepted / attempts).otherwise(0.0)
    pace = F.when(seconds > 0, accepted / seconds).otherwise(0.0)
    to_go = F.when(pace > 0, F.greatest(F.lit(target) - accepted, F.lit(0)) / pace).otherwise(-1.0)
    return F.format_string(f"%d/{target} accepted, %.1f%% of %d attempts, %.2f/s, %.0f s to go", accepted, F.bround(rate * 100, 1), attempts, F.bround(F.when(seconds > 0, attempts / seconds).otherwise(0.0), 2), F.bround(to_go, 0))


def vector_policy(hits: DataFrame) -> DataFrame:
    """(id, predicted) from ranked hits (q, id, rank)."""
    ranked = hits.groupBy(F.col("q").alias("q")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("hit")))).alias("x"))
    return ranked.select(F.col("q").alias("id"), F.transform("x", lambda v: v["hit"]).alias("predicted"))


def episode_rollup(episodes: DataFrame) -> DataFrame:
    """Means, outcome counts and rates over episodes (outcome, n_tool_calls, wall_s), conditional means 0 where no row qualifies."""
    ok = F.col("outcome") == "ok"
    mean = lambda c, when=None: F.coalesce(F.avg(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0.0))
    return episodes.agg(
        F.count("*").alias("n"),
        mean("n_tool_calls").alias("mean_calls"),
        mean("n_tool_calls", ok).alias("mean_calls_ok"),
        mean("n_tool_calls", ~ok).alias("mean_calls_failed"),
        mean("wall_s").alias("mean_wall_s"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(F.col("n_tool_calls") == 0).alias("n_no_tools"),
    )


def outcome_rates(rows: DataFrame, *by: str) -> DataFrame:
    """Count and share of each outcome (within ``by``)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = rows.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("rate", F.col("n") / F.sum("n").over(w))


def map_sum(rows: DataFrame, column: str) -> DataFrame:
    """(key, total) of a map column summed over rows."""
    return rows.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def latency(rows: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Nearest-rank percentiles v[min(n - 1, int(p n))] of each group, from ranks (a value's place decides, not an estimate).

    Rows are counted by group and value first (map-side combined), then numbered by ``indexed`` over the distinct values, so
    no task sorts a group. A value covers the places between the counts before and after it.
    """
    counted = rows.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    ranged, parts = ordered(counted, F.col(by), F.col(value))
    # Rows of the group in earlier partitions: one row a group and partition.
    held = ranged.groupBy(by, PART).agg(F.sum("c").alias("held"), F.sum(F.col(value) * F.col("c")).alias("total"))
    before = Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    held = held.select(F.col(by).alias("by_"), F.col(PART).alias("part_"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n"), (F.sum("total").over(whole) / F.sum("held").over(whole)).alias("mean"))
    upto = F.sum("c").over(Window.partitionBy(by, PART).orderBy(value))
    placed = ranged.withColumn("upto", upto).join(held, (F.col(by) == F.col("by_")) & (F.col(PART) == F.col("part_"))).withColumn("upto", F.col("upto") + F.col("before"))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    pick = lambda p: F.min(F.when(F.col("upto") > place(p), F.col(value)))
    return placed.groupBy(by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *(pick(p).alias(f"p{round(p * 100)}") for p in at))


def throughput(n: Column, seconds: Column, target: int) -> list[Column]:
    """Calls a second, and seconds for ``target`` calls at that rate."""
    qps = F.when(seconds > 0, n / seconds).otherwise(0.0)
    return [qps.alias("qps"), F.when(qps > 0, F.lit(float(target)) / qps).alias("projected_s")]


def frontier(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points whose y is above that of every point before them by (x, y descending); of equal points the one that sorts first.

    The best before a point is that of its range of the order and of the ranges before, of which there is one row each.
    """
    ranged, keys = ordered(points, F.col(x), -F.col(y))
    tops = ranged.groupBy(PART).agg(F.max(y).alias("__top"))
    tops = tops.select(PART, F.max("__top").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # one row a partition
    within = F.max(y).over(Window.partitionBy(PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranged.withColumn("__best", within).join(F.broadcast(tops), PART).withColumn("__best", F.greatest("__best", "__before"))
    return rows.where(F.col("__best").isNull() | (F.col(y) > F.col("__best"))).drop("__best", "__before", PART, *keys)


def loglinear(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on log10(x)."""
    lx = F.log10(F.col(x))
    return points.where(F.col(x) > 0).agg(F.regr_slope(F.col(y), lx).alias("slope"), F.regr_intercept(F.col(y), lx).alias("intercept"), F.count("*").alias("n"))
