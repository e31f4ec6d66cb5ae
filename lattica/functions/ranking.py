"""Ranking metrics and rewards over ordered arrays, as Column expressions (no UDF, nothing exploded)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 50


@dataclass(frozen=True)
class RewardConfig:
    """Fixed values of the reward, overridable."""

    metric: str = "two_tier"
    k: int = 50
    most: int = 50
    format_bonus: float = 0.1
    dump_weight: float = 0.2
    length_penalty: bool = False
    length_coef: float = 0.0001
    length_target: int = 3072

    def __post_init__(self) -> None:
        if self.metric not in ("two_tier", "recall"):
            raise ValueError(f"unknown metric {self.metric!r}")


def top(predicted: Column, k: int) -> Column:
    """Distinct first, cut second."""
    none = F.array().cast("array<string>")
    if k <= 0:
        return none
    whole = F.coalesce(predicted, none)
    # Where the first k differ, the rest needn't be looked at.
    return _let(F.slice(whole, 1, k), lambda head: F.when(F.size(F.array_distinct(head)) == F.size(head), head).otherwise(F.slice(F.array_distinct(whole), 1, k)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once, also for a lambda inside."""
    return F.transform(F.array(value), use)[0]


def _found(some: Column, answer: Column, bridge: Column) -> Column:
    """``some`` with its members that are answers and bridges, so that each of a few isn't sought in long arrays."""
    return F.struct(some.alias("some"), F.array_intersect(answer, some).alias("answer"), F.array_intersect(bridge, some).alias("bridge"))


def _dcg(gains: Column) -> Column:
    terms = F.transform(gains, lambda g, i: g / F.log2(i.cast("double") + F.lit(2.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def ndcg_two_tier(predicted: Column, answer: Column, bridge: Column, k: int = K) -> Column:
    """Answers gain 2, bridges 1; the ideal is all answers, then the other bridges, cut at k; 0 where there is no ideal."""
    gain = lambda f: F.transform(f["some"], lambda q: F.when(F.array_contains(f["answer"], q), 2.0).when(F.array_contains(f["bridge"], q), 1.0).otherwise(0.0))
    gains = _let(top(predicted, k), lambda first: _let(_found(first, answer, bridge), gain))
    return ndcg_of(gains, F.size(F.array_distinct(answer)), F.size(F.array_except(bridge, answer)), k)


def ndcg_of(gains: Column, n: Column, m: Column, k: int = K) -> Column:
    """The same from the first k gains, with n answers and m other bridges."""
    most = F.lit(max(k, 0))
    ideal = F.slice(F.concat(F.array_repeat(F.lit(2.0), F.least(n, most)), F.array_repeat(F.lit(1.0), F.least(m, most))), 1, max(k, 0))
    return _let(_dcg(ideal), lambda best: F.when(best > 0, _dcg(gains) / best).otherwise(0.0))


def hash_bound(n: Column, k: int = K) -> Column:
    """What about 3 k of n hashes are below, as their first 8 hex digits; null where n is too small to gain by it."""
    return F.when(n > 6 * k, F.lower(F.lpad(F.hex(F.floor(F.lit(3.0 * k * 2**32) / n)), 8, "0")))


def hashed_gains(key: Column, tiers: list[tuple[Column, Column | None, float]], k: int = K) -> Column:
    """Gains of the first k ids of disjoint sets (ids without some, gain), all put in the order of SHA-256 of key|id.

    Every id is hashed. Of many, only those below a bound that about 3 k pass are sorted; where fewer than k pass, all are.
    """
    if k <= 0:
        return F.array().cast("array<double>")
    names = [f"t{i}" for i in range(len(tiers))]
    n = reduce(add, (F.size(ids) for ids, _, _ in tiers))
    left = lambda keep: F.struct(*((keep(ids) if less is None else F.array_except(keep(ids), less)).alias(t) for t, (ids, less, _) in zip(names, tiers)))

    def first(at: Column) -> Column:
        hashed = lambda q: F.sha2(F.concat(at["key"], q), 256)
        whole, low = left(lambda ids: ids), left(lambda ids: F.filter(ids, lambda q: hashed(q) < at["bound"]))
        some = F.when(at["bound"].isNull(), whole).otherwise(_let(low, lambda f: F.when(reduce(add, (F.size(f[t]) for t in names)) >= k, f).otherwise(whole)))

        def row(gain: float) -> Callable[[Column], Column]:
            return lambda q: F.struct(hashed(q).alias("hash"), q.alias("q"), F.lit(gain).alias("gain"))

        def placed(f: Column) -> Column:
            rows = F.concat(*(F.transform(f[t], row(gain)) for t, (_, _, gain) in zip(names, tiers)))
            return F.transform(F.slice(F.sort_array(rows), 1, k), lambda x: x["gain"])

        return _let(some, placed)

    return _let(F.struct(F.concat(key, F.lit("|")).alias("key"), hash_bound(n, k).alias("bound")), first)


def size_without(ids: Column, less: Column) -> Column:
    """How many ids, each there once, are left without some."""
    few = F.array_distinct(less)
    return F.size(ids) - F.when(F.size(few) <= 8, F.size(F.filter(few, lambda q: F.array_contains(ids, q)))).otherwise(F.size(F.array_intersect(few, ids)))


def recall_at_k(predicted: Column, answer: Column, k: int = K) -> Column:
    n = F.size(F.array_distinct(answer))
    return F.when(n > 0, F.size(F.array_intersect(top(predicted, k), answer)) / n).otherwise(0.0)


def f1_set(predicted: Column, answer: Column) -> Column:
    """2 |P and A| / (|P| + |A|) of the sets, uncut."""
    hits = F.size(F.array_intersect(predicted, answer))
    return F.when(hits > 0, 2.0 * hits / (F.size(F.array_distinct(predicted)) + F.size(F.array_distinct(answer)))).otherwise(0.0)


def reward(predicted: Column, answer: Column, bridge: Column, tokens: Column | None = None, config: RewardConfig = RewardConfig()) -> Column:
    """total, task_score, dump_penalty, junk_count, length_penalty, parsed, n_entities and truncated of a parsed answer."""
    cut = F.slice(predicted, 1, config.most)
    other = F.array_except(bridge, answer)
    task = recall_at_k(cut, answer, config.k) if config.metric == "recall" else ndcg_two_tier(cut, answer, other, config.k)
    junk = _let(_found(cut, answer, bridge), lambda f: F.size(F.filter(f["some"], lambda q: ~F.array_contains(f["answer"], q) & ~F.array_contains(f["bridge"], q))))
    return reward_of(F.size(predicted), task, junk, tokens, config)


def reward_of(n: Column, task: Column, junk: Column, tokens: Column | None = None, config: RewardConfig = RewardConfig()) -> Column:
    """The same from the number of predicted ids, the score of the task and the junk among the first ones."""
    parsed = n > 0
    dump = F.lit(config.dump_weight) * junk / F.lit(float(config.k))
    over = F.greatest(F.lit(0), tokens - config.length_target) if tokens is not None else F.lit(0)
    length = F.coalesce(F.lit(config.length_coef) * over, F.lit(0.0)) if config.length_penalty else F.lit(0.0)
    total = F.greatest(F.lit(0.0), task + config.format_bonus - dump - length)
    zero = lambda c, z=0.0: F.when(parsed, c).otherwise(z)
    return F.struct(
        zero(total).alias("total"), zero(task).alias("task_score"), zero(F.lit(config.format_bonus)).alias("format_bonus"), zero(dump).alias("dump_penalty"), zero(junk, 0).alias("junk_count"),
        zero(length).alias("length_penalty"), parsed.alias("parsed"), zero(F.least(n, F.lit(config.most)), 0).alias("n_entities"), (n > config.most).alias("truncated"),
    )


def outcome(parsed: Column, n_entities: Column) -> Column:
    return F.when(~parsed, "unparsed").when(n_entities == 0, "empty").otherwise("ok")
