"""Training sets: stable splits, curricula, quotas, stop conditions and nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.ids import seeded, split_of
from lattica.session import ensure_checkpoint_dir

MAX_VAL = 512
# The names of the retrieval tools.
TOOLS = ("vector_search", "get_entity", "get_neighbors", "find_paths")


def split(records: DataFrame, val_frac: float = 0.05) -> DataFrame:
    """Records with their split, which depends on the id alone."""
    return records.withColumn("split", split_of(F.col("id"), val_frac))


def validation(records: DataFrame, val_frac: float = 0.05, most: int | None = MAX_VAL) -> DataFrame:
    """The validation records by id, cut at ``most``; those beyond don't go back to training."""
    rows = split(records, val_frac).where("split = 'val'").orderBy("id")
    return rows.limit(most) if most is not None else rows


def curriculum(records: DataFrame, kind: str = "off", seed: int = 0) -> DataFrame:
    """Records with ``place``: off is a seeded shuffle, sorted goes by rank, mixed takes one of each rank in turn.

    Places are made by a sort that Spark distributes, then a count of the rows before each partition.
    """
    key = seeded(seed, F.col("id"))
    if kind == "off":
        order = [key]
        rows = records
    elif kind == "sorted":
        order = [F.col("rank"), key]
        rows = records
    elif kind == "mixed":
        rows = ranked(records, "rank", key, F.col("id"))
        order = [F.col("turn"), F.col("rank")]
    else:
        raise ValueError(f"unknown curriculum {kind!r}")
    return indexed(rows, *order, F.col("id")).drop("turn")


PART = "__part"


def ordered(rows: DataFrame, *order) -> tuple[DataFrame, list[str]]:
    """Rows range-partitioned by an order, with the number of their partition, and the columns that hold the order.

    Checkpointed, as ranges drawn a second time could differ from those that were counted.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.withColumns(dict(zip(keys, order)))
    return rows.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()).checkpoint(), keys


def indexed(rows: DataFrame, *order) -> DataFrame:
    """Rows with ``place`` from 0 in an order, without a single-task window over all of them."""
    ranged, keys = ordered(rows, *order)
    sizes = ranged.groupBy(PART).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(PART, before.alias("__before"))  # one row a partition
    nth = F.row_number().over(Window.partitionBy(PART).orderBy(*keys)) - 1
    return ranged.withColumn("__nth", nth).join(F.broadcast(sizes), PART).withColumn("place", F.col("__before") + F.col("__nth")).drop(PART, "__nth", "__before", *keys)


def ranked(rows: DataFrame, by: str, *order) -> DataFrame:
    """Rows with ``turn`` from 1 within each value of ``by``: the place in an order of all less the rows of smaller values.

    One row a value is joined back, broadcast by Spark while it is small; no value is sorted in one task.
    """
    placed = indexed(rows, F.col(by), *order)
    first = placed.groupBy(F.col(by).alias("by_")).agg(F.min("place").alias("first_"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("by_"))).withColumn("turn", F.col("place") - F.col("first_") + 1).drop("place", "by_", "first_")


def quota(records: DataFrame, targets: dict[int, float], total: int, seed: int = 0, reached: dict[int, int] | None = None) -> DataFrame:
    """Of each difficulty the first round(target * total) records in seeded order, less those that were reached before."""
    want = {k: max(round(v * total) - (reached or {}).get(k, 0), 0) for k, v in targets.items()}
    share = F.create_map(*[F.lit(x) for k, n in want.items() for x in (k, n)])
    rows = ranked(records.where(F.col("difficulty").cast("int").isin(list(want))), "difficulty", seeded(seed, F.col("id")), F.col("id"))
    return rows.where(F.col("turn") <= F.try_element_at(share, F.col("difficulty").cast("int"))).drop("turn")


def parse_mix(spec: str, difficulties: tuple[int, ...] = (2, 3, 4)) -> dict[int, float]:
    """Shares by difficulty from as many weights, such as '40,35,25'; ValueError unless each is at least 0 and their sum above."""
    try:
        weights = [float(x) for x in spec.split(",")]
    except ValueError:
        weights = []
    if len(weights) != len(difficulties) or not all(w >= 0 for w in weights) or not 0 < sum(weights) < float("inf"):
        raise ValueError(f"not {len(difficulties)} weights: {spec!r}")
    return {d: w / sum(weights) for d, w in zip(difficulties, weights)}


def draw_weighted(rows: DataFrame, weights: dict, column: str, seed: int = 0) -> DataFrame:
    """Rows with ``column``: one of the keys of weights, drawn by a seeded hash of the id in proportion to them.

    Keys of weight 0 are never drawn; ValueError where no weight is above 0.
    """
    some = {k: w for k, w in weights.items() if w > 0}
    if not some:
        raise ValueError("no weight is above 0")
    u = F.conv(F.substring(seeded(seed, F.col("id")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    total, upto, pick = sum(some.values()), 0.0, None
    for k, w in list(some.items())[:-1]:
        upto += w / total
        pick = F.when(u < upto, F.lit(k)) if pick is None else pick.when(u < upto, F.lit(k))
    last = F.lit(list(some)[-1])
    return rows.withColumn(column, last if pick is None else pick.otherwise(last))


def next_difficulty(attempts: DataFrame, targets: dict[int, float], total: int, reached: dict[int, int] | None = None, seed: int = 0) -> DataFrame:
    """Attempts (id) with the difficulty to try: drawn by what its quota still lacks, by the targets once all are met."""
    left = {d: max(t * total - (reached or {}).get(d, 0), 0.0) for d, t in sorted(targets.items())}
    return draw_weighted(attempts, left if sum(left.values()) > 0 else dict(sorted(targets.items())), "difficulty", seed)


def stop_reason(accepted, attempts, cost, target: int, most_attempts: int, budget: float):
    """Why a run ends, of three columns: target reached, attempts exhausted, budget spent, in this order; else null."""
    return F.when(accepted >= target, "target").when(attempts >= most_attempts, "attempts").when(cost >= budget, "budget")


def within_budget(attempts: DataFrame, budget: float, order: str = "attempt", cost: str = "cost", group: str | None = None) -> DataFrame:
    """Attempts whose cost and those before it (of their group) stay within the budget, with the sum ``spent``.

    Without a group the sums run over ranges of the order, then over one row a range; ties of the order count together.
    """
    if group is not None:
        w = Window.partitionBy(group).orderBy(order)
        return attempts.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
    ranged, keys = ordered(attempts, F.col(order))
    sums = ranged.groupBy(PART).agg(F.sum(cost).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(PART, before.alias("__before"))  # one row a partition
    spent = F.sum(cost).over(Window.partitionBy(PART).orderBy(order))
    rows = ranged.withColumn("spent", spent).join(F.broadcast(sums), PART).withColumn("spent", F.col("spent") + F.col("__before"))
    return rows.where(F.col("spent") <= budget).drop(PART, "__before", *keys)


def rl_rows(records: DataFrame, system: str, prefix: str = "retrieval/") -> DataFrame:
    """Nested rows for reinforcement learning: prompt, ground truth as JSON, tool arguments."""
    none = F.array().cast("array<string>")
    truth = F.to_json(F.struct(F.coalesce("answers", none).alias("answer_qids"), F.coalesce("bridges", none).alias("bridge_qids")))
    tool = lambda: F.struct(F.struct(F.col("id").alias("question_id")).alias("create_kwargs"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return records.select(
        F.concat(F.lit(prefix), F.coalesce("source", F.lit("unknown"))).alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", F.col("question"))).alias("prompt"),
        F.lit("entity-retrieval").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.col("place").alias("index"), "split", "id", F.coalesce(F.col("difficulty").cast("string"), F.lit("")).alias("difficulty"), F.lit(True).alias("need_tools_kwargs"),
            F.struct(*(tool().alias(t) for t in TOOLS)).alias("tools_kwargs"),
        ).alias("extra_info"),
    )
