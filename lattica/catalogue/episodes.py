"""Telemetry rollups over events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import evaluation, splits
from lattica.session import table



def episodes(spark, sf_dir):
    """One episode a user: outcome from its errors, calls by tool as a map, time from the values."""
    by_tool = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    rows = by_tool.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "c")))).alias("tool_hist"), F.sum("c").alias("n_tool_calls"), F.sum("s").alias("wall_s"), F.coalesce(F.max(F.when(F.col("event_type") == "error", F.col("c"))), F.lit(0)).alias("errors")
    )
    return rows.withColumn("outcome", F.when(F.col("errors") > F.col("n_tool_calls") / 5, "unparsed").otherwise("ok"))


def telemetry_rollup(spark, sf_dir):
    out = evaluation.episode_rollup(episodes(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("mean")})


def tool_histogram(spark, sf_dir):
    return evaluation.map_sum(episodes(spark, sf_dir), "tool_hist")


def outcome_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("outcome"))
    return evaluation.outcome_rates(rows, "quality").select(F.col("quality").cast("long").alias("quality"), "outcome", "n", F.round("rate", 6).alias("rate"))


def latency_percentiles(spark, sf_dir):
    out = evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return out.withColumn("mean", F.round("mean", 6))


def load_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    qps, projected = evaluation.throughput(F.col("n"), F.col("s"), 6000)
    out = rows.select("event_type", "n", qps, projected)
    return out.select("event_type", "n", F.round("qps", 6).alias("qps"), F.round("projected_s", 3).alias("projected_s"))


def points(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("x"), F.round(F.max("value"), 4).alias("y"))
    return rows


def pareto_frontier(spark, sf_dir):
    return evaluation.frontier(points(spark, sf_dir), "x", "y").groupBy("x", "y").agg(F.min("user_id").alias("user_id"))


def loglinear_fit(spark, sf_dir):
    out = evaluation.loglinear(points(spark, sf_dir), "x", "y")
    return out.select(F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), "n")


def stage_counts(spark, sf_dir):
    """Conversations by stage, as generation counts its attempts."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "system").alias("systems"))
    stage = F.when(F.col("systems") > 0, "with_system").when(F.col("turns") == 1, "single").otherwise("dialogue")
    return rows.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.sum("turns").alias("turns"))


def usage_cost(spark, sf_dir):
    """Usage totals and cost by accepted answer."""
    rows = table(spark, sf_dir, "events")
    out = rows.agg(F.count("*").alias("calls"), F.sum("value").alias("cost"), F.count_if(F.col("event_type") == "purchase").alias("accepted"))
    return out.select("calls", F.round("cost", 2).alias("cost"), "accepted", F.round(F.col("cost") / F.greatest("accepted", F.lit(1)), 6).alias("per_accepted"))


def budget_stop(spark, sf_dir):
    """Each user's events until the running cost is above 500."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    kept = splits.within_budget(rows, 50000, order="event_id", cost="cents", group="user_id")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.max("spent").alias("spent"))


def judge_panel(spark, sf_dir):
    """A question stays if each of three judges accepts it; otherwise the first that doesn't is named."""
    k = F.get_json_object("props", "$.k").cast("int")
    verdicts = F.array(*(F.struct(F.lit(f"j{m}").alias("judge"), (k % m != 0).alias("accept")) for m in (2, 3, 5)))
    rows = table(spark, sf_dir, "events").select("event_id", verdicts.alias("v"))
    first = F.try_element_at(F.filter("v", lambda x: ~x["accept"]), F.lit(1))["judge"]
    return rows.select("event_id", F.forall("v", lambda x: x["accept"]).alias("accepted"), F.coalesce(first, F.lit("")).alias("rejected_by"))


def retryable(status):
    """Timeouts, conflicts, rate limits and server errors are worth a retry."""
    return status.isin(408, 409, 425, 429) | (status >= 500)


def retry_counts(spark, sf_dir):
    status = F.lit(400) + F.get_json_object("props", "$.k").cast("int") * 2
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(status.alias("status"))
    return rows.groupBy(retryable(F.col("status")).alias("retry")).agg(F.count("*").alias("n"), F.countDistinct("status").alias("kinds"))


QUERIES = {
    "telemetry_rollup": telemetry_rollup,
    "tool_histogram": tool_histogram,
    "outcome_rates": outcome_rates,
    "latency_percentiles": latency_percentiles,
    "load_throughput": load_throughput,
    "pareto_frontier": pareto_frontier,
    "loglinear_fit": loglinear_fit,
    "stage_counts": stage_counts,
    "usage_cost": usage_cost,
    "budget_stop": budget_stop,
    "judge_panel": judge_panel,
    "retry_counts": retry_counts,
}
_E = "e AS (SELECT user_id, count(*) AS n, sum(value) AS s, count(*) FILTER (WHERE event_type = 'error') AS err FROM events GROUP BY 1), x AS (SELECT *, err <= n / 5 AS ok FROM e)"
ORACLES = {
    "telemetry_rollup": f"WITH {_E} SELECT count(*) AS n, round(avg(n), 4) AS mean_calls, round(coalesce(avg(n) FILTER (WHERE ok), 0), 4) AS mean_calls_ok, round(coalesce(avg(n) FILTER (WHERE NOT ok), 0), 4) AS mean_calls_failed, round(avg(s), 4) AS mean_wall_s, count(*) FILTER (WHERE ok) AS n_ok, CAST(0 AS BIGINT) AS n_no_tools FROM x",
    "tool_histogram": "SELECT event_type AS key, count(*) AS total FROM events GROUP BY 1",
    "outcome_rates": "SELECT CAST(quality AS BIGINT) AS quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS rate FROM labels GROUP BY 1, 2, quality",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r FROM events)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE r = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS p50, max(value) FILTER (WHERE r = least(n - 1, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT))) AS p90, max(value) FILTER (WHERE r = least(n - 1, CAST(floor(n * CAST(0.99 AS DOUBLE)) AS BIGINT))) AS p99 FROM r GROUP BY 1""",
    "load_throughput": "SELECT event_type, count(*) AS n, round(count(*) / sum(value), 6) AS qps, round(6000.0 / (count(*) / sum(value)), 3) AS projected_s FROM events GROUP BY 1",
    "pareto_frontier": """WITH p AS (SELECT user_id, round(avg(value), 4) AS x, round(max(value), 4) AS y FROM events GROUP BY 1)
SELECT x, y, min(user_id) AS user_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE (q.x < p.x AND q.y >= p.y) OR (q.x = p.x AND q.y > p.y)) GROUP BY 1, 2""",
    "loglinear_fit": "WITH p AS (SELECT user_id, round(avg(value), 4) AS x, round(max(value), 4) AS y FROM events GROUP BY 1) SELECT round(regr_slope(y, log10(x)), 5) AS slope, round(regr_intercept(y, log10(x)), 5) AS intercept, count(*) AS n FROM p WHERE x > 0",
    "stage_counts": "WITH c AS (SELECT conv_id, count(*) AS t, count(*) FILTER (WHERE role = 'system') AS s FROM conversations GROUP BY 1) SELECT CASE WHEN s > 0 THEN 'with_system' WHEN t = 1 THEN 'single' ELSE 'dialogue' END AS stage, count(*) AS n, CAST(sum(t) AS BIGINT) AS turns FROM c GROUP BY 1",
    "usage_cost": "SELECT count(*) AS calls, round(sum(value), 2) AS cost, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, round(sum(value) / greatest(count(*) FILTER (WHERE event_type = 'purchase'), 1), 6) AS per_accepted FROM events",
    "budget_stop": "WITH r AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id, count(*) AS n, CAST(max(s) AS BIGINT) AS spent FROM r WHERE s <= 50000 GROUP BY 1",
    "judge_panel": "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT event_id, k % 2 <> 0 AND k % 3 <> 0 AND k % 5 <> 0 AS accepted, CASE WHEN k % 2 = 0 THEN 'j2' WHEN k % 3 = 0 THEN 'j3' WHEN k % 5 = 0 THEN 'j5' ELSE '' END AS rejected_by FROM e",
    "retry_counts": "WITH e AS (SELECT 400 + 2 * CAST(json_extract_string(props, '$.k') AS INT) AS s FROM events WHERE event_type = 'error') SELECT s IN (408, 409, 425, 429) OR s >= 500 AS retry, count(*) AS n, count(DISTINCT s) AS kinds FROM e GROUP BY 1",
}
