"""Action and usage logs: validation, cost, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.dims import METRIC_ACTIONS
from marquee.functions.prices import model_cost

UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def valid_metric() -> Column:
    """UUID session, known action, and a payload that is a JSON object or absent."""
    payload = F.col("payload").isNull() | F.rlike("payload", F.lit(r"^\s*\{"))
    return F.rlike("session_id", F.lit(UUID)) & F.col("action").isin(*METRIC_ACTIONS) & payload


def accepted_metrics(rows: DataFrame) -> DataFrame:
    """Rows to append; invalid ones drop silently."""
    return rows.filter(F.coalesce(valid_metric(), F.lit(False)))


def action_counts(metrics: DataFrame) -> DataFrame:
    """Counts by action, by day, by both and in all (nulls mark the totals)."""
    day = F.to_date("created_at").cast("string")
    return metrics.select("action", day.alias("day")).cube("action", "day").agg(F.count("*").alias("n"))


def session_counts(metrics: DataFrame) -> DataFrame:
    day = F.to_date("created_at").cast("string").alias("day")
    return metrics.groupBy("session_id", day).agg(F.count("*").alias("n"))


def event_counts(metrics: DataFrame) -> DataFrame:
    return metrics.filter("event_id is not null").groupBy("event_id").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def costed_usage(rows: DataFrame) -> DataFrame:
    """Token defaults, totals and estimated cost."""
    prompt = F.coalesce("prompt_tokens", F.lit(0))
    done = F.coalesce("completion_tokens", F.lit(0))
    return rows.withColumns({
        "total_tokens": F.coalesce("total_tokens", prompt + done),
        "estimated_cost_usd": model_cost(F.col("model"), prompt, done),
        "prompt_tokens": prompt, "completion_tokens": done})


def usage_rollup(usage: DataFrame, by: str) -> DataFrame:
    """Tokens, cost, latency and failure rate by ``by`` and day, with subtotals."""
    day = F.to_date("created_at").cast("string")
    return usage.withColumn("day", day).rollup(by, "day").agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"),
        F.sum("estimated_cost_usd").alias("cost"), F.avg("latency_ms").alias("latency"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("failure_rate"))
