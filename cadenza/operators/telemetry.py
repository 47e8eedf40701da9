"""Provider telemetry, stage costs and routing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import safe_ratio


def provider_summary(attempts: DataFrame, *keys: str) -> DataFrame:
    """Attempts, successes, failures and mean latency of each provider (within ``keys``)."""
    return attempts.groupBy(*keys, "provider").agg(
        F.count("*").alias("attempts"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"),
        F.round(F.avg("latency"), 6).alias("avg_latency"),
    )


def routing_metrics(attempts: DataFrame, last: int = 20) -> DataFrame:
    """One row per run over its ``last`` attempts: success and fallback rates, mean cost and the policy they suggest.

    Success under 0.6 or fallbacks over 0.35: quality first; mean cost over the limit: cost first; else balanced.
    """
    w = Window.partitionBy("run_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    recent = attempts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    stats = recent.groupBy("run_id").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"),
        F.avg(F.when(F.col("provider") == "view", 1.0).otherwise(0.0)).alias("fallback_rate"), F.avg("latency").alias("cost"),
    )
    policy = F.when((F.col("success_rate") < 0.6) | (F.col("fallback_rate") > 0.35), "quality-first").when(F.col("cost") > 20, "cost-first").otherwise("balanced")
    return stats.select(
        "run_id", "n", F.round("success_rate", 6).alias("success_rate"), F.round("fallback_rate", 6).alias("fallback_rate"), F.round("cost", 6).alias("cost"),
        policy.alias("policy"), F.least(F.lit(1.0), F.col("n") / (2.0 * last)).alias("confidence"),
    )


def latest_per_stage(events: DataFrame, keys: list[str], stage: str, order: list[str]) -> DataFrame:
    """Last written row of each stage (events observed again replace what was counted before)."""
    kept = [c for c in events.columns if c not in (*keys, stage)]
    newest = F.max_by(F.struct(*kept), F.struct(*order)).alias("_v")
    return events.groupBy(*keys, stage).agg(newest).select(*keys, stage, "_v.*")


def policy_order(policy: str) -> list[Column]:
    """Sort keys of providers with ``quality``, ``cost``, ``latency``, ``idx`` under a routing policy; ties keep input order."""
    q, c, t, i = F.col("quality").desc(), F.col("cost"), F.col("latency"), F.col("idx")
    return {"quality-first": [q, c, i], "cost-first": [c, q, i], "latency-first": [t, q, i], "balanced": [(F.col("quality") / (1 + F.col("cost"))).desc(), i]}[policy]


def within_budget(providers: DataFrame, budget: float) -> DataFrame:
    """Providers with ``allowed`` and the reason when the cost exceeds what is left."""
    over = F.col("cost") > budget
    return providers.withColumn("allowed", ~over).withColumn("reason", F.when(over, F.format_string("cost %.2f exceeds remaining %.2f", F.col("cost"), F.lit(float(budget)))))


def success_share(attempts: DataFrame, key: str) -> DataFrame:
    """Success share of each key; 0 without attempts."""
    return attempts.groupBy(key).agg(safe_ratio(F.count_if("success").cast("double"), F.count("*")).alias("share"))
