"""Check reports: scores, comparisons, calibration and annotation order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scores import sigmoid

# Weights of the checks in the overall score; others weigh 0.05.
WEIGHTS = {"quality": 0.15, "safety": 0.2, "pacing": 0.12}
OTHER = 0.05


def weight_of(check: str = "check_id"):
    chosen = F.lit(OTHER)
    for name, weight in WEIGHTS.items():
        chosen = F.when(F.col(check) == name, weight).otherwise(chosen)
    return chosen


def overall(checks: DataFrame) -> DataFrame:
    """Weighted pass share of the checks not skipped; a failed safety check gives 0; label and coverage."""
    active, w = ~F.col("skipped"), weight_of()
    stats = checks.groupBy("report_id").agg(
        F.sum(F.when(active & F.col("passed"), w).otherwise(0.0)).alias("good"), F.sum(F.when(active, w).otherwise(0.0)).alias("total"),
        F.bool_or(active & (F.col("check_id") == "safety") & ~F.col("passed")).alias("unsafe"),
        F.round(F.count_if(active) / F.count("*"), 6).alias("confidence"),
    )
    score = F.when(F.col("unsafe") | (F.col("total") == 0), F.lit(0.0)).otherwise(F.round(F.col("good") / F.col("total"), 6))
    label = F.when(score >= 0.7, "good").when(score >= 0.4, "borderline").otherwise("bad")
    return stats.select("report_id", score.alias("score"), label.alias("label"), "confidence")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Checks active in both reports: regression, improvement or unchanged."""
    a = before.where(~F.col("skipped")).select("report_id", "check_id", F.col("passed").alias("was"))
    b = after.where(~F.col("skipped")).select("report_id", "check_id", F.col("passed").alias("now"))
    kind = F.when(F.col("was") & ~F.col("now"), "regression").when(~F.col("was") & F.col("now"), "improvement").otherwise("unchanged")
    return a.join(b, ["report_id", "check_id"]).withColumn("change", kind)


def feature_vector(checks: DataFrame, names: list[str]) -> DataFrame:
    """One row per report with a number for each check: 1 passed, 0 failed, 0.5 skipped or missing."""
    value = F.when(F.col("skipped"), 0.5).otherwise(F.col("passed").cast("double"))
    wide = checks.groupBy("report_id").pivot("check_id", names).agg(F.max(value))
    return wide.select("report_id", *[F.coalesce(n, F.lit(0.5)).alias(n) for n in names])


def calibrated(features: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """Logistic score of a feature vector."""
    total = F.lit(bias)
    for name, weight in weights.items():
        total = total + weight * F.col(name)
    return features.withColumn("score", F.round(sigmoid(total), 6))


def uncertainty(checks: DataFrame) -> DataFrame:
    """Annotation priority: half closeness of the score to 0.5, half disagreement of the checks."""
    share = checks.where(~F.col("skipped")).groupBy("report_id").agg(F.avg(F.col("passed").cast("double")).alias("p"))
    scored = overall(checks).join(share, "report_id", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
    value = 0.5 * (1 - 2 * F.abs(F.col("score") - 0.5)) + 0.5 * (1 - 2 * F.abs(F.col("p") - 0.5))
    return scored.select("report_id", F.round(value, 6).alias("uncertainty"))


def preference_rows(pairs: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Training rows of a preference calibrator: feature differences of A and B, 1 if A won; ties are dropped."""
    a = features.select(F.col("report_id").alias("a"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = features.select(F.col("report_id").alias("b"), *[F.col(n).alias(f"b_{n}") for n in names])
    joined = pairs.where("winner <> 'tie'").join(a, "a").join(b, "b")
    return joined.select("a", "b", *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names], (F.col("winner") == "A").cast("int").alias("y"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error, root mean square error and balanced accuracy of (p, y); the last bin is closed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")
    per = scored.groupBy(b).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    ece = per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
    hit = lambda label: F.count_if((F.col("y") == label) & ((F.col("p") >= 0.5).cast("int") == label)) / F.count_if(F.col("y") == label)
    rest = scored.agg(F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("rmse"), ((hit(1) + hit(0)) / 2).alias("balanced"))
    one = F.lit(1).alias("_one")
    return ece.select(one, F.round("ece", 6).alias("ece")).join(rest.select(one, F.round("rmse", 6).alias("rmse"), F.round("balanced", 6).alias("balanced")), "_one").drop("_one")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union by key in which new rows win, and of several new ones the last by ``order``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    kept = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct("_new", order)).alias("_v"))
    return best.select(*keys, "_v.*").drop("_new")
