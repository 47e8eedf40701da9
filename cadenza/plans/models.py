"""Queries that fit or evaluate models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import learning
from cadenza.plans import analytics
from cadenza.plans.analytics import _VECTOR_SQL
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.shared import written
from cadenza.sources.tables import table


@register("pr_area", with_views(f"""WITH {_VECTOR_SQL}, p AS (SELECT round(1 / (1 + exp(-(-1 + 2 * v.quality + 1.5 * safety + 0.5 * pacing))), 6) AS p, l.quality AS y FROM v JOIN labels l ON l.doc_id = v.report_id),
    b AS (SELECT p, count(*) AS n, sum(y) AS pos FROM p GROUP BY p), c AS (SELECT *, sum(n) OVER (ORDER BY p DESC) AS tn, sum(pos) OVER (ORDER BY p DESC) AS tp FROM b)
    SELECT round(sum(pos * tp / tn) / sum(pos), 6) AS pr_area FROM c""", "checks"))
def pr_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = analytics.check_vectors(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.col("quality").alias("y")), "report_id")
    return learning.precision_recall_area(scored.select(F.col("score").alias("p"), "y"))


def _script_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = analytics.script_scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1.0 + 4.0 * F.col("quality")).alias("label"))
    return scripts.join(labels, "doc_id")


@register("quality_model")
def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of labelled quality on script features, folds by source; predictions of the labelled documents."""
    rows, names = _script_features(spark, sf_dir), ["n_scenes", "n_words", "seconds", "score"]
    # Every fold, strength and pass of the fit reads these again; the texts are read once.
    rows = written(rows.select("doc_id", "source", "label", *[F.col(n).cast("double").alias(n) for n in names]), "features")
    return learning.score_quality(learning.quality_regressor(rows, names, "label", "source"), rows, names).select("doc_id", "label", "predicted")


@register("preference_model")
def preference_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the preference calibrator."""
    names = ["quality", "safety", "pacing"]
    model = learning.preference_calibrator(analytics.preference_rows(spark, sf_dir), names)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, model.coefficients)], "feature string, weight double")
