"""Quality regressors and the preference calibrator, on Spark's own learners."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def _folds(rows: DataFrame, key: str) -> DataFrame:
    """Fold of each row by a hash of its group, so that a group never straddles folds."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int"))


def quality_regressor(rows: DataFrame, features: list[str], label: str, group: str, kind: str = "ridge") -> CrossValidatorModel:
    """Ridge or boosted-tree regression of ``label``, its strength chosen by group folds. Missing features count as 0."""
    filled = _folds(rows.fillna(0.0, features), group)
    assemble = VectorAssembler(inputCols=features, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    if kind == "ridge":
        learner = LinearRegression(labelCol=label, elasticNetParam=0.0)
        grid = ParamGridBuilder().addGrid(learner.regParam, [0.01, 0.1, 1.0]).build()
    else:
        learner = GBTRegressor(labelCol=label, maxIter=20, seed=7)
        grid = ParamGridBuilder().addGrid(learner.maxDepth, [2, 4]).build()
    metric = RegressionEvaluator(labelCol=label, metricName="rmse")
    search = CrossValidator(estimator=Pipeline(stages=[assemble, scale, learner]), estimatorParamMaps=grid, evaluator=metric, numFolds=FOLDS, foldCol="fold", parallelism=2)
    return search.fit(filled)


def preference_calibrator(rows: DataFrame, features: list[str]) -> LogisticRegressionModel:
    """Logistic regression of ``y`` on feature differences, without a constant: swapping A and B turns the answer."""
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return LogisticRegression(labelCol="y", fitIntercept=False, regParam=0.01).fit(assembled)


def score_quality(model: CrossValidatorModel | PipelineModel, rows: DataFrame, features: list[str], low: float = 1.0, high: float = 5.0) -> DataFrame:
    """``rows`` with the predicted quality, limited to the label's range."""
    scored = model.transform(rows.fillna(0.0, features))
    return scored.withColumn("predicted", F.least(F.greatest("prediction", F.lit(low)), F.lit(high))).drop("raw", "features", "prediction")


def precision_recall_area(scored: DataFrame) -> DataFrame:
    """Area under the precision-recall curve of (p, y) by steps: equal scores enter together.

    Rows are first counted by score, so that the running sums run over distinct scores within score bands whose
    offsets are summed apart.
    """
    from pyspark.sql.window import Window

    by = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("band", F.floor(F.col("p") * 1000))
    bands = by.groupBy("band").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    over = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each of about a thousand bands.
    offsets = bands.select("band", F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("on"), F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("op"))
    inside = Window.partitionBy("band").orderBy(F.col("p").desc())
    cum = by.join(offsets, "band").withColumns({"tn": F.col("on") + F.sum("n").over(inside), "tp": F.col("op") + F.sum("pos").over(inside)})
    return cum.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("tn")) / F.sum("pos"), 6).alias("pr_area"))
