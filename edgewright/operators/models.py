"""Classifiers over pair features (feat, label) by MLlib, and calibration of their scores."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions.vectors import logit
from edgewright.operators.ranges import checkpointed

SEED = 42


def classifier(kind: str, width: int, n: int):
    """An estimator by name: lr, rf, gbt or mlp."""
    common = {"labelCol": "label", "featuresCol": "scaled"}
    if kind == "lr":
        return LogisticRegression(regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, maxIter=100, **common)
    if kind == "rf":
        return RandomForestClassifier(numTrees=300, maxDepth=8, seed=SEED, **common)
    if kind == "gbt":
        return GBTClassifier(maxIter=300, maxDepth=4, seed=SEED, **common)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[width, 128, 64, 2], maxIter=50, seed=SEED, **common)
    raise ValueError(f"unknown classifier {kind!r}")


def fit_predict(train: DataFrame, test: DataFrame, kind: str = "lr") -> DataFrame:
    """``test`` with ``p``; the scaler, by population deviations, sees the training rows alone."""
    as_vector = lambda df: df.withColumn("x", array_to_vector("feat"))
    first = train.agg(F.count("*").alias("n"), F.max(F.size("feat")).alias("width")).first()
    n, width = first["n"], first["width"]
    scaler = StandardScaler(inputCol="x", outputCol="by_sample", withMean=True, withStd=True)
    whole = ElementwiseProduct(inputCol="by_sample", outputCol="scaled", scalingVec=Vectors.dense([(n / max(1, n - 1)) ** 0.5] * width))
    model = Pipeline(stages=[scaler, whole, classifier(kind, width, n)]).fit(as_vector(train))
    scored = model.transform(as_vector(test)).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*test.columns, "p")


def platt(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """``apply_to`` (y, p, ...) with ``p_platt``: an unpenalized logistic regression on the logit."""
    rows = lambda df: df.withColumn("x", array_to_vector(F.array(logit(F.col("p")))))
    model = LogisticRegression(labelCol="y", featuresCol="x", regParam=0.0, probabilityCol="q", predictionCol="c", rawPredictionCol="r").fit(rows(fit_on))
    return model.transform(rows(apply_to)).withColumn("p_platt", vector_to_array("q")[1]).drop("x", "q", "c", "r")


def cox(scored: DataFrame) -> DataFrame:
    """One row: calibration slope and intercept, and whether classes are separated."""
    rows = scored.withColumn("x", array_to_vector(F.array(logit(F.col("p")))))
    model = LogisticRegression(labelCol="y", featuresCol="x", regParam=0.0, maxIter=100).fit(rows)
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    separated = abs(slope) > 20 or model.summary.totalIterations >= 100
    return scored.agg(F.count("*").alias("n")).select("n", F.lit(slope).alias("slope"), F.lit(intercept).alias("intercept"), F.lit(separated).alias("separated"))


def isotonic(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """``apply_to`` with ``p_isotonic``, monotone in p and within 0 and 1."""
    counted = fit_on.groupBy("p").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    model = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="iso").fit(counted)
    return model.transform(apply_to).withColumn("p_isotonic", F.least(F.greatest("iso", F.lit(0.0)), F.lit(1.0))).drop("iso")


def cross_validated(rows: DataFrame, k: int, kind: str = "lr") -> DataFrame:
    """``rows`` (feat, label, fold, ...) each scored by the model, and the scaler, of the other folds."""
    rows = checkpointed(rows)
    parts = [fit_predict(rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i), kind) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def trained_on_each(sets: DataFrame, kind: str = "lr") -> DataFrame:
    """(trained_on, grp, y, p): a model of each set's training rows, over the test rows of every set
    (set_name, side, feat, label), so that a set is tested by its own model and by the others'."""
    sets = checkpointed(sets)
    names = sorted(r["set_name"] for r in sets.select("set_name").distinct().collect())
    test, out = sets.filter("side = 'test'").select(F.col("set_name").alias("grp"), "feat", "label"), None
    for name in names:
        train = sets.filter((F.col("set_name") == name) & (F.col("side") == "train")).select("feat", "label")
        scored = fit_predict(train, test, kind).select(F.lit(name).alias("trained_on"), "grp", F.col("label").alias("y"), "p")
        out = scored if out is None else out.union(scored)
    return out
