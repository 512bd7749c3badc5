"""Queries that fit classifiers and calibrators; their figures depend on the library, not on SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions import vectors
from edgewright.functions.draws import uniform
from edgewright.operators import metrics, models
from edgewright.plans.catalogue import query
from edgewright.plans.feature_queries import vector_pairs
from edgewright.sources import tables as t
from edgewright.streaming import pairs as stream


def _sides(spark, sf_dir):
    """Vectors whose label is even or odd, as labelled rows in training and test parts."""
    v = t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("feat"), (F.col("label") % 2).alias("label"))
    drawn = uniform(42, "vec_id")
    return v.filter(drawn >= 0.3), v.filter(drawn < 0.3)


def _model(kind: str) -> None:
    @query(f"model_{kind}")
    def run(spark, sf_dir):
        train, test = _sides(spark, sf_dir)
        scored = models.fit_predict(train, test, kind).select(F.lit(kind).alias("grp"), F.col("label").alias("y"), "p")
        return metrics.confusion(scored).join(metrics.roc_auc(scored), "grp").join(metrics.average_precision(scored), "grp")


for _kind in ("lr", "rf", "gbt", "mlp"):
    _model(_kind)


@query("model_pair_features")
def model_pair_features(spark, sf_dir):
    """Whether two neighbouring vectors share a label, from order-invariant features."""
    pairs, v = vector_pairs(spark, sf_dir)
    fused = vectors.fuse(pairs, v, "combined")
    drawn = uniform(42, "a", "b")
    scored = models.fit_predict(fused.filter(drawn >= 0.3), fused.filter(drawn < 0.3)).select(F.lit("pairs").alias("grp"), F.col("label").alias("y"), "p")
    return metrics.roc_auc(scored)


def _scores(spark, sf_dir):
    s = t.scored_items(spark, sf_dir).withColumn("p", F.col("p") / 2)
    half = F.crc32(F.concat_ws("|", F.round("p", 6).cast("string"), "grp").cast("binary")) % 2 == 0
    return s.filter(half), s


@query("calibrate_platt")
def calibrate_platt(spark, sf_dir):
    fit_on, rows = _scores(spark, sf_dir)
    return metrics.ece_width(models.platt(fit_on, rows).select("grp", "y", F.col("p_platt").alias("p")))


@query("calibrate_isotonic")
def calibrate_isotonic(spark, sf_dir):
    fit_on, rows = _scores(spark, sf_dir)
    return metrics.ece_width(models.isotonic(fit_on, rows).select("grp", "y", F.col("p_isotonic").alias("p")))


@query("calibration_slope")
def calibration_slope(spark, sf_dir):
    return models.cox(_scores(spark, sf_dir)[1])


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return stream.sessions(t.table(spark, sf_dir, "events"))
