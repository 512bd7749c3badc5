"""Many logistic models in one pass: a model is a name on its rows, not a fit of its own.

Rows (model, trained, feat, label) carry the name of their model, so a pair is a row for each
representation, regime, set and seed that it takes part in. Means and deviations of all models'
training rows are one sum, and every Newton step of all ridge regressions is one more: a task adds up
gradients and second derivatives for each model that it meets, and Spark adds up the tasks'. What
reaches the driver is a row a model; how many models there are is a parameter of the study.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators.calibration import summed
from edgewright.operators.ranges import checkpointed

STEPS, RIDGE = 50, 1.0


def _matrices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each model of a batch (unit, feat, label) with its features, padded with zeros, and labels."""
    units, label, lists = np.asarray(batch.column(0)), np.asarray(batch.column(2)).astype(float), batch.column(1)
    size = np.diff(np.asarray(lists.offsets))
    x = np.zeros((len(units), width))
    x[np.arange(width)[None, :] < size[:, None]] = np.asarray(lists.flatten())
    for u in np.unique(units).tolist():
        mine = units == u
        yield u, x[mine], label[mine]


def fit(rows: DataFrame, models: int, width: int, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, coefficients with the intercept first) of the models of rows (unit, feat, label).

    A feature without deviation counts as zero; the intercept isn't penalized."""
    rows = checkpointed(rows.select("unit", "feat", "label"))

    def moments(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for u, x, _ in _matrices(batch, width):
            yield np.array([u]), np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])[None]

    padded = lambda s: np.vstack([s, np.zeros((models - len(s), s.shape[1]))])
    s = padded(summed(rows, moments, 1 + 2 * width))
    n = np.maximum(s[:, :1], 1)
    mean = s[:, 1 : width + 1] / n
    variance = s[:, width + 1 :] / n - mean**2
    scale = np.where(variance > 1e-12 * (1 + mean**2), np.sqrt(np.maximum(variance, 1e-300)), np.inf)
    theta, k = np.zeros((models, width + 1)), width + 1
    penalty = np.diag([0.0] + [ridge] * width)
    for _ in range(STEPS):

        def derivatives(batch: pa.RecordBatch, theta: np.ndarray = theta) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for u, x, y in _matrices(batch, width):
                a = np.hstack([np.ones((len(x), 1)), (x - mean[u]) / scale[u]])
                q = 1 / (1 + np.exp(-np.clip(a @ theta[u], -500, 500)))
                yield np.array([u]), np.concatenate([a.T @ (y - q), ((a * (q * (1 - q))[:, None]).T @ a).ravel()])[None]

        g = padded(summed(rows, derivatives, k + k * k))
        moved = np.zeros(models)
        for u in range(models):
            if n[u, 0] and s[u, 0]:
                step = np.linalg.solve(g[u, k:].reshape(k, k) + penalty + 1e-9 * np.eye(k), g[u, :k] - penalty @ theta[u])
                theta[u] = theta[u] + np.clip(step, -5, 5)
                moved[u] = np.abs(step).max()
        if moved.max(initial=0) < 1e-9:
            break
    return mean, scale, theta


def scored(rows: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """The rows (model, trained, feat, label, ...) that no model was trained on, with their model's ``p``;
    one half of a model without training rows."""
    names = [r["model"] for r in rows.select("model").distinct().orderBy("model").collect()]  # the models of a study
    if not names:
        return rows.drop("feat").withColumn("p", F.lit(0.5))
    listed = F.create_map(*[F.lit(v) for i, name in enumerate(names) for v in (name, i)])
    numbered = checkpointed(rows.withColumn("unit", listed[F.col("model")]))
    width = numbered.agg(F.max(F.size("feat"))).first()[0] or 1
    mean, scale, theta = fit(numbered.filter("trained"), len(names), width, ridge)
    test = numbered.filter("NOT trained")
    columns = [c for c in rows.columns if c != "feat"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, units = np.zeros(len(batch)), np.asarray(batch.column(0))
            for u, x, _ in _matrices(batch, width):
                p[units == u] = 1 / (1 + np.exp(-np.clip(theta[u, 0] + (x - mean[u]) / scale[u] @ theta[u, 1:], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(p)], [*columns, "p"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", p double"
    return test.select("unit", "feat", F.col("label").alias("_y"), *columns).mapInArrow(run, schema)
