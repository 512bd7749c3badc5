"""Many models in one pass against one fit after another."""

from __future__ import annotations

import random

import numpy as np
import pytest

from edgewright.operators import grid


def plain(train, test):
    """Predictions of one ridge regression, by Newton steps on all its rows."""
    x, y = np.array([r[2] for r in train], float), np.array([r[3] for r in train], float)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = np.inf
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    theta, penalty = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-(a @ theta)))
        theta += np.clip(np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(theta)), a.T @ (y - q) - penalty @ theta), -5, 5)
    t = (np.array([r[2] for r in test], float) - mean) / sd
    return 1 / (1 + np.exp(-(theta[0] + t @ theta[1:])))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for m, width in (("one", 2), ("two", 5), ("three", 1)):
        for i in range(120):
            x = [rng.gauss(0, 3) for _ in range(width)]
            if m == "two":
                x[3] = 7.0  # says nothing
            out.append((m, rng.random() < 0.7, x, int(rng.random() < 1 / (1 + np.exp(-x[0] / 2))), i))
    return out + [("untrained", False, [1.0], 1, 0)]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_single_fits(spark, rows, parts):
    found = grid.scored(spark.createDataFrame(rows, "model string, trained boolean, feat array<double>, label int, id int").repartition(parts)).collect()
    assert len(found) == sum(not r[1] for r in rows)
    got = {(r["model"], r["id"]): r["p"] for r in found}
    for m in ("one", "two", "three"):
        test = [r for r in rows if r[0] == m and not r[1]]
        assert [got[m, r[4]] for r in test] == pytest.approx(plain([r for r in rows if r[0] == m and r[1]], test).tolist(), abs=1e-7)
    assert got["untrained", 0] == 0.5


def test_no_rows(spark):
    assert grid.scored(spark.createDataFrame([], "model string, trained boolean, feat array<double>, label int")).count() == 0
