"""Exact counts against sorts, and the greedy holdout against a walk."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgewright.operators import selection, splits


def md5(*keys):
    return hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()


@pytest.mark.parametrize(("ranked", "share"), [(1 << 16, 0.2), (4, 0.37), (1, 0.5), (2, 1.0), (2, 0.0)])
def test_first_of_groups(spark, monkeypatch, ranked, share):
    monkeypatch.setattr(selection, "RANKED", ranked)
    monkeypatch.setattr(selection, "DIGITS", 1)
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), md5(i if i % 7 else 0)) for i in range(400)]  # some tickets are equal
    got = selection.first(spark.createDataFrame(rows, "id int, grp string, ticket string"), ["grp"], "ticket", ["id"], share)
    assert got.columns == ["id", "grp", "ticket", "chosen"] and got.count() == len(rows)
    expected = set()
    for g in ("x", "y", None):
        mine = sorted((t, i) for i, x, t in rows if x == g)
        expected |= {i for _, i in mine[: round(len(mine) * share)]}
    assert {r["id"] for r in got.filter("chosen").collect()} == expected


def test_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANKED", 8)
    rows = spark.range(100).withColumn("ticket", F.md5(F.col("id").cast("string")))
    for count in (0, 1, 50, 100, 500):
        assert selection.first(rows, [], "ticket", ["id"], count=count).filter("chosen").count() == min(count, 100)
    assert selection.first(rows.limit(0), [], "ticket", ["id"], 0.5).count() == 0


def walk(pairs, share, seed=42):
    degree = Counter(x for p in pairs for x in p)
    target, held = round(len(pairs) * share), set()
    for a, b in sorted(pairs, key=lambda p: (md5(seed, *p), *p)):
        if len(held) >= target:
            break
        if degree[a] > 1 and degree[b] > 1:
            degree[a] -= 1
            degree[b] -= 1
            held.add((a, b))
    return held


@pytest.mark.parametrize(("kind", "share"), [("sparse", 0.2), ("sparse", 0.95), ("path", 0.9), ("star", 0.5), ("dense", 1.0), ("trees", 0.8)])
def test_greedy_holdout(spark, kind, share):
    rng = random.Random(kind)
    if kind == "path":
        pairs = {(i, i + 1) for i in range(150)}
    elif kind == "star":
        pairs = {(0, i) for i in range(1, 60)} | {(1, 2), (3, 4)}
    elif kind == "trees":
        pairs = {(rng.randrange(i), i) for i in range(1, 200)}
    else:
        n = 30 if kind == "dense" else 150
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(250)}
    found = splits.greedy_holdout(spark.createDataFrame([(a, b, 1) for a, b in pairs], "a int, b int, label int"), share).collect()
    assert len(found) == len(pairs)
    assert {(r["a"], r["b"]) for r in found if r["side"] == "test"} == walk(sorted(pairs), share)


def test_greedy_holdout_of_nothing(spark):
    assert splits.greedy_holdout(spark.createDataFrame([], "a int, b int, label int")).count() == 0
