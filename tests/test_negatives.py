"""Control negatives: complements and nearest free degrees against plain searches over all entities."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from edgewright.operators import negatives


def graph(rng, n, pairs):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(pairs)})


def kept_end(r):
    """The end of the positive that the negative has; both only if the negative is odd."""
    return {r["a"], r["b"]} & {r["of_a"], r["of_b"]}


def test_numbers_of_clusters_follow_each_other(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.choice(["p", "q", "r", None])) for i in range(200)]
    got = negatives.numbered(spark.createDataFrame(rows, "entity int, stratum int, cluster string")).collect()
    for s in range(3):
        mine = sorted((r for r in got if r["stratum"] == s), key=lambda r: r["number"])
        assert [r["number"] for r in mine] == list(range(len(mine))) and {r["size"] for r in mine} == {len(mine)}
        for c in ("p", "q", "r", None):
            numbers = [r["number"] for r in mine if r["cluster"] == c]
            assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
            assert {(r["cluster_start"], r["cluster_size"]) for r in mine if r["cluster"] == c} == {(numbers[0], len(numbers))}


@pytest.mark.parametrize("cluster", [False, True])
def test_all_that_can_be_served_are(spark, cluster):
    """No draws at all: every negative comes from a complement, and who has none has no free entity left."""
    rng = random.Random(6)
    positives = graph(rng, 16, 70)
    stratum, group = {i: i % 2 for i in range(16)}, {i: rng.choice("pqr") for i in range(16)}
    pairs = spark.createDataFrame(positives, "a int, b int")
    entities = spark.createDataFrame([(i, stratum[i], group[i]) for i in range(16)], "entity int, stratum int, cluster string")
    rows = negatives.matched(pairs, entities, "set", exclude_cluster=cluster, rounds=0).collect()
    made = {(r["a"], r["b"]) for r in rows}
    assert len(made) == len(rows) and not made & set(positives)
    for r in rows:
        (x,) = kept_end(r)
        (u,) = {r["a"], r["b"]} - {x}
        (old,) = {r["of_a"], r["of_b"]} - {x}
        assert stratum[u] == stratum[old] and (not cluster or group[u] != group[x])
    sides = {(r["a"], r["b"]): r["keep_a"] for r in pairs.withColumn("keep_a", negatives.below(F.lit(2), negatives.SEED, F.lit("side"), "a", "b") == 0).collect()}
    served, open_ = {(r["of_a"], r["of_b"]) for r in rows}, {}
    for a, b in set(positives) - served:
        x, old = (a, b) if sides[a, b] else (b, a)
        open_[stratum[old]] = open_.get(stratum[old], 0) + 1
        free = [u for u in range(16) if stratum[u] == stratum[old] and u != x and tuple(sorted((x, u))) not in made | set(positives) and (not cluster or group[u] != group[x])]
        assert not free
    count = negatives.exhausted(pairs, entities, "set", exclude_cluster=cluster, rounds=0).collect()
    assert {r["stratum"]: r["positives"] for r in count} == open_ and open_


def test_two_sided_sets_finish_by_search(spark):
    positives = [(a, b) for a in range(12) for b in range(12, 24) if (a, b) not in {(0, 12), (3, 20), (7, 15)}]
    entities = spark.createDataFrame([(i, i // 12) for i in range(24)], "entity int, stratum int")
    rows = negatives.matched(spark.createDataFrame(positives, "a int, b int"), entities, "set", both=True, draws=1, rounds=1).collect()
    assert {(r["a"], r["b"]) for r in rows} == {(0, 12), (3, 20), (7, 15)}


@pytest.mark.parametrize("caliper", [None, 2])
def test_no_nearer_degree_is_free(spark, caliper):
    rng = random.Random(8)
    positives = graph(rng, 30, 60)
    degree = {i: rng.choice([1, 2, 2, 3, 5, 6, 9, 14]) for i in range(30)}
    rows = negatives.nearest(spark.createDataFrame(positives, "a int, b int"), spark.createDataFrame(list(degree.items()), "entity int, stratum int"), "set", caliper).collect()
    made = {(r["a"], r["b"]) for r in rows}
    assert len(made) == len(rows) > 30 and not made & set(positives)
    for r in rows:
        (x,) = kept_end(r)
        (u,) = {r["a"], r["b"]} - {x}
        (old,) = {r["of_a"], r["of_b"]} - {x}
        far = abs(degree[u] - degree[old])
        assert caliper is None or far <= caliper
        nearer = [v for v in range(30) if v != x and abs(degree[v] - degree[old]) < far and tuple(sorted((x, v))) not in made | set(positives)]
        assert not nearer


def test_many_degrees(spark):
    """More degrees than any array should hold, and a hub that is linked to all entities near its own."""
    positives = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    known = positives.union(spark.range(5000, 5001).select("id", F.col("id") + 1))
    entities = spark.range(12_000).select(F.col("id").alias("entity"), F.expr("CASE WHEN id < 1000 THEN id div 500 ELSE id * 3 END").alias("stratum"))
    rows = negatives.nearest(known, entities, "set").collect()
    hub = [r for r in rows if r["a"] == 0]
    assert len(hub) > 100 and all(400 <= r["b"] < 1000 for r in hub)  # the nearest that are free
    (other,) = [r for r in rows if r["of_a"] == 5000]
    assert {other["a"], other["b"]} in ({4999, 5001}, {5000, 5002}, {5000, 5000 + 2})


def test_reuse_is_told(spark):
    rows = [("s", 0, i, 0, i, i + 100) for i in range(1, 30)] + [("t", i, i + 50, 0, i, 99 + i) for i in range(1, 30)]
    made = spark.createDataFrame(rows, "set_name string, a int, b int, label int, of_a int, of_b int")
    got = {r["set_name"]: r for r in negatives.reuse(made, made).collect()}
    assert got["s"]["over_reused"] and got["s"]["most"] == 29 and got["t"]["over_reused"] == (1 / 29 > negatives.REUSE)


def test_first_draws_are_made_alone(spark, monkeypatch):
    """Further draws are made for the positives whose first draw is bad, and blocks of seeds leave nothing behind."""
    rng = random.Random(9)
    positives = graph(rng, 60, 120)
    pairs, entities = spark.createDataFrame(positives, "a int, b int"), spark.createDataFrame([(i, i % 2) for i in range(60)], "entity int, stratum int")
    asked, plain = [], negatives._Sets.tries
    monkeypatch.setattr(negatives._Sets, "tries", lambda self, ready, start, end, salt: (asked.append((end - start, ready.count())), plain(self, ready, start, end, salt))[1])
    whole = sorted(tuple(r) for r in negatives.swept(pairs, entities, "set", [5, 6]).collect())
    n = 2 * len(positives)
    assert asked[0] == (1, n) and asked[1][0] == 15 and asked[1][1] < n / 2
    monkeypatch.setattr(negatives, "SWEPT", 130)
    home = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    assert sorted(tuple(r) for r in negatives.swept(pairs, entities, "set", [5, 6]).collect()) == whole and len(whole) == n
    assert spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0] == home
    assert not list(Path(home.removeprefix("file:"), "scratch").iterdir())
