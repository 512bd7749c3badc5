"""Bootstraps over components: draws made many at once, and weights against copied rows."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from edgewright.functions import draws
from edgewright.operators import inference
from edgewright.sources import tables


def test_many_draws_are_those_of_the_column(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 64)
    for n, first, end in ((7, 0, 1150), (1_000_003, 99_950, 100_050), (5, (1 << 32) - 9, (1 << 32) + 9)):
        rows = spark.range(first, end, 1, 1).select(draws.below(F.lit(n), 42, F.lit(17), "id").alias("x")).collect()
        assert draws.below_each(n, 42, 17, first, end).tolist() == [r["x"] for r in rows]


@pytest.mark.parametrize("small", [False, True])
def test_bytes_are_the_draws(spark, monkeypatch, small):
    if small:
        for name, value in (("RANGE", 6), ("SHARD", 3), ("AT_ONCE", 5)):
            monkeypatch.setattr(inference, name, value)
    components = spark.createDataFrame([(3 * i,) for i in range(20)] * 2, "component int")
    want = {(r["component"], r["replicate"]): r["times"] for r in inference.multiplicities(components, 15).collect()}
    rows = inference.times_drawn(components, 15).collect()
    assert len(rows) == 20
    assert {(r["component"], i): t for r in rows for i, t in enumerate(r["times"]) if t} == want


def plain_auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return round(sum((x > z) + (x == z) / 2 for x in pos for z in neg) / len(pos) / len(neg), 6) if pos and neg else None


@pytest.mark.parametrize("small", [False, True])
def test_replicates_are_copies_of_components(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD", 4), ("ROWS", 3), ("ENTRIES", 4), ("SCORES", 2), ("HELD", 2)):
            monkeypatch.setattr(inference, name, value)
    rng = random.Random(4)
    rows = [(c, rng.randrange(2), rng.choice([0.1, 0.2, 0.5, 0.7])) for c in range(15) for _ in range(rng.choice([1, 2, 9]))]
    table = spark.createDataFrame(rows, "component int, y int, p double")
    times = {(r["replicate"], r["component"]): r["times"] for r in inference.multiplicities(table, 10).collect()}
    copied = [[(y, p) for c, y, p in rows for _ in range(times.get((i, c), 0))] for i in range(10)]
    first, second = inference.bootstrap_pair(table, table.withColumn("p", 1 - F.col("p") * F.col("p")), 10)
    assert {r["replicate"]: r["roc_auc"] for r in first.collect()} == {i: plain_auc(x) for i, x in enumerate(copied)}
    assert {r["replicate"]: r["roc_auc"] for r in second.collect()} == {i: plain_auc([(y, 1 - p * p) for y, p in x]) for i, x in enumerate(copied)}
    sided = table.select("component", F.col("y").alias("side"), F.col("p").alias("x"))
    for r in inference.weighted_mean_bootstrap(sided, 10).collect():
        one, zero = ([p for y, p in copied[r["replicate"]] if y == s] for s in (1, 0))
        assert r["difference"] == pytest.approx(sum(one) / len(one) - sum(zero) / len(zero), abs=1e-6)


def test_no_components(spark):
    none = spark.createDataFrame([], "component int, y int, p double")
    assert not inference.bootstrap(none, 5).collect()
    assert not inference.weighted_mean_bootstrap(none.select("component", F.col("y").alias("side"), F.col("p").alias("x")), 5).collect()


@pytest.mark.parametrize("sent", [1 << 17, 0])
def test_part_pairs_of_any_number_of_items(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(tables, "_SENT", sent)
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), f"1995-01-0{rng.randrange(1, 5)}", rng.randrange(1, 8), rng.choice([*range(20), None])) for _ in range(150)]
    rows += [(9, "1995-02-01", 1, p) for p in (4, 4, 4)] + [(9, "1995-02-01", 2, p) for p in (4, 5, 4, 5)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate string, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"WITH {tables.PART_PAIRS_SQL} SELECT a, b FROM edges").fetchall()
    got = [tuple(r) for r in tables.part_pairs(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (4, 5) in got
