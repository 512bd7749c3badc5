"""Entity statistics, quantile bins, and comparison of two distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.ranges import quantiles, running

#: Sets that are compared with one reference, at most.
MOST_SETS = 1_000
DIGITS = 6


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the distinct interpolated quantiles of a column, as an array."""
    return quantiles(df, [], column, [i / bins for i in range(bins + 1)], "edges").select(F.array_distinct("edges").alias("edges"))


def edge_bin(x: str) -> Column:
    """The bin of a value among ``edges``: right-closed, the lowest edge in the first bin."""
    return F.greatest(F.lit(0), F.size(F.filter("edges", lambda e: e < F.col(x))) - 1)


def ranked(df: DataFrame, column: str, tie: str) -> DataFrame:
    """``df`` with ``rank``, 1-based by column and then tie (a number), and ``n``.

    A rank is a row's place in its slice of equal values plus the sizes of all slices before, so no
    window holds more than a slice of one value."""
    # ties are dealt to slices in the order of the tie column, by its own quantiles
    cuts = df.agg(F.percentile_approx(tie, [i / 32 for i in range(1, 32)], 1000).alias("cuts"))
    sliced = df.join(F.broadcast(cuts)).withColumn("slice", F.size(F.filter("cuts", lambda e: e < F.col(tie)))).drop("cuts")  # one row
    sizes = sliced.groupBy(column, "slice").agg(F.count("*").alias("size"))
    values = running(sizes.groupBy(column).agg(F.sum("size").alias("of_value")), [], column, {"up": F.col("of_value")})
    inner = F.coalesce(F.sum("size").over(Window.partitionBy(column).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 32 slices of a value
    ahead = sizes.withColumn("inner", inner).join(values, column).select(column, "slice", (F.col("up") - F.col("of_value") + F.col("inner")).alias("ahead"), F.col("all_up").alias("n"))
    within = F.row_number().over(Window.partitionBy(column, "slice").orderBy(tie))
    return sliced.withColumn("within", within).join(ahead, [column, "slice"]).withColumn("rank", F.col("ahead") + F.col("within")).drop("ahead", "within", "slice")


def rank_decile(bins: int = 10) -> Column:
    """Which of ``bins`` equal slices a rank among n falls in, right-closed, in whole numbers."""
    n = F.col("n")
    up = F.expr(f"((rank - 1) * {bins} + n - 2) div greatest(n - 1, 1)")
    return F.when(n < 2, 0).otherwise(F.greatest(F.lit(0), up - 1)).cast("int")


def entity_statistics(entities: DataFrame, degree: DataFrame) -> DataFrame:
    """entity_id, length, positive degree (0 where no pair names it), and the deciles of both.

    Length deciles lie between quantiles of the lengths; degree deciles between those of ranks, ties
    in order of the id, or of its hash if it is no number."""
    joined = entities.join(degree.select(F.col("node").alias("entity_id"), F.col("pos_degree").alias("degree")), "entity_id", "left").na.fill(0, ["degree"])
    edges = quantile_edges(joined, "length")
    placed = joined.join(F.broadcast(edges)).withColumn("length_decile", edge_bin("length")).drop("edges")
    number = dict(placed.dtypes)["entity_id"] in ("int", "bigint", "smallint")
    placed = placed.withColumn("tie", F.col("entity_id") if number else F.xxhash64("entity_id"))
    return ranked(placed, "degree", "tie").withColumn("degree_decile", rank_decile()).select("entity_id", "length", "degree", "length_decile", "degree_decile")


def occurrences(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(set_name, x): the value of either end of every pair, an end as often as pairs name it."""
    ends = pairs.select("set_name", F.explode(F.array("a", "b")).alias("entity_id"))
    return ends.join(values, "entity_id", "left").select("set_name", F.coalesce("x", F.lit(0)).alias("x"))


def describe(pooled: DataFrame) -> DataFrame:
    """Per set: count, mean, sample deviation, quartiles, least and greatest."""
    d = pooled.groupBy("set_name").agg(F.count("*").alias("n"), F.round(F.avg("x"), DIGITS).alias("mean"), F.round(F.stddev_samp("x"), DIGITS).alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))
    return d.join(quantiles(pooled, ["set_name"], "x", [0.25, 0.5, 0.75], "q"), "set_name", "left").select("set_name", "n", "mean", "sd", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high")


def ecdf(pooled: DataFrame) -> DataFrame:
    """(set_name, x, share) with the share of values up to x, from counts of each value."""
    counts = pooled.groupBy("set_name", "x").agg(F.count("*").alias("n"))
    up = running(counts, ["set_name"], "x", {"up": F.col("n")})
    return up.select("set_name", "x", F.round(F.col("up") / F.col("all_up"), DIGITS).alias("share"))


def compare(pooled: DataFrame, reference: str) -> DataFrame:
    """Every other set against one: standardized mean difference, KS and Wasserstein-1 distance.

    Values are counted first; the running shares cover only different values. At most ``MOST_SETS``
    sets, whose names the plan holds."""
    moments = pooled.groupBy("set_name").agg(F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v"))
    of_ref = moments.filter(F.col("set_name") == reference).select(F.col("m").alias("m0"), F.col("v").alias("v0"))
    counts = pooled.groupBy("set_name", "x").agg(F.count("*").alias("n"))
    others = [r["set_name"] for r in moments.filter(F.col("set_name") != reference).select("set_name").limit(MOST_SETS + 1).collect()]
    if len(others) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} sets to compare")
    names = F.array(*map(F.lit, others)) if others else F.array().cast("array<string>")
    mine = counts.filter(F.col("set_name") != reference).select("set_name", "x", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n0"))
    base = counts.filter(F.col("set_name") == reference).select(F.explode(names).alias("set_name"), "x", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n0"))
    both = mine.union(base).groupBy("set_name", "x").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    shares = running(both, ["set_name"], "x", {"up1": F.col("n1"), "up0": F.col("n0")})
    at = shares.select("set_name", "x", F.abs(F.col("up1") / F.col("all_up1") - F.col("up0") / F.col("all_up0")).alias("gap"))
    steps = running(at, ["set_name"], "x", least={"next": F.col("x")}, descending=True)
    distances = steps.groupBy("set_name").agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce(F.col("next") - F.col("x"), F.lit(0))).alias("w1"))
    pooled_sd = F.sqrt((F.col("v") + F.col("v0")) / 2)
    smd = F.coalesce(F.try_divide(F.col("m0") - F.col("m"), pooled_sd), F.lit(0.0))
    out = distances.join(moments, "set_name").join(F.broadcast(of_ref))  # one row of the reference
    return out.select("set_name", F.round("m0", DIGITS).alias("mean_reference"), F.round("m", DIGITS).alias("mean"), F.round(smd, DIGITS).alias("smd"), F.round("ks", DIGITS).alias("ks"), F.round("w1", DIGITS).alias("w1"), (F.abs(smd) < 0.1).alias("balanced"), (F.abs(smd) > 0.25).alias("imbalanced"))
