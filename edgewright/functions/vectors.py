"""Order-invariant features of pairs from the vectors or numbers of both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _each(x: str | Column, y: str | Column, how) -> Column:
    return F.zip_with(x, y, how)


def add(x: str, y: str) -> Column:
    return _each(x, y, lambda p, q: p + q)


def difference(x: str, y: str) -> Column:
    return _each(x, y, lambda p, q: F.abs(p - q))


def product(x: str, y: str) -> Column:
    return _each(x, y, lambda p, q: p * q)


#: By name; only ``joined`` depends on the order of the ends.
FUSIONS = {
    "sum": add,
    "abs_diff": difference,
    "product": product,
    "diff_product": lambda x, y: F.concat(difference(x, y), product(x, y)),
    "combined": lambda x, y: F.concat(add(x, y), difference(x, y), product(x, y)),
    "joined": lambda x, y: F.concat(F.col(x), F.col(y)),
}


def fuse(pairs: DataFrame, vectors: DataFrame, kind: str = "combined") -> DataFrame:
    """``pairs`` with ``feat``; ``vectors`` are (entity, v). Features are made once an entity, not a pair."""
    left, right = (vectors.select(F.col("entity").alias(x), F.col("v").alias(f"v_{x}")) for x in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").withColumn("feat", FUSIONS[kind]("v_a", "v_b")).drop("v_a", "v_b")


def scalar_features(x: Column, y: Column) -> list[Column]:
    """Sum, absolute difference, least and greatest of a number of both ends."""
    return [(x + y).alias("total"), F.abs(x - y).alias("gap"), F.least(x, y).alias("low"), F.greatest(x, y).alias("high")]


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def weighted_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, place, x): each component's mean over rows (*keys, weight, v), such as the chunks of one
    sequence by their lengths; sums are partial before the shuffle."""
    each = rows.select(*keys, "weight", F.posexplode("v").alias("place", "x"))
    return each.groupBy(*keys, "place").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))


def overlaid(vectors: DataFrame, other: DataFrame) -> DataFrame:
    """``vectors`` (entity, v) with those of ``other`` in place of theirs where it has one."""
    joined = vectors.join(other.select("entity", F.col("v").alias("over")), "entity", "left")
    return joined.select("entity", F.coalesce("over", "v").alias("v"), F.col("over").isNotNull().alias("replaced"))
