"""Categories of entities (such as a species), and accounting of pairs by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_source(columns: dict[str, Column]) -> tuple[Column, Column]:
    """The first category that is not null by priority, and the name of its source."""
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in columns.items()])
    return F.coalesce(*columns.values()), source


def imputed(entities: DataFrame) -> DataFrame:
    """(entity_id, seq, category): a missing category comes from entities of equal sequence, where
    these agree on exactly one."""
    peers = entities.filter("category IS NOT NULL").groupBy("seq").agg(F.min("category").alias("low"), F.max("category").alias("high"))
    only = peers.filter(F.col("low") == F.col("high")).select("seq", F.col("low").alias("peer"))
    joined = entities.join(only, "seq", "left")
    return joined.select("entity_id", F.coalesce("category", "peer").alias("category"), (F.col("category").isNull() & F.col("peer").isNotNull()).alias("imputed"))


def pair_categories(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """Pairs with ``kind``: the category that both ends share, different, or unresolved."""
    left, right = (categories.select(F.col("entity_id").alias(x), F.col("category").alias(f"of_{x}")) for x in ("a", "b"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    kind = F.when(F.col("of_a").isNull() | F.col("of_b").isNull(), "unresolved").when(F.col("of_a") == F.col("of_b"), F.col("of_a")).otherwise("different")
    return joined.withColumn("kind", kind)


def by_label(kinds: DataFrame) -> DataFrame:
    """(kind, label_0, label_1): pairs of each kind and label."""
    return kinds.groupBy("kind").pivot("label", [0, 1]).count().na.fill(0).select("kind", F.col("0").alias("label_0"), F.col("1").alias("label_1"))


def same_category_scores(kinds: DataFrame) -> DataFrame:
    """Resolved pairs scored 1 if both ends share a category: (grp, y, p)."""
    return kinds.filter("kind <> 'unresolved'").select(F.lit("all").alias("grp"), F.col("label").alias("y"), (F.col("kind") != "different").cast("double").alias("p"))
