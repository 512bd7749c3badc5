"""Checks and canonical form of labelled undirected pairs (a, b, label, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The letters of a standard sequence.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


def swapped(pairs: DataFrame) -> DataFrame:
    """Each pair with its lesser end first; ``reordered`` tells which were turned."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label", "ord", (F.col("a") > F.col("b")).alias("reordered"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """The canonical pairs (a, b) that carry both labels."""
    both = swapped(pairs.filter("a <> b")).groupBy("a", "b").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return both.filter("low <> high").select("a", "b")


def canonical(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b; self-pairs and all copies of pairs in conflict go.

    After conflicts go, all copies of a pair carry one label, so one aggregate gives it."""
    both = swapped(pairs.filter("a <> b")).groupBy("a", "b").agg(F.min("label").alias("label"), F.max("label").alias("high"), F.min("ord").alias("ord"))
    return both.filter(F.col("label") == F.col("high")).drop("high")


def issue_counts(pairs: DataFrame) -> DataFrame:
    """One row of counts: what canonicalizing finds and removes.

    Rows that repeat an ordered pair count as exact duplicates, further ones as reversed."""
    real = pairs.filter("a <> b")
    exact = real.groupBy("a", "b", "label").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    ordered = exact.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = ordered.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.sum("n").alias("n"), F.count("*").alias("orders"), F.sum(F.when(F.col("a") > F.col("b"), F.col("n")).otherwise(0)).alias("turned"), F.min("low").alias("low"), F.max("high").alias("high"))
    clash = F.col("low") != F.col("high")
    found = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("turned"), F.lit(0)).alias("reordered"),
        F.coalesce(F.sum(F.col("n") - F.col("orders")), F.lit(0)).alias("exact_duplicates"),
        F.coalesce(F.sum(F.col("orders") - 1), F.lit(0)).alias("reversed_duplicates"),
        F.count_if(clash).alias("conflict_pairs"),
        F.coalesce(F.sum(F.when(clash, F.col("n"))), F.lit(0)).alias("conflict_rows"),
        F.coalesce(F.sum(F.when(~clash, F.col("n") - 1)), F.lit(0)).alias("duplicates_removed"),
        F.count_if(~clash).alias("canonical_pairs"),
    )
    loops = pairs.agg(F.count_if(F.col("a") == F.col("b")).alias("self_pairs"))
    return found.join(loops)  # one row each


def copies(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Every row whose keys another row shares, with how many do; keys are counted before rows are joined."""
    named = {f"_k{i}": F.struct(k) for i, k in enumerate(keys)}  # a null is a key too
    keyed = df.withColumns(named)
    counts = keyed.groupBy(*named).agg(F.count("*").alias("copies")).filter("copies > 1")
    return keyed.join(counts, [*named]).select(*df.columns, "copies")


def reverse_or_exact_duplicates(pairs: DataFrame) -> DataFrame:
    return copies(pairs, [F.least("a", "b"), F.greatest("a", "b")])


def dangling(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """The ends of pairs that are no ``entity_id``."""
    ends = pairs.select(F.col("a").alias("entity_id")).union(pairs.select("b")).distinct()
    return ends.join(entities.select("entity_id"), "entity_id", "left_anti")


def checked_labels(pairs: DataFrame) -> DataFrame:
    """``pairs``, whose reading fails on a label other than 0 and 1."""
    fine = F.col("label").isin(0, 1)
    return pairs.withColumn("label", F.when(fine, F.col("label")).otherwise(F.raise_error(F.lit("labels must be 0 or 1"))))


def sequence_checks(entities: DataFrame) -> DataFrame:
    """Per entity: whether its sequence is missing, and how many letters are not of the alphabet."""
    bad = F.length(F.regexp_replace("seq", f"[{ALPHABET}]", ""))
    return entities.select("entity_id", (F.coalesce(F.length("seq"), F.lit(0)) == 0).alias("missing"), F.coalesce(bad, F.lit(0)).alias("nonstandard"))


def sequence_groups(entities: DataFrame) -> DataFrame:
    """entity_id, sequence_hash and a dense group id in order of the hash.

    The rank runs over distinct hashes, which are ranked within ranges that are counted first, so no
    window holds them all."""
    hashed = entities.select("entity_id", F.sha2(F.col("seq").cast("binary"), 256).alias("sequence_hash"))
    distinct = hashed.select("sequence_hash").distinct().withColumn("range", F.substring("sequence_hash", 1, 3))
    sizes = distinct.groupBy("range").count().withColumn("ahead", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("range").orderBy("sequence_hash"))
    ids = distinct.withColumn("within", within).join(F.broadcast(sizes), "range").select("sequence_hash", (F.col("ahead") + F.col("within") - 1).alias("sequence_group_id"))
    return hashed.join(ids, "sequence_hash")


def group_sizes(groups: DataFrame) -> DataFrame:
    """One row: groups, groups of several, and their members."""
    size = groups.groupBy("sequence_group_id").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return size.agg(F.count("*").alias("n_groups"), F.count_if(many).alias("n_shared"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("members_shared"), F.max("n").alias("largest"))
