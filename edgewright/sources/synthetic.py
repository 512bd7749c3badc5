"""Made-up entities and labelled pairs, for a demonstration without files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions.draws import below, ticket, uniform

#: Letters that stand for the sixteen digits of a hash.
_LETTERS = "ACDEFGHIKLMNPQRS"


def entities(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(entity_id, seq): chains of 64 to 512 letters; every twentieth repeats another's."""
    number = F.when(F.col("id") % 20 == 19, F.col("id") - 1).otherwise(F.col("id"))
    rows = spark.range(n).withColumn("number", number)
    pieces = F.transform(F.sequence(F.lit(1), below(F.lit(15), seed, F.lit("length"), "number").cast("int") + 2), lambda k: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("number").cast("string"), k.cast("string"))))
    return rows.select(F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("entity_id"), F.translate(F.array_join(pieces, ""), "0123456789abcdef", _LETTERS).alias("seq"))


def pairs(spark: SparkSession, n: int, many: int, seed: int = 42) -> DataFrame:
    """(a, b, label): ``many`` positives, denser among low numbers, as many negatives, and what an audit
    finds: copies, reversed copies, self-pairs and conflicting labels, one in fifty each."""
    name = lambda c: F.concat(F.lit("P"), F.lpad(c.cast("long").cast("string"), 7, "0"))
    skewed = lambda salt: F.floor(F.pow(uniform(seed, F.lit(salt), "id"), F.lit(1.7)) * n)
    drawn = spark.range(2 * many).withColumn("label", (F.col("id") < many).cast("int"))
    even = lambda salt: below(F.lit(n), seed, F.lit(salt), "id")
    end = lambda salt: F.when(F.col("label") == 1, skewed(salt)).otherwise(even(salt))
    clean = drawn.select("id", name(end("a")).alias("a"), name(end("b")).alias("b"), "label")
    turn = F.conv(F.substring(ticket(seed, F.lit("fault"), "id"), 1, 4), 16, 10).cast("int") % 50
    fault = F.when(turn == 0, F.array(F.struct("a", "b", "label"))).when(turn == 1, F.array(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "label"))).when(turn == 2, F.array(F.struct("a", F.col("a").alias("b"), "label"))).when(turn == 3, F.array(F.struct("a", "b", (1 - F.col("label")).alias("label"))))
    return clean.select("a", "b", "label").union(clean.select(F.inline(fault)))
