"""Pairs, entities and scores derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.operators.ranges import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labelled pairs (a, b, label, ord): users of events that follow each other by id.

    A dirty table: it has self-pairs, reversed pairs, duplicates and label conflicts. The step to the
    next event is an equi-join on the id, not a window over all rows."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type")
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("user").alias("a"), F.col("event_type").alias("type_before"))
    return before.join(e, "event_id").select("a", F.col("user").alias("b"), (F.col("event_type") == F.col("type_before")).cast("int").alias("label"), F.col("event_id").alias("ord"))


#: What two line items share if their parts are a pair: all items take part, and components are many.
_SHARED = ["l_suppkey", "l_shipdate", "l_linenumber"]


#: Keys of many items that are sent to all tasks; more are joined by a shuffle.
_SENT = 1 << 17


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part pairs (a, b), a < b, that one supplier shipped on one day as line of one number.

    Most keys have one item and most others two, whose pair is the least and the greatest part: one
    aggregate tells both. Only items of the keys that have more are met with each other."""
    items = table(spark, sf_dir, "lineitem").select(*_SHARED, "l_partkey").na.drop()
    keys = checkpointed(items.groupBy(*_SHARED).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.count("*").alias("n")).filter("a < b"))
    many = keys.filter("n > 2").select(*_SHARED)
    several = items.join(F.broadcast(many) if many.count() <= _SENT else many, _SHARED, "left_semi").distinct()
    met = several.join(several.withColumnRenamed("l_partkey", "b"), _SHARED).filter(F.col("l_partkey") < F.col("b")).select(F.col("l_partkey").alias("a"), "b")
    return keys.filter("n = 2").select("a", "b").union(met).distinct()


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities (entity_id, seq): documents, in ASCII upper case."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), F.translate("text", lower, upper).alias("seq"))


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored binary outcomes (grp, y, p): returned lineitems, scored by discount, with heavy ties."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 8 + F.col("l_tax")).alias("p"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored part pairs (a, b, y, p): whether both parts share a manufacturer digit, by size difference."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.substring("p_brand", 1, 7).alias("maker"))
    pairs = part_pairs(spark, sf_dir)
    left, right = (part.toDF(k, f"size_{k}", f"maker_{k}") for k in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("maker_a") == F.col("maker_b")).cast("int").alias("y"), (1 / (1 + F.abs(F.col("size_a") - F.col("size_b")))).alias("p"))


# The same derivations as DuckDB SQL, for oracles.
EVENT_PAIRS_SQL = """raw AS (
  SELECT x.user_id::VARCHAR AS a, y.user_id::VARCHAR AS b, (x.event_type = y.event_type)::INTEGER AS label, y.event_id AS ord
  FROM events x JOIN events y ON y.event_id = x.event_id + 1
)"""
SCORED_ITEMS_SQL = """scored AS (
  SELECT l_linestatus AS grp, (l_returnflag = 'R')::INTEGER AS y, l_discount * 8 + l_tax AS p FROM lineitem
)"""


PART_PAIRS_SQL = f"""items AS (
  SELECT DISTINCT {', '.join(_SHARED)}, l_partkey FROM lineitem
), edges AS (
  SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM items x JOIN items y USING ({', '.join(_SHARED)}) WHERE x.l_partkey < y.l_partkey
)"""
SCORED_PAIRS_SQL = PART_PAIRS_SQL + """, scored AS (
  SELECT a, b, (substr(x.p_brand, 1, 7) = substr(y.p_brand, 1, 7))::INTEGER AS y, 1 / (1 + abs(x.p_size - y.p_size)) AS p
  FROM edges JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b
)"""
SEQUENCES_SQL = """seqs AS (
  SELECT doc_id AS entity_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM documents
)"""
