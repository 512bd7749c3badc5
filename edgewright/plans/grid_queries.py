"""Studies of many small models, all fitted together."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions import vectors
from edgewright.operators import grid, metrics, negatives, splits
from edgewright.operators.ranges import checkpointed
from edgewright.plans import split_queries, study_queries
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

#: Set name to the stratum that its negatives are drawn from.
SETS = {"N1": "random", "N2": "degree", "N5": "degree_length"}


def _with_features(spark, sf_dir, rows, pairs):
    """``rows`` (a, b, ...) with a row for each representation: scalars of length, of degree, or of both."""
    s = study_queries._scalars(spark, sf_dir, pairs)
    x, y = (s.toDF(k, f"d_{k}", f"l_{k}") for k in ("a", "b"))
    length, degree = (list(vectors.scalar_features(F.col(f"{n}_a").cast("double"), F.col(f"{n}_b").cast("double"))) for n in ("l", "d"))
    kinds = F.array(*[F.struct(F.lit(n).alias("representation"), F.array(*c).alias("feat")) for n, c in (("both", length + degree), ("degree", degree), ("length", length))])
    return rows.join(x, "a").join(y, "b").select(*rows.columns, F.inline(kinds))


def _areas(rows, keys):
    """The area of each model (regime, set_name, representation) over its test rows."""
    named = rows.withColumn("model", F.concat_ws(" ", *keys)).select("model", (F.col("side") == "train").alias("trained"), "feat", "label")
    found = grid.scored(named).select(F.col("model").alias("grp"), F.col("label").alias("y"), "p")
    return metrics.roc_auc(found)


@query("consistent_negatives")
def consistent_negatives(spark, sf_dir):
    """R0 and R3 with each set of negatives on both sides, by three representations: eighteen models in one pass."""
    plain = checkpointed(t.part_pairs(spark, sf_dir))
    pairs, strata = plain.withColumn("label", F.lit(1)), {kind: split_queries.strata(spark, sf_dir, kind, plain) for kind in SETS.values()}
    pooled = splits.pools(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("grp")))

    def sets(positives, candidates):
        made = [negatives.matched(positives, strata[kind], name, candidates=candidates) for name, kind in SETS.items()]
        return made[0].union(made[1]).union(made[2])

    built = checkpointed(splits.datasets(pairs, pooled, sets))
    every = F.explode(F.array(*map(F.lit, SETS))).alias("set_name")
    rows = built.filter("set_name <> 'positives'").union(built.filter("set_name = 'positives'").drop("set_name").select("regime", every, "side", "a", "b", "label"))
    return _areas(_with_features(spark, sf_dir, rows, plain), ["regime", "set_name", "representation"])


@query("novelty_curve")
def novelty_curve(spark, sf_dir):
    """Random negatives split as their positives are, over R0 to R3: the area of each regime and representation."""
    positives = checkpointed(t.part_pairs(spark, sf_dir))
    made = negatives.matched(positives, split_queries.strata(spark, sf_dir, "random", positives), "N1").select("a", "b").withColumn("label", F.lit(0))
    pairs = checkpointed(positives.withColumn("label", F.lit(1)).union(made))
    pooled = splits.pools(t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("grp")))
    rows = splits.random_split(pairs).union(splits.novelty(pairs, pooled))
    return _areas(_with_features(spark, sf_dir, rows, positives), ["regime", "representation"])
