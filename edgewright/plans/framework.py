"""The full run: from audited pairs to scores, control sets, uncertainty and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions import vectors as fusion
from edgewright.functions.draws import uniform
from edgewright.operators import graph, inference, metrics, models, negatives, splits, stats
from edgewright.operators.ranges import checkpointed

#: Control sets, and the columns of entity statistics that make their strata.
CONTROLS = {"N1": (), "N2": ("degree_decile",), "N3": ("length_decile",), "N5": ("degree_decile", "length_decile")}


def control_sets(positives: DataFrame, statistics: DataFrame, seed: int) -> DataFrame:
    """(set_name, a, b, label, of_a, of_b) of all control sets, and the nearest-degree one."""
    out = None
    for name, columns in CONTROLS.items():
        stratum = sum((F.col(c) * 10**i for i, c in enumerate(columns)), F.lit(0))
        made = negatives.matched(positives, statistics.select(F.col("entity_id").alias("entity"), stratum.cast("long").alias("stratum")), name, seed=seed)
        out = made if out is None else out.union(made)
    near = negatives.nearest(positives, statistics.select(F.col("entity_id").alias("entity"), F.col("degree").cast("long").alias("stratum")), "N2_nearest", seed=seed)
    return checkpointed(out.union(near))


def predictions(regimes: DataFrame, vectors: DataFrame, kind: str = "lr") -> DataFrame:
    """(regime, a, b, y, p): each regime's test pairs, by a model of its training pairs."""
    fused = checkpointed(fusion.fuse(regimes, vectors))
    out = None
    for regime in sorted(r["regime"] for r in fused.select("regime").distinct().collect()):
        mine = fused.filter(F.col("regime") == regime)
        sides = {r["side"]: r["classes"] for r in mine.groupBy("side").agg(F.count_distinct("label").alias("classes")).collect()}
        if sides.get("train") != 2 or "test" not in sides:
            continue  # nothing to learn from, or nothing to test
        scored = models.fit_predict(mine.filter("side = 'train'"), mine.filter("side = 'test'"), kind)
        some = scored.select("regime", "a", "b", F.col("label").alias("y"), "p")
        out = some if out is None else out.union(some)
    if out is None:
        raise ValueError("no regime has pairs of both labels to train on and pairs to test")
    return checkpointed(out)


def control_regimes(positives: DataFrame, controls: DataFrame, share: float, seed: int) -> DataFrame:
    """Each control set with the positives as a regime of its own, drawn to sides pair by pair."""
    names = controls.select(F.col("set_name").alias("regime")).distinct()
    rows = positives.select("a", "b", F.lit(1).alias("label")).join(F.broadcast(names)).select("regime", "a", "b", "label")  # a name for each set
    rows = rows.union(controls.select("set_name", "a", "b", F.lit(0)))
    return rows.withColumn("side", F.when(uniform(seed, "label", "a", "b") < share, "test").otherwise("train"))


def scores(scored: DataFrame) -> DataFrame:
    """All metrics of each regime."""
    rows = scored.select(F.col("regime").alias("grp"), "y", "p")
    found = metrics.confusion(rows).join(metrics.roc_auc(rows), "grp").join(metrics.average_precision(rows), "grp").join(metrics.ece_width(rows).select("grp", "ece"), "grp").join(metrics.prevalence(rows), "grp")
    return found.withColumnRenamed("grp", "regime")


def uncertainty(scored: DataFrame, replicates: int) -> DataFrame:
    """Per regime: the area with both intervals, by bootstrap and by jackknife over components of the
    tested graph, and p-values adjusted over regimes."""
    labels = graph.components(scored.select("a", "b")).withColumnRenamed("node", "a")
    placed, out = checkpointed(scored.join(labels, "a").select("regime", "component", "y", "p")), None
    for regime in sorted(r["regime"] for r in placed.select("regime").distinct().collect()):
        rows = placed.filter(F.col("regime") == regime).select("component", "y", "p")
        boot = inference.interval(inference.bootstrap(rows, replicates)).select("valid", F.col("low").alias("boot_low"), F.col("high").alias("boot_high"), F.col("p_value").alias("boot_p"))
        jack = inference.jackknife(rows).withColumn("t", inference.t_interval("full_auc", "variance", "components"))
        one = jack.select(F.lit(regime).alias("regime"), "components", "full_auc", F.col("t.low").alias("low"), F.col("t.high").alias("high"), F.col("t.p_value").alias("p_value")).join(boot)  # one row each
        out = one if out is None else out.union(one)
    out = checkpointed(out)
    tests = out.select(F.lit("jackknife").alias("family"), F.col("regime").alias("test"), F.col("p_value").alias("p"))
    return out.join(inference.adjusted(tests).select(F.col("test").alias("regime"), "p_adj", "reject"), "regime")


def balance(positives: DataFrame, controls: DataFrame, degree: DataFrame) -> DataFrame:
    """Degrees at the ends of each control set against those of positives, and how often decoys repeat."""
    pooled = positives.select(F.lit("positives").alias("set_name"), "a", "b").union(controls.select("set_name", "a", "b"))
    values = degree.select(F.col("node").alias("entity_id"), F.col("pos_degree").alias("x"))
    return stats.compare(stats.occurrences(pooled, values), "positives").join(negatives.reuse(controls, positives), "set_name")


def with_negatives(pairs: DataFrame, statistics: DataFrame, seed: int) -> DataFrame:
    """The pairs as they are if some have label 0, else with random negatives (N0 is N1 then)."""
    if not pairs.filter("label = 0").isEmpty():
        return pairs
    positives = pairs.select("a", "b")
    entities = statistics.select(F.col("entity_id").alias("entity"), F.lit(0).cast("long").alias("stratum"))
    return pairs.union(negatives.matched(positives, entities, "N1", seed=seed).select("a", "b", "label"))


def regimes(pairs: DataFrame, groups: DataFrame, clusters: DataFrame | None, seed: int) -> DataFrame:
    found = splits.random_split(pairs, seed=seed).union(splits.novelty(pairs, splits.pools(groups, seed=seed), seed=seed))
    return found if clusters is None else found.union(splits.cluster_disjoint(pairs, clusters, seed=seed))
