"""Degrees, components and statistics of undirected graphs given as pairs (a, b)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.operators.ranges import checkpointed, running


#: Edges that one task unites, at most.
IN_ONE_TASK = 1 << 14


def endpoints(pairs: DataFrame) -> DataFrame:
    """Each pair twice, once for either end: (node, other, ...)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), *rest).union(pairs.select("b", "a", *rest))


def degrees(pairs: DataFrame) -> DataFrame:
    """Positive, negative and total degree of each entity that a pair names."""
    return endpoints(pairs).groupBy("node").agg(F.count_if(F.col("label") == 1).alias("pos_degree"), F.count_if(F.col("label") == 0).alias("neg_degree"), F.count("*").alias("total_degree"))


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node that each node of the edges reaches."""
    up: dict = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        kind = batch.schema.field(0).type
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array(map(root, list(up)), kind)], ["node", "component"])


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the least node that each reaches.

    A round gives each node the least of its neighbours and itself as its parent, after a jump to that
    one's own parent, and contracts edges to the parents of their ends; minima are partial before the
    shuffle. Once ``IN_ONE_TASK`` edges are left at most, one task unites them. Every round is cut by a
    reliable checkpoint."""
    ends = endpoints(pairs.select("a", "b"))
    edges = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes, edges = endpoints(edges).select("node").distinct(), edges.filter("a <> b")
    steps = []
    for _ in range(rounds):
        if edges.count() <= IN_ONE_TASK:
            break
        near = checkpointed(endpoints(edges).groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("first")))
        step = checkpointed(near.join(near.select(F.col("node").alias("first"), F.col("first").alias("parent")), "first").select("node", "parent"))
        steps.append(step)
        of_a, of_b = (step.toDF(x, f"p{x}") for x in ("a", "b"))
        moved = edges.join(of_a, "a").join(of_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        up = step.select(F.col("parent").alias("a")).distinct().join(of_a, "a").select("a", F.col("pa").alias("b"))
        edges = checkpointed(moved.union(up).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"more than {IN_ONE_TASK} edges are left after {rounds} rounds")
    kind = edges.schema["a"].dataType.simpleString()
    last = edges.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}").toDF("component", "next")
    label = nodes.withColumn("component", F.col("node"))
    for step in [*(s.toDF("component", "next") for s in steps), last]:
        label = label.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return checkpointed(label)


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def pair_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with their component, its number of pairs, and whether it is the one with the most.

    The largest comes from one aggregate; ties go to the least component."""
    placed = pairs.join(labels.withColumnRenamed("node", "a"), "a")
    size = placed.groupBy("component").agg(F.count("*").alias("component_pairs"))
    giant = size.agg(F.max_by("component", F.struct("component_pairs", -F.col("component"))).alias("giant"))
    return placed.join(size, "component").join(F.broadcast(giant)).withColumn("is_giant", F.col("component") == F.col("giant")).drop("giant")


def statistics(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and largest degree, components and the largest one."""
    degree = endpoints(pairs.select("a", "b")).groupBy("node").agg(F.count("*").alias("degree"))
    one = degree.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.round(F.avg("degree"), 3).alias("mean_degree"), F.max("degree").alias("max_degree"))
    two = component_sizes(labels).agg(F.count("*").alias("n_components"), F.max("size").alias("largest_component"))
    density = F.round(F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), 5)
    return one.join(two).withColumn("density", density)  # one row each


def hubs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of most pairs; ties go to the lesser node."""
    return endpoints(pairs.select("a", "b")).groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(k)


def upper_median_degree(pairs: DataFrame) -> DataFrame:
    """The upper median of degrees, from counts of each degree."""
    count = endpoints(pairs.select("a", "b")).groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))
    up = running(count, [], "degree", {"up_to": F.col("n")})
    return up.filter("up_to > all_up_to div 2").agg(F.min("degree").alias("upper_median_degree"))


def clustering_coefficient(pairs: DataFrame) -> DataFrame:
    """The mean over nodes of the share of neighbour pairs that are linked; 0 below two neighbours.

    Every pair points from its lesser to its greater degree, so a hub has few outgoing pairs and the
    join of outgoing pairs that finds triangles stays small."""
    edges = pairs.select("a", "b").distinct()
    degree = endpoints(edges).groupBy("node").agg(F.count("*").alias("degree"))
    of_a, of_b = (degree.toDF(x, f"d_{x}") for x in ("a", "b"))
    up = F.struct("d_a", "a") < F.struct("d_b", "b")
    out = edges.join(of_a, "a").join(of_b, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"))
    x, y = out.toDF("low", "x"), out.toDF("low", "y")
    wedge = x.join(y, "low").filter("x < y")
    closed = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    triangles = wedge.join(closed, ["x", "y"]).select(F.explode(F.array("low", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    share = F.try_divide(2.0 * F.coalesce("triangles", F.lit(0)), F.col("degree") * (F.col("degree") - 1))
    return degree.join(triangles, "node", "left").agg(F.round(F.avg(F.coalesce(share, F.lit(0.0))), 6).alias("clustering_coefficient"))
