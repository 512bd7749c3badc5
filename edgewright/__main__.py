"""Command line: ``validate`` audits files, ``run`` goes on to splits, control sets, models and a report,
``demo`` runs on made-up files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.functions import sequence
from edgewright.operators import audit, graph, splits, stats
from edgewright.operators.ranges import checkpointed
from edgewright.plans import framework
from edgewright.session import local_session
from edgewright.sources import files, sinks, synthetic


def _report(spark: SparkSession, out: str, tables: dict[str, DataFrame]) -> None:
    """Each table as JSON, and all as lines of one Markdown report."""
    lines = None
    for i, (name, df) in enumerate(tables.items()):
        sinks.write_json(df, f"{out}/{name}")
        kept = spark.read.schema(df.schema).json(f"{out}/{name}")
        head = spark.createDataFrame([(i, 0, f"## {name}"), (i, 1, "| " + " | ".join(kept.columns) + " |"), (i, 2, "|" + " --- |" * len(kept.columns))], "part int, place int, line string")
        body = sinks.markdown_rows(kept).select(F.lit(i).alias("part"), F.lit(3).alias("place"), "line")
        lines = head.union(body) if lines is None else lines.union(head).union(body)
    lines.orderBy("part", "place", "line").coalesce(1).select("line").write.mode("overwrite").text(f"{out}/report")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="edgewright")
    parser.add_argument("verb", choices=("validate", "run", "demo"))
    parser.add_argument("--out", required=True)
    for name in ("entities", "pairs", "clusters", "embeddings"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--model", default="lr", choices=("lr", "rf", "gbt", "mlp"))
    for name, default in (("seed", 42), ("replicates", 2000), ("size", 400)):
        parser.add_argument(f"--{name}", type=int, default=default)
    args = parser.parse_args(argv)
    spark = spark or local_session()
    if args.verb == "demo":
        args.entities, args.pairs = f"{args.out}/entities", f"{args.out}/pairs"
        synthetic.entities(spark, args.size, args.seed).write.mode("overwrite").csv(args.entities, sep="\t")
        synthetic.pairs(spark, args.size, 3 * args.size, args.seed).write.mode("overwrite").csv(args.pairs, sep="\t")
    elif not (args.entities and args.pairs):
        parser.error("--entities and --pairs are required")
    entities = files.read_entities(spark, args.entities)
    raw = audit.checked_labels(files.read_pairs(spark, args.pairs)).withColumn("ord", F.monotonically_increasing_id())
    if not audit.dangling(raw, entities).isEmpty():
        raise SystemExit("pairs name entities that the entity table lacks")
    canonical = audit.canonical(raw)
    canonical.write.mode("overwrite").parquet(f"{args.out}/canonical_pairs")
    canonical = spark.read.parquet(f"{args.out}/canonical_pairs")
    positives = canonical.filter("label = 1")
    found = audit.issue_counts(raw).join(audit.group_sizes(audit.sequence_groups(entities))).join(graph.statistics(positives, graph.components(positives)))  # one row each
    sinks.write_json(found, f"{args.out}/audit")
    if args.verb == "validate":
        return
    degree = graph.degrees(positives)
    statistics = checkpointed(stats.entity_statistics(entities.select("entity_id", F.length("seq").alias("length")), degree))
    pairs = framework.with_negatives(canonical.select("a", "b", "label"), statistics, args.seed)
    groups = audit.sequence_groups(entities).select(F.col("entity_id").alias("entity"), F.col("sequence_group_id").cast("string").alias("grp"))
    regimes = framework.regimes(pairs, groups, files.read_clusters(spark, args.clusters) if args.clusters else None, args.seed)
    sinks.write_splits(regimes, f"{args.out}/splits")
    regimes = spark.read.parquet(f"{args.out}/splits")
    gates = splits.gates(splits.leakage(regimes, groups))
    sinks.write_json(gates, f"{args.out}/gates")
    if not gates.filter("NOT passed").isEmpty():
        raise SystemExit("a regime leaks")
    controls = framework.control_sets(positives.select("a", "b"), statistics, args.seed)
    controls.write.mode("overwrite").partitionBy("set_name").parquet(f"{args.out}/negatives")
    vectors = checkpointed(files.read_embeddings(spark, args.embeddings) if args.embeddings else sequence.feature_vectors(entities))
    of_controls = framework.control_regimes(positives, controls, splits.TEST_SHARE, args.seed).select("regime", "side", "a", "b", "label")
    scored = framework.predictions(regimes.select("regime", "side", "a", "b", "label").union(of_controls), vectors, args.model)
    sinks.write_predictions(scored, f"{args.out}/predictions")
    _report(spark, args.out, {"scores": framework.scores(scored), "uncertainty": framework.uncertainty(scored, args.replicates), "balance": framework.balance(positives, controls, degree)})
    sinks.write_json(spark.createDataFrame([(sinks.manifest(**vars(args)),)], "manifest string"), f"{args.out}/manifest")


if __name__ == "__main__":
    main()
