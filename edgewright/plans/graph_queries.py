"""Queries over the graph of parts that share an order, and degrees of event pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators import audit, graph, stats
from edgewright.plans.audit_queries import CANONICAL_SQL
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

EDGES = t.PART_PAIRS_SQL
DEGREE = f"{EDGES}, ends AS (SELECT a AS node, b AS other FROM edges UNION ALL SELECT b, a FROM edges), degree AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)"
LABELS = f"""RECURSIVE {DEGREE}, reach AS (
  SELECT node, node AS other FROM degree UNION SELECT reach.node, ends.other FROM reach JOIN ends ON reach.other = ends.node
), labels AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query("entity_degrees", f"""WITH {CANONICAL_SQL}, ends AS (SELECT a AS node, label FROM canonical UNION ALL SELECT b, label FROM canonical)
SELECT node, count(*) FILTER (label = 1) AS pos_degree, count(*) FILTER (label = 0) AS neg_degree, count(*) AS total_degree FROM ends GROUP BY node""")
def entity_degrees(spark, sf_dir):
    return graph.degrees(audit.canonical(t.event_pairs(spark, sf_dir)))


@query("degree_correlation", f"""WITH {CANONICAL_SQL}, ends AS (SELECT a AS node, label FROM canonical UNION ALL SELECT b, label FROM canonical),
d AS (SELECT node, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ends GROUP BY node)
SELECT round(corr(p, n), 6) AS correlation FROM d""")
def degree_correlation(spark, sf_dir):
    d = graph.degrees(audit.canonical(t.event_pairs(spark, sf_dir)))
    return d.agg(F.round(F.try_divide(F.covar_pop("pos_degree", "neg_degree"), F.stddev_pop("pos_degree") * F.stddev_pop("neg_degree")), 6).alias("correlation"))


@query("hubs_top10", f"WITH {DEGREE} SELECT node, degree FROM degree ORDER BY degree DESC, node LIMIT 10")
def hubs_top10(spark, sf_dir):
    return graph.hubs(t.part_pairs(spark, sf_dir))


@query("upper_median_degree", f"WITH {DEGREE} SELECT list_sort(list(degree))[len(list(degree)) // 2 + 1] AS upper_median_degree FROM degree")
def upper_median_degree(spark, sf_dir):
    return graph.upper_median_degree(t.part_pairs(spark, sf_dir))


@query("clustering_coefficient", f"""WITH {DEGREE}, tri AS (
  SELECT x.node, count(*) AS n FROM ends x JOIN ends y ON x.node = y.node AND x.other < y.other JOIN edges e ON e.a = x.other AND e.b = y.other GROUP BY x.node
) SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering_coefficient FROM degree LEFT JOIN tri USING (node)""")
def clustering_coefficient(spark, sf_dir):
    return graph.clustering_coefficient(t.part_pairs(spark, sf_dir))


@query("connected_components", f"WITH {LABELS} SELECT node, component FROM labels")
def connected_components(spark, sf_dir):
    return graph.components(t.part_pairs(spark, sf_dir))


@query("component_sizes", f"WITH {LABELS} SELECT component, count(*) AS size FROM labels GROUP BY component")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.components(t.part_pairs(spark, sf_dir)))


@query("pair_components", f"""WITH {LABELS}, placed AS (SELECT a, b, component FROM edges JOIN labels ON node = a),
size AS (SELECT component, count(*) AS component_pairs FROM placed GROUP BY component)
SELECT a, b, component, component_pairs, component = (SELECT component FROM size ORDER BY component_pairs DESC, component LIMIT 1) AS is_giant FROM placed JOIN size USING (component)""")
def pair_components(spark, sf_dir):
    pairs = t.part_pairs(spark, sf_dir)
    return graph.pair_components(pairs, graph.components(pairs))


@query("graph_statistics", f"""WITH {LABELS}, c AS (SELECT count(*) AS size FROM labels GROUP BY component), n AS (SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 3) AS mean_degree, max(degree) AS max_degree FROM degree)
SELECT *, (SELECT count(*) FROM c) AS n_components, (SELECT max(size) FROM c) AS largest_component, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 5) AS density FROM n""")
def graph_statistics(spark, sf_dir):
    pairs = t.part_pairs(spark, sf_dir)
    return graph.statistics(pairs, graph.components(pairs))


@query("entity_deciles", f"""WITH {DEGREE}, e AS (
  SELECT p_partkey AS entity_id, length(p_name || p_type) + p_size AS length, coalesce(degree, 0) AS degree FROM part LEFT JOIN degree ON node = p_partkey
), edges10 AS (SELECT list_sort(list_distinct(quantile_cont(length, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS cut FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY degree, entity_id) AS rk, count(*) OVER () AS n FROM e)
SELECT entity_id, length::INTEGER AS length, degree, greatest(0, len(list_filter(cut, lambda c: c < length)) - 1)::INTEGER AS length_decile,
  greatest(0, ((rk - 1) * 10 + n - 2) // (n - 1) - 1)::INTEGER AS degree_decile FROM r, edges10""")
def entity_deciles(spark, sf_dir):
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), (F.length(F.concat("p_name", "p_type")) + F.col("p_size")).alias("length"))
    degree = graph.degrees(t.part_pairs(spark, sf_dir).withColumn("label", F.lit(1)))
    return stats.entity_statistics(parts, degree)


POOLED = f"""{DEGREE}, pooled AS (
  SELECT 'reference' AS set_name, degree AS x FROM ends JOIN degree USING (node)
  UNION ALL
  SELECT 'part_mod' AS set_name, coalesce(degree, 0) AS x FROM (
    SELECT unnest([p_partkey, p_partkey + 1]) AS node FROM part WHERE p_partkey % 3 = 0) LEFT JOIN degree USING (node)
)"""


def pooled(spark, sf_dir):
    """Degrees at the ends of positives, and of arbitrary pairs of neighbouring part keys."""
    pairs = t.part_pairs(spark, sf_dir)
    degree = graph.degrees(pairs.withColumn("label", F.lit(1))).select(F.col("node").alias("entity_id"), F.col("total_degree").alias("x"))
    other = t.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.lit("part_mod").alias("set_name"), F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return stats.occurrences(pairs.select(F.lit("reference").alias("set_name"), "a", "b").union(other), degree)


@query("endpoint_description", f"""WITH {POOLED} SELECT set_name, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, quantile_cont(x, .25) AS q1, quantile_cont(x, .5) AS median,
  quantile_cont(x, .75) AS q3, min(x) AS low, max(x) AS high FROM pooled GROUP BY set_name""")
def endpoint_description(spark, sf_dir):
    return stats.describe(pooled(spark, sf_dir))


@query("ecdf_points", f"WITH {POOLED} SELECT DISTINCT set_name, x, round(cume_dist() OVER (PARTITION BY set_name ORDER BY x), 6) AS share FROM pooled")
def ecdf_points(spark, sf_dir):
    return stats.ecdf(pooled(spark, sf_dir))


@query("endpoint_balance", f"""WITH {POOLED}, m AS (SELECT set_name, avg(x) AS m, var_samp(x) AS v FROM pooled GROUP BY set_name),
spine AS (SELECT DISTINCT x FROM pooled), f AS (
  SELECT x, (SELECT avg((p.x <= s.x)::INT) FROM pooled p WHERE set_name = 'reference') AS f0, (SELECT avg((p.x <= s.x)::INT) FROM pooled p WHERE set_name <> 'reference') AS f1 FROM spine s
), d AS (SELECT abs(f0 - f1) AS gap, lead(x) OVER (ORDER BY x) - x AS step FROM f), dist AS (SELECT max(gap) AS ks, sum(gap * coalesce(step, 0)) AS w1 FROM d),
s AS (SELECT one.set_name, ref.m AS m0, one.m AS m1, (ref.m - one.m) / sqrt((ref.v + one.v) / 2) AS smd FROM m one, m ref WHERE ref.set_name = 'reference' AND one.set_name <> 'reference')
SELECT set_name, round(m0, 6) AS mean_reference, round(m1, 6) AS mean, round(smd, 6) AS smd, round(ks, 6) AS ks, round(w1, 6) AS w1, abs(smd) < 0.1 AS balanced, abs(smd) > 0.25 AS imbalanced FROM s, dist""")
def endpoint_balance(spark, sf_dir):
    return stats.compare(pooled(spark, sf_dir), "reference")
