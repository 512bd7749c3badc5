"""Queries for uncertainty over scored part pairs whose components are resampled."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from edgewright.functions.draws import ticket_sql
from edgewright.operators import graph, inference, metrics
from edgewright.operators.ranges import checkpointed
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

COMPONENTS = f"""RECURSIVE {t.SCORED_PAIRS_SQL}, ends AS (SELECT a AS node, b AS other FROM edges UNION ALL SELECT b, a FROM edges), reach AS (
  SELECT node, node AS other FROM ends UNION SELECT reach.node, ends.other FROM reach JOIN ends ON reach.other = ends.node
), labels AS (SELECT node, min(other) AS component FROM reach GROUP BY node), s AS (SELECT component, y, p FROM scored JOIN labels ON node = a),
comps AS (SELECT DISTINCT component FROM s)"""
AUC = "(sum(y * r) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0)"
LOCO = f"""{COMPONENTS}, rest AS (SELECT c.component, s.y, s.p FROM comps c JOIN s ON s.component <> c.component),
loco AS (SELECT component, count(*) AS n_left, {AUC} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY component ORDER BY p) + (count(*) OVER (PARTITION BY component, p) - 1) / 2 AS r FROM rest) GROUP BY component),
whole AS (SELECT {AUC} AS full_auc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s))"""


def scored(spark, sf_dir):
    pairs = checkpointed(t.scored_pairs(spark, sf_dir))
    labels = graph.components(pairs).withColumnRenamed("node", "a")
    return checkpointed(pairs.join(labels, "a").select("component", "y", "p"))  # counted several times


@query("leave_one_component_out", f"WITH {LOCO} SELECT component, n_left, round(roc_auc, 6) AS roc_auc FROM loco")
def leave_one_component_out(spark, sf_dir):
    left = inference.without_each(scored(spark, sf_dir))
    return left.select("component", "n_left", F.round("roc_auc", 6).alias("roc_auc"))


@query("jackknife_variance", f"WITH {LOCO} SELECT count(*) AS components, (SELECT round(full_auc, 6) FROM whole) AS full_auc, round((count(*) - 1) * var_pop(roc_auc), 9) AS variance FROM loco WHERE roc_auc IS NOT NULL")
def jackknife_variance(spark, sf_dir):
    return inference.jackknife(scored(spark, sf_dir))


@query("jackknife_interval")
def jackknife_interval(spark, sf_dir):
    j = inference.jackknife(scored(spark, sf_dir))
    return j.withColumn("t", inference.t_interval("full_auc", "variance", "components")).select("components", "full_auc", "variance", "t.low", "t.high", "t.p_value")


REPLICATES = 2_000
BOOT = f"""{COMPONENTS}, listed AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS number, count(*) OVER () AS n FROM comps),
draws AS (SELECT g.replicate, ('0x' || substr({ticket_sql(42, 'g.replicate', 'l.number')}, 1, 12))::BIGINT % l.n AS number FROM listed l, range({REPLICATES}) g(replicate)),
rows AS (SELECT d.replicate, s.y, s.p FROM draws d JOIN listed l USING (number) JOIN s USING (component)),
boot AS (SELECT replicate, {AUC} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY p) + (count(*) OVER (PARTITION BY replicate, p) - 1) / 2 AS r FROM rows) GROUP BY replicate)"""


@query("component_bootstrap", f"WITH {BOOT} SELECT replicate::INTEGER AS replicate, round(roc_auc, 6) AS roc_auc FROM boot")
def component_bootstrap(spark, sf_dir):
    return inference.bootstrap(scored(spark, sf_dir), REPLICATES)


@query("bootstrap_interval", f"""WITH {BOOT}, b AS (SELECT round(roc_auc, 6) AS x FROM boot WHERE roc_auc IS NOT NULL)
SELECT count(*) AS valid, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(least(1.0, 2 * least(avg((x >= 0.5)::INT), avg((x <= 0.5)::INT))), 6) AS p_value FROM b""")
def bootstrap_interval(spark, sf_dir):
    return inference.interval(inference.bootstrap(scored(spark, sf_dir), REPLICATES))


TESTS = "tests AS (SELECT l_returnflag AS family, l_partkey AS test, CASE WHEN count(*) % 7 > 0 THEN round(avg(l_tax) * avg(l_discount) * 100, 9) END AS p FROM lineitem GROUP BY ALL)"


@query("adjusted_p_values", f"""WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS rk, count(*) OVER (PARTITION BY family) AS m FROM tests WHERE p IS NOT NULL),
a AS (SELECT family, test, p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adj FROM r)
SELECT family, test, p, p_adj, p_adj <= 0.05 AS reject FROM a UNION ALL SELECT family, test, p, NULL, false FROM tests WHERE p IS NULL""")
def adjusted_p_values(spark, sf_dir):
    grouped = t.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("test"))
    p = F.when(F.count("*") % 7 > 0, F.round(F.avg("l_tax") * F.avg("l_discount") * 100, 9))
    return inference.adjusted(grouped.agg(p.alias("p")))


@query("giant_excluded_auc", f"""WITH {COMPONENTS}, size AS (SELECT component, count(*) AS n FROM s GROUP BY component), kept AS (SELECT * FROM s WHERE component <> (SELECT component FROM size ORDER BY n DESC, component LIMIT 1))
SELECT 'without giant' AS grp, round({AUC}, 6) AS roc_auc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM kept)""")
def giant_excluded_auc(spark, sf_dir):
    pairs = checkpointed(t.scored_pairs(spark, sf_dir))
    placed = graph.pair_components(pairs, graph.components(pairs)).filter("NOT is_giant")
    return metrics.roc_auc(placed.select(F.lit("without giant").alias("grp"), "y", "p"))


@query("paired_bootstrap_difference", f"""WITH {BOOT}, rows2 AS (SELECT replicate, y, 1 - p * p AS p FROM rows),
boot2 AS (SELECT replicate, {AUC} AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY replicate ORDER BY p) + (count(*) OVER (PARTITION BY replicate, p) - 1) / 2 AS r FROM rows2) GROUP BY replicate)
SELECT x.replicate::INTEGER AS replicate, round(round(x.roc_auc, 6) - round(y.roc_auc, 6), 6) AS roc_auc FROM boot x JOIN boot2 y USING (replicate)""")
def paired_bootstrap_difference(spark, sf_dir):
    rows = scored(spark, sf_dir)
    other = rows.withColumn("p", 1 - F.col("p") * F.col("p"))
    return inference.paired_difference(*inference.bootstrap_pair(rows, other, REPLICATES))


@query("welch_difference", f"""WITH {COMPONENTS}, rest AS (SELECT c.component, s.y, s.p FROM comps c JOIN s ON s.component <> c.component),
l1 AS (SELECT component, {AUC} AS v FROM (SELECT *, rank() OVER (PARTITION BY component ORDER BY p) + (count(*) OVER (PARTITION BY component, p) - 1) / 2 AS r FROM rest) GROUP BY component),
l2 AS (SELECT component, {AUC} AS v FROM (SELECT component, y, rank() OVER (PARTITION BY component ORDER BY 1 - p * p) + (count(*) OVER (PARTITION BY component, 1 - p * p) - 1) / 2 AS r FROM rest) GROUP BY component),
f1 AS (SELECT round({AUC}, 6) AS e FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s)),
f2 AS (SELECT round({AUC}, 6) AS e FROM (SELECT y, rank() OVER (ORDER BY 1 - p * p) + (count(*) OVER (PARTITION BY 1 - p * p) - 1) / 2 AS r FROM s)),
j1 AS (SELECT count(*) AS g, round((count(*) - 1) * var_pop(v), 9) AS v FROM l1 WHERE v IS NOT NULL), j2 AS (SELECT count(*) AS g, round((count(*) - 1) * var_pop(v), 9) AS v FROM l2 WHERE v IS NOT NULL)
SELECT round(f1.e - f2.e, 6) AS difference, round(sqrt(j1.v + j2.v), 6) AS se, round((j1.v + j2.v) ** 2 / (j1.v ** 2 / (j1.g - 1) + j2.v ** 2 / (j2.g - 1)), 4) AS df FROM f1, f2, j1, j2""")
def welch_difference(spark, sf_dir):
    rows = scored(spark, sf_dir)
    x = inference.jackknife(rows)
    y = inference.jackknife(rows.withColumn("p", 1 - F.col("p") * F.col("p"))).toDF("g2", "e2", "v2")
    d = inference.welch((F.col("full_auc"), F.col("variance"), F.col("components")), (F.col("e2"), F.col("v2"), F.col("g2")))
    return x.join(y).select(F.round(d["difference"], 6).alias("difference"), F.round(d["se"], 6).alias("se"), F.round(d["df"], 4).alias("df"))  # one row each


@query("welch_p_value")
def welch_p_value(spark, sf_dir):
    """The same difference with its p-value by Student's t."""
    return welch_difference(spark, sf_dir).withColumn("p_value", F.round(inference.t_p_value("difference", "se", "df"), 6))


def _poisson_sql() -> str:
    total, term, parts = 0.0, math.exp(-1), []
    for k in range(12):
        total += term
        parts.append(f"(u >= {round(total, 12)}::DOUBLE)::INT")
        term /= k + 1
    return " + ".join(parts)


@query("mean_difference_bootstrap", f"""WITH v AS (SELECT (p_size > 25)::INTEGER AS side, p_partkey AS key, p_retailprice AS x FROM part),
d AS (SELECT g.replicate, v.*, ('0x' || substr({ticket_sql(42, 'v.side', 'v.key', 'g.replicate')}, 1, 12))::BIGINT / {float(1 << 48)} AS u FROM v, range(20) g(replicate)),
n AS (SELECT *, {_poisson_sql()} AS times FROM d)
SELECT replicate::INTEGER AS replicate, round(sum(times * x) FILTER (side = 1) / sum(times) FILTER (side = 1) - sum(times * x) FILTER (side = 0) / sum(times) FILTER (side = 0), 6) AS difference FROM n GROUP BY replicate""")
def mean_difference_bootstrap(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    return inference.mean_differences(part.select((F.col("p_size") > 25).cast("int").alias("side"), F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("x")), 20)


@query("metric_mean_and_deviation", """WITH scored AS (SELECT strftime(l_shipdate, '%Y-%m') AS grp, (l_returnflag = 'R')::INTEGER AS y, l_discount * 8 + l_tax AS p FROM lineitem),
auc AS (SELECT grp, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS a FROM (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS r FROM scored) GROUP BY grp)
SELECT count(a) AS n, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS sd, min(a) AS low, max(a) AS high FROM auc""")
def metric_mean_and_deviation(spark, sf_dir):
    items = t.table(spark, sf_dir, "lineitem")
    scored_items = items.select(F.date_format("l_shipdate", "yyyy-MM").alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 8 + F.col("l_tax")).alias("p"))
    a = metrics.roc_auc(scored_items)
    return a.agg(F.count("roc_auc").alias("n"), F.round(F.avg("roc_auc"), 6).alias("mean"), F.round(F.stddev_samp("roc_auc"), 6).alias("sd"), F.min("roc_auc").alias("low"), F.max("roc_auc").alias("high"))
