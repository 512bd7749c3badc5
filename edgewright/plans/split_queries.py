"""Queries that split pairs into regimes, gate them, and build control negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions.draws import ticket_sql, uniform, uniform_sql
from edgewright.operators import audit, graph, negatives, splits, stats
from edgewright.operators.ranges import checkpointed
from edgewright.plans.audit_queries import CANONICAL_SQL
from edgewright.plans.catalogue import query
from edgewright.plans.graph_queries import DEGREE
from edgewright.sources import tables as t

U = uniform_sql


def canonical(spark, sf_dir):
    return audit.canonical(t.event_pairs(spark, sf_dir)).select("a", "b", "label")


def users(spark, sf_dir):
    """(entity, grp): users in groups of those whose id ends alike."""
    pairs = canonical(spark, sf_dir)
    ends = pairs.select(F.col("a").alias("entity")).union(pairs.select("b")).distinct()
    return ends.withColumn("grp", F.concat(F.lit("g"), F.substring("entity", -2, 2)))


R0 = f"{CANONICAL_SQL}, r0 AS (SELECT 'R0' AS regime, CASE WHEN {U(42, 'label', 'a', 'b')} < 0.2 THEN 'test' ELSE 'train' END AS side, a, b, label FROM canonical)"


@query("split_random", f"WITH {R0} SELECT * FROM r0")
def split_random(spark, sf_dir):
    return splits.random_split(canonical(spark, sf_dir))


@query("split_folds", f"""WITH {CANONICAL_SQL}, d AS (SELECT a, b, label, {ticket_sql(42, 'a', 'b')} AS k FROM canonical)
SELECT a, b, label, (row_number() OVER (PARTITION BY label, substr(k, 1, 2) ORDER BY k, a, b) % 5)::INTEGER AS fold FROM d""")
def split_folds(spark, sf_dir):
    return splits.folds(canonical(spark, sf_dir))


POOLS = f"""{CANONICAL_SQL}, u AS (SELECT DISTINCT entity, 'g' || right(entity, 2) AS grp FROM (SELECT a AS entity FROM canonical UNION ALL SELECT b FROM canonical)),
pools AS (SELECT entity, grp, CASE WHEN {U(42, 'grp')} < 0.2 THEN 'test' ELSE 'train' END AS pool FROM u),
placed AS (SELECT a, b, label, x.pool AS pool_a, y.pool AS pool_b, x.grp AS grp_a, y.grp AS grp_b,
  CASE WHEN x.pool IS NULL OR y.pool IS NULL THEN 'unassigned' WHEN x.pool = y.pool THEN 'both_' || x.pool ELSE 'mixed' END AS membership
  FROM canonical LEFT JOIN pools x ON x.entity = a LEFT JOIN pools y ON y.entity = b)"""


@query("pool_partition", f"WITH {POOLS} SELECT entity, grp, pool FROM pools")
def pool_partition(spark, sf_dir):
    return splits.pools(users(spark, sf_dir))


@query("pool_membership", f"WITH {POOLS} SELECT a, b, label, pool_a, pool_b, grp_a, grp_b, membership FROM placed")
def pool_membership(spark, sf_dir):
    return splits.membership(canonical(spark, sf_dir), splits.pools(users(spark, sf_dir)))


def _holdout(source: str, name: str) -> str:
    return f"""tick AS (SELECT a, b, label, {ticket_sql(42, 'a', 'b')} AS k FROM {source}), ends AS (SELECT a AS node, a, b, k FROM tick UNION ALL SELECT b, a, b, k FROM tick),
guarded AS (SELECT DISTINCT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY node ORDER BY k DESC, a DESC, b DESC) AS r FROM ends) WHERE r = 1),
marked AS (SELECT tick.*, g.a IS NOT NULL AS guarded FROM tick LEFT JOIN guarded g ON g.a = tick.a AND g.b = tick.b),
rate AS (SELECT 0.2::DOUBLE * count(*) / greatest(count(*) FILTER (NOT guarded), 1) AS rate FROM marked),
{name} AS (SELECT 'R1' AS regime, CASE WHEN NOT guarded AND {U(43, 'a', 'b')} < rate THEN 'test' ELSE 'train' END AS side, a, b, label FROM marked, rate)"""


@query("split_degree_safe_holdout", f"WITH {t.PART_PAIRS_SQL}, p AS (SELECT a, b, 1 AS label FROM edges), {_holdout('p', 'r1')} SELECT * FROM r1")
def split_degree_safe_holdout(spark, sf_dir):
    return splits.degree_safe_holdout(t.part_pairs(spark, sf_dir).withColumn("label", F.lit(1)))


NOVELTY = f"""{POOLS}, inner_pairs AS (SELECT * FROM placed WHERE membership = 'both_train'), {_holdout('inner_pairs', 'r1')}, seen AS (
  SELECT a AS node FROM r1 WHERE side = 'train' UNION SELECT b FROM r1 WHERE side = 'train'
), regimes AS (
  SELECT * FROM r1 UNION ALL
  SELECT 'R2', 'test', a, b, label FROM placed WHERE membership = 'mixed' AND CASE WHEN pool_a = 'train' THEN a ELSE b END IN (SELECT node FROM seen) UNION ALL
  SELECT 'R3', 'test', a, b, label FROM placed WHERE membership = 'both_test' UNION ALL
  SELECT 'R2', side, a, b, label FROM r1 WHERE side = 'train' UNION ALL SELECT 'R3', side, a, b, label FROM r1 WHERE side = 'train'
)"""


def novelty(spark, sf_dir):
    return splits.novelty(canonical(spark, sf_dir), splits.pools(users(spark, sf_dir)))


@query("split_novelty", f"WITH {NOVELTY} SELECT regime, side, a, b, label FROM regimes")
def split_novelty(spark, sf_dir):
    return novelty(spark, sf_dir)


@query("split_label_balance", f"WITH {NOVELTY} SELECT regime, side, label, count(*) AS n FROM regimes GROUP BY ALL")
def split_label_balance(spark, sf_dir):
    return splits.label_balance(novelty(spark, sf_dir))


@query("split_cluster_disjoint", f"""WITH {CANONICAL_SQL}, u AS (SELECT DISTINCT entity FROM (SELECT a AS entity FROM canonical UNION ALL SELECT b FROM canonical)),
g AS (SELECT entity, CASE WHEN entity::BIGINT % 3 = 0 THEN 'own|' || entity ELSE 'g' || right(entity, 2) END AS grp FROM u),
pools AS (SELECT entity, CASE WHEN {U(42, 'grp')} < 0.2 THEN 'test' ELSE 'train' END AS pool FROM g)
SELECT 'R3-C' AS regime, x.pool AS side, a, b, label FROM canonical JOIN pools x ON x.entity = a JOIN pools y ON y.entity = b WHERE x.pool = y.pool""")
def split_cluster_disjoint(spark, sf_dir):
    known = users(spark, sf_dir).filter(F.col("entity").cast("long") % 3 != 0)
    return splits.cluster_disjoint(canonical(spark, sf_dir), known)


@query("leakage_gates", f"""WITH {NOVELTY}, all_ends AS (SELECT regime, side, a AS node FROM regimes UNION ALL SELECT regime, side, b FROM regimes),
p AS (SELECT regime, count(*) AS n FROM (SELECT regime, a, b FROM regimes GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY regime),
e AS (SELECT regime, count(*) AS n FROM (SELECT regime, node FROM all_ends GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY regime),
g AS (SELECT regime, count(*) AS n FROM (SELECT regime, 'g' || right(node, 2) AS grp FROM all_ends GROUP BY ALL HAVING count(DISTINCT side) = 2) GROUP BY regime),
tr AS (SELECT DISTINCT regime, node FROM all_ends WHERE side = 'train'),
s AS (SELECT r.regime, (x.node IS NOT NULL)::INT + (y.node IS NOT NULL)::INT AS seen FROM regimes r LEFT JOIN tr x ON x.regime = r.regime AND x.node = a LEFT JOIN tr y ON y.regime = r.regime AND y.node = b WHERE side = 'test'),
c AS (SELECT r.regime, count(*) FILTER (seen = 0) AS tests_0_seen, count(*) FILTER (seen = 1) AS tests_1_seen, count(*) FILTER (seen = 2) AS tests_2_seen FROM (SELECT DISTINCT regime FROM regimes) r LEFT JOIN s USING (regime) GROUP BY r.regime)
SELECT r.regime, coalesce(p.n, 0) AS shared_pairs, coalesce(e.n, 0) AS shared_entities, coalesce(g.n, 0) AS shared_groups, tests_0_seen, tests_1_seen, tests_2_seen,
  coalesce(p.n, 0) = 0 AND CASE r.regime WHEN 'R1' THEN tests_0_seen + tests_1_seen = 0 WHEN 'R2' THEN tests_0_seen + tests_2_seen = 0 ELSE coalesce(e.n, 0) = 0 END AS passed
FROM (SELECT DISTINCT regime FROM regimes) r LEFT JOIN p USING (regime) LEFT JOIN e USING (regime) LEFT JOIN g USING (regime) LEFT JOIN c USING (regime)""")
def leakage_gates(spark, sf_dir):
    return splits.gates(splits.leakage(novelty(spark, sf_dir), users(spark, sf_dir)))


STRATUM = {"random": "0", "degree": "degree_decile", "length": "length_decile", "degree_length": "degree_decile * 10 + length_decile", "exact_degree": "degree"}


def strata(spark, sf_dir, kind: str, pairs=None):
    """(entity, stratum, cluster): parts by degree decile, length decile, both, exact degree, or neither;
    ``pairs`` are the part pairs, where they are at hand."""
    parts = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.length(F.concat("p_name", "p_type")).alias("length"), "p_brand")
    degree = graph.degrees((t.part_pairs(spark, sf_dir) if pairs is None else pairs).withColumn("label", F.lit(1)))
    s = stats.entity_statistics(parts.drop("p_brand"), degree).join(parts.select("entity_id", "p_brand"), "entity_id")
    return checkpointed(s.select(F.col("entity_id").alias("entity"), F.expr(STRATUM[kind]).cast("long").alias("stratum"), F.col("p_brand").alias("cluster")))  # joined several times


STRATA = f"""{DEGREE}, e AS (
  SELECT p_partkey AS entity, length(p_name || p_type) AS length, coalesce(degree, 0) AS degree, p_brand AS cluster FROM part LEFT JOIN degree ON node = p_partkey
), cuts AS (SELECT list_sort(list_distinct(quantile_cont(length, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS cut FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY degree, entity) AS rk, count(*) OVER () AS n FROM e),
entities AS (SELECT entity, cluster, degree, greatest(0, len(list_filter(cut, lambda c: c < length)) - 1) AS length_decile, greatest(0, ((rk - 1) * 10 + n - 2) // (n - 1) - 1) AS degree_decile FROM r, cuts)"""

#: Set name to how it is matched. The first four, and the last, serve every positive.
CONTROL_SETS = {"N1_random": ("random", {}), "N2_degree": ("degree", {}), "N3_length": ("length", {}), "N5_degree_length": ("degree_length", {}), "N2_exact": ("exact_degree", {}), "N6_two_sided": ("degree", {"both": True}), "N7_other_cluster": ("degree_length", {"exclude_cluster": True})}


def made(spark, sf_dir, name):
    kind, how = CONTROL_SETS[name]
    pairs = checkpointed(t.part_pairs(spark, sf_dir))
    return negatives.matched(pairs, strata(spark, sf_dir, kind, pairs), name, **how)


def _wanted(name: str, kind: str) -> str:
    """Negatives by strata of their ends: as many as positives have, and none that breaks the contract."""
    return f"""WITH {STRATA}, s AS (SELECT entity, ({STRATUM[kind]})::BIGINT AS stratum FROM entities)
SELECT '{name}' AS set_name, least(x.stratum, y.stratum) AS low, greatest(x.stratum, y.stratum) AS high, count(*) AS n, 0::BIGINT AS broken
FROM edges JOIN s x ON x.entity = a JOIN s y ON y.entity = b GROUP BY ALL"""


def _control(name: str) -> None:
    kind, how = CONTROL_SETS[name]

    @query(f"negatives_{name}", None)
    def run(spark, sf_dir):
        return made(spark, sf_dir, name)

    @query(f"negative_checks_{name}", _wanted(name, kind) if name != "N2_exact" else None)
    def check(spark, sf_dir):
        entities = strata(spark, sf_dir, kind)
        return negatives.checks(made(spark, sf_dir, name), t.part_pairs(spark, sf_dir), entities, how.get("exclude_cluster", False))


for _name in CONTROL_SETS:
    _control(_name)


def nearest(spark, sf_dir):
    return negatives.nearest(t.part_pairs(spark, sf_dir), strata(spark, sf_dir, "exact_degree"), "N2_nearest")


@query("negatives_N2_nearest")
def negatives_n2_nearest(spark, sf_dir):
    return nearest(spark, sf_dir)


@query("negative_checks_N2_nearest", f"WITH {t.PART_PAIRS_SQL} SELECT count(*) AS n, 0::BIGINT AS known_positives, 0::BIGINT AS kept_none, count(*) AS different FROM edges")
def negative_checks_n2_nearest(spark, sf_dir):
    """As many as positives, none known, one end kept, and no pair twice."""
    pairs = t.part_pairs(spark, sf_dir)
    rows = nearest(spark, sf_dir).join(pairs.withColumn("known", F.lit(1)), ["a", "b"], "left")
    kept = F.size(F.array_intersect(F.array("a", "b"), F.array("of_a", "of_b"))) == 1
    return rows.agg(F.count("*").alias("n"), F.count("known").alias("known_positives"), F.count_if(~kept).alias("kept_none"), F.count_distinct("a", "b").alias("different"))


@query("negatives_in_pool", f"""WITH {STRATA}, s AS (SELECT entity, degree_decile AS stratum, {U(42, 'cluster')} < 0.5 AS held FROM entities),
p AS (SELECT a, b, x.stratum AS sa, y.stratum AS sb, ('0x' || substr({ticket_sql(42, "'side'", 'a', 'b')}, 1, 12))::BIGINT % 2 = 0 AS keep_a FROM edges JOIN s x ON x.entity = a JOIN s y ON y.entity = b)
SELECT 'N2_pool' AS set_name, CASE WHEN keep_a THEN sb ELSE sa END AS stratum, count(*) AS n, 0::BIGINT AS outside FROM p GROUP BY ALL""")
def negatives_in_pool(spark, sf_dir):
    """Decoys from one pool of entities alone, by the stratum of what they replace."""
    entities = strata(spark, sf_dir, "degree")
    held = entities.filter(uniform(42, "cluster") < 0.5)
    rows = negatives.matched(t.part_pairs(spark, sf_dir), entities, "N2_pool", candidates=held)
    decoys = rows.select("set_name", F.explode(F.array_except(F.array("a", "b"), F.array("of_a", "of_b"))).alias("entity"))
    marked = decoys.join(entities.select("entity", "stratum"), "entity").join(held.select("entity", F.lit(1).alias("held")), "entity", "left")
    return marked.groupBy("set_name", "stratum").agg(F.count("*").alias("n"), F.count_if(F.col("held").isNull()).alias("outside"))


@query("decoy_reuse")
def decoy_reuse(spark, sf_dir):
    return negatives.reuse(made(spark, sf_dir, "N2_degree"), t.part_pairs(spark, sf_dir))


@query("nearest_degree", f"""WITH {DEGREE}, have AS (SELECT DISTINCT coalesce(degree, 0) AS d FROM part LEFT JOIN degree ON node = p_partkey), want AS (SELECT DISTINCT p_size::BIGINT AS wanted FROM part)
SELECT wanted, d AS degree, abs(wanted - d) AS distance FROM (SELECT wanted, d, row_number() OVER (PARTITION BY wanted ORDER BY abs(wanted - d), d) AS r FROM want, have) WHERE r = 1""")
def nearest_degree(spark, sf_dir):
    degree = graph.degrees(t.part_pairs(spark, sf_dir).withColumn("label", F.lit(1))).select(F.col("node").alias("p_partkey"), "total_degree")
    parts = t.table(spark, sf_dir, "part").join(degree, "p_partkey", "left").na.fill(0, ["total_degree"])
    return negatives.nearest_degree(parts.select(F.col("total_degree").alias("degree")), parts.select(F.col("p_size").cast("long").alias("wanted")))
