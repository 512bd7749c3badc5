"""Queries that split pairs by exact counts: stratified by label, pools of groups, and the greedy holdout."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.functions.draws import ticket_sql
from edgewright.operators import splits
from edgewright.operators.ranges import checkpointed
from edgewright.plans.audit_queries import CANONICAL_SQL
from edgewright.plans.catalogue import query
from edgewright.plans.split_queries import canonical, users
from edgewright.sources import tables as t


@query("split_stratified", f"""WITH {CANONICAL_SQL}, r AS (
  SELECT a, b, label, row_number() OVER (PARTITION BY label ORDER BY {ticket_sql(42, 'label', 'a', 'b')}, a, b) AS place, count(*) OVER (PARTITION BY label) AS n FROM canonical
) SELECT 'R0' AS regime, CASE WHEN place <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side, a, b, label FROM r""")
def split_stratified(spark, sf_dir):
    return splits.stratified_split(canonical(spark, sf_dir))


COUNTED_POOLS = f"""{CANONICAL_SQL}, u AS (SELECT DISTINCT entity, 'g' || right(entity, 2) AS grp FROM (SELECT a AS entity FROM canonical UNION ALL SELECT b FROM canonical)),
groups AS (SELECT grp, row_number() OVER (ORDER BY {ticket_sql(42, 'grp')}, grp) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM u)),
pools AS (SELECT entity, grp, CASE WHEN place <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS pool FROM u JOIN groups USING (grp))"""


@query("pool_partition_counted", f"WITH {COUNTED_POOLS} SELECT entity, grp, pool FROM pools")
def pool_partition_counted(spark, sf_dir):
    return splits.counted_pools(users(spark, sf_dir))


def _greedy(source: str, name: str) -> str:
    """SQL of the walk by ticket: last pairs of entities one after another, each refused if an entity of
    which it is the last has no refused one among its others."""
    return f"""ranked AS (SELECT a, b, label, row_number() OVER (ORDER BY {ticket_sql(42, 'a', 'b')}, a, b) AS i FROM {source}),
ends AS (SELECT a AS node, i FROM ranked UNION ALL SELECT b, i FROM ranked), lasts AS (SELECT node, max(i) AS i FROM ends GROUP BY node),
doubt AS (SELECT i, row_number() OVER (ORDER BY i) AS d FROM (SELECT DISTINCT i FROM lasts)),
others AS (SELECT l.node, x.d, list(y.d) FILTER (y.d IS NOT NULL) AS waits FROM lasts l JOIN doubt x ON x.i = l.i LEFT JOIN ends e ON e.node = l.node AND e.i <> l.i LEFT JOIN doubt y ON y.i = e.i GROUP BY ALL),
asked AS (SELECT d, list(coalesce(waits, [])) AS sets FROM others GROUP BY d),
walk AS (
  SELECT 0::BIGINT AS d, []::BIGINT[] AS refused UNION ALL
  SELECT asked.d, CASE WHEN len(list_filter(sets, lambda s: len(list_intersect(s, refused)) = 0)) > 0 THEN list_append(refused, asked.d) ELSE refused END
  FROM walk JOIN asked ON asked.d = walk.d + 1
), final AS (SELECT unnest(refused) AS d FROM (SELECT refused FROM walk ORDER BY d DESC LIMIT 1)),
free AS (SELECT r.*, row_number() OVER (ORDER BY i) AS place FROM ranked r WHERE i NOT IN (SELECT i FROM doubt JOIN final USING (d))),
{name} AS (SELECT 'R1' AS regime, CASE WHEN place <= (SELECT round_even(count(*) * 0.2::DOUBLE, 0) FROM ranked) THEN 'test' ELSE 'train' END AS side, r.a, r.b, r.label FROM ranked r LEFT JOIN free USING (i))"""


@query("split_greedy_holdout", f"WITH RECURSIVE {t.PART_PAIRS_SQL}, p AS (SELECT a, b, 1 AS label FROM edges), {_greedy('p', 'r1')} SELECT * FROM r1")
def split_greedy_holdout(spark, sf_dir):
    return splits.greedy_holdout(t.part_pairs(spark, sf_dir).withColumn("label", F.lit(1)))


@query("split_regimes_counted", f"""WITH RECURSIVE {COUNTED_POOLS},
placed AS (SELECT a, b, label, x.pool AS pool_a, y.pool AS pool_b FROM canonical JOIN pools x ON x.entity = a JOIN pools y ON y.entity = b),
inner_pairs AS (SELECT a, b, label FROM placed WHERE pool_a = 'train' AND pool_b = 'train'), {_greedy('inner_pairs', 'r1')},
seen AS (SELECT a AS node FROM r1 WHERE side = 'train' UNION SELECT b FROM r1 WHERE side = 'train'),
r0 AS (SELECT a, b, label, row_number() OVER (PARTITION BY label ORDER BY {ticket_sql(42, 'label', 'a', 'b')}, a, b) AS place, count(*) OVER (PARTITION BY label) AS n FROM canonical),
regimes AS (
  SELECT 'R0' AS regime, CASE WHEN place <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side, label FROM r0 UNION ALL
  SELECT 'R1', side, label FROM r1 UNION ALL SELECT 'R2', side, label FROM r1 WHERE side = 'train' UNION ALL SELECT 'R3', side, label FROM r1 WHERE side = 'train' UNION ALL
  SELECT 'R2', 'test', label FROM placed WHERE pool_a <> pool_b AND CASE WHEN pool_a = 'train' THEN a ELSE b END IN (SELECT node FROM seen) UNION ALL
  SELECT 'R3', 'test', label FROM placed WHERE pool_a = 'test' AND pool_b = 'test'
) SELECT regime, side, label, count(*) AS n FROM regimes GROUP BY ALL""")
def split_regimes_counted(spark, sf_dir):
    """Label balance of all four regimes with exact counts."""
    pairs = checkpointed(canonical(spark, sf_dir))
    made = splits.novelty(pairs, splits.counted_pools(users(spark, sf_dir)), holdout_by=splits.greedy_holdout)
    return splits.label_balance(splits.stratified_split(pairs).union(made))
