"""Queries that audit and canonicalize the event pairs, and entities made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators import audit, graph
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

CANONICAL_SQL = f"""{t.EVENT_PAIRS_SQL}, turned AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, label, ord FROM raw WHERE a <> b
), canonical AS (
  SELECT a, b, min(label) AS label, min(ord) AS ord FROM turned GROUP BY a, b HAVING min(label) = max(label)
)"""

COUNTS_SQL = f"""{t.EVENT_PAIRS_SQL}, real AS (
  SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM raw WHERE a <> b
), each AS (
  SELECT x, y, count(*) AS n, count(DISTINCT a) AS orders, sum((a > b)::INT) AS turned, min(label) <> max(label) AS clash FROM real GROUP BY x, y
)"""
COUNTS_COLUMNS_SQL = """sum(n)::BIGINT AS pairs, sum(turned)::BIGINT AS reordered, sum(n - orders)::BIGINT AS exact_duplicates,
  sum(orders - 1)::BIGINT AS reversed_duplicates, count(*) FILTER (clash) AS conflict_pairs, coalesce(sum(n) FILTER (clash), 0)::BIGINT AS conflict_rows,
  sum(n - 1) FILTER (NOT clash)::BIGINT AS duplicates_removed, count(*) FILTER (NOT clash) AS canonical_pairs"""


@query("audit_issue_counts", f"WITH {COUNTS_SQL} SELECT {COUNTS_COLUMNS_SQL}, (SELECT count(*) FROM raw WHERE a = b) AS self_pairs FROM each")
def audit_issue_counts(spark, sf_dir):
    return audit.issue_counts(t.event_pairs(spark, sf_dir))


@query("audit_report", f"""WITH {COUNTS_SQL}, canonical AS (
  SELECT x AS a, y AS b FROM real WHERE label = 1 AND (x, y) IN (SELECT (x, y) FROM each WHERE NOT clash) GROUP BY x, y
), ends AS (SELECT a AS node FROM canonical UNION ALL SELECT b FROM canonical), degree AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)
SELECT {COUNTS_COLUMNS_SQL}, (SELECT count(*) FROM raw WHERE a = b) AS self_pairs,
  (SELECT count(*) FROM degree) AS n_nodes, (SELECT (sum(degree) / 2)::BIGINT FROM degree) AS n_edges, (SELECT max(degree) FROM degree) AS max_degree
FROM each""")
def audit_report(spark, sf_dir):
    """What canonicalizing the event pairs finds, and the size of the positive graph."""
    pairs = t.event_pairs(spark, sf_dir)
    degree = graph.degrees(audit.canonical(pairs).filter("label = 1"))
    size = degree.agg(F.count("*").alias("n_nodes"), (F.sum("total_degree") / 2).cast("long").alias("n_edges"), F.max("total_degree").alias("max_degree"))
    return audit.issue_counts(pairs).join(size)  # one row each


@query("canonical_pairs", f"WITH {CANONICAL_SQL} SELECT a, b, label, ord FROM canonical")
def canonical_pairs(spark, sf_dir):
    return audit.canonical(t.event_pairs(spark, sf_dir))


@query("duplicate_pairs", f"WITH {t.EVENT_PAIRS_SQL} SELECT a, b, label, ord FROM (SELECT *, count(*) OVER (PARTITION BY a, b) AS n FROM raw) WHERE n > 1")
def duplicate_pairs(spark, sf_dir):
    return audit.copies(t.event_pairs(spark, sf_dir), ["a", "b"]).drop("copies")


@query("reverse_or_exact_duplicates", f"WITH {t.EVENT_PAIRS_SQL} SELECT a, b, label, ord FROM (SELECT *, count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS n FROM raw) WHERE n > 1")
def reverse_or_exact_duplicates(spark, sf_dir):
    return audit.reverse_or_exact_duplicates(t.event_pairs(spark, sf_dir)).drop("copies")


@query("conflicting_labels", f"WITH {t.EVENT_PAIRS_SQL} SELECT least(a, b) AS a, greatest(a, b) AS b FROM raw WHERE a <> b GROUP BY 1, 2 HAVING min(label) <> max(label)")
def conflicting_labels(spark, sf_dir):
    return audit.conflicts(t.event_pairs(spark, sf_dir))


@query("self_pairs", f"WITH {t.EVENT_PAIRS_SQL} SELECT a, b, label, ord FROM raw WHERE a = b")
def self_pairs(spark, sf_dir):
    return t.event_pairs(spark, sf_dir).filter("a = b")


@query("dangling_ends", f"WITH {t.EVENT_PAIRS_SQL} SELECT DISTINCT node AS entity_id FROM (SELECT a AS node FROM raw UNION ALL SELECT b FROM raw) WHERE node NOT IN (SELECT s_suppkey::VARCHAR FROM supplier)")
def dangling_ends(spark, sf_dir):
    suppliers = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"))
    return audit.dangling(t.event_pairs(spark, sf_dir), suppliers)


@query("labels_in_domain", f"WITH {t.EVENT_PAIRS_SQL} SELECT label, count(*) AS n FROM raw GROUP BY label")
def labels_in_domain(spark, sf_dir):
    return audit.checked_labels(t.event_pairs(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query("duplicate_entity_ids", "SELECT a AS entity_id, n FROM (SELECT l_orderkey AS a, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_entity_ids(spark, sf_dir):
    items = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return items.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("l_orderkey").alias("entity_id"), "n")


@query("identical_sequences", f"WITH {t.SEQUENCES_SQL} SELECT entity_id, n FROM (SELECT entity_id, count(*) OVER (PARTITION BY seq) AS n FROM seqs) WHERE n > 1")
def identical_sequences(spark, sf_dir):
    hashed = t.sequences(spark, sf_dir).select("entity_id", F.sha2(F.col("seq").cast("binary"), 256).alias("h"))
    return audit.copies(hashed, ["h"]).select("entity_id", F.col("copies").alias("n"))


@query("sequence_groups", f"WITH {t.SEQUENCES_SQL} SELECT entity_id, sha256(seq) AS sequence_hash, dense_rank() OVER (ORDER BY sha256(seq)) - 1 AS sequence_group_id FROM seqs")
def sequence_groups(spark, sf_dir):
    return audit.sequence_groups(t.sequences(spark, sf_dir))


@query("sequence_group_sizes", f"WITH {t.SEQUENCES_SQL}, s AS (SELECT count(*) AS n FROM seqs GROUP BY seq) SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_shared, sum(n) FILTER (n > 1)::BIGINT AS members_shared, max(n) AS largest FROM s")
def sequence_group_sizes(spark, sf_dir):
    return audit.group_sizes(audit.sequence_groups(t.sequences(spark, sf_dir)))


@query("sequence_checks", f"WITH {t.SEQUENCES_SQL} SELECT entity_id, length(seq) = 0 AS missing, length(regexp_replace(seq, '[{audit.ALPHABET}]', '', 'g'))::INTEGER AS nonstandard FROM seqs")
def sequence_checks(spark, sf_dir):
    return audit.sequence_checks(t.sequences(spark, sf_dir))
