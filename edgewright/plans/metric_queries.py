"""Queries that score returned line items, by line status."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewright.operators import metrics
from edgewright.plans.catalogue import query
from edgewright.sources import tables as t

S = f"WITH {t.SCORED_ITEMS_SQL}"
COUNTS = f"{S}, c AS (SELECT grp, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY grp, p)"
CURVE = f"""{COUNTS}, curve AS (
  SELECT grp, p, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY grp) AS all_pos FROM c WINDOW w AS (PARTITION BY grp ORDER BY p DESC)
), pr AS (SELECT *, tp / all_pos AS recall, tp / (tp + fp) AS prec FROM curve)"""
AUC = "auc AS (SELECT grp, (sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS roc_auc FROM (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS r FROM scored) GROUP BY grp)"


def _width(n: int) -> str:
    return f"len(list_filter([{', '.join(f'{i}.0::DOUBLE * (1.0::DOUBLE / {n}.0::DOUBLE)' for i in range(1, n))}], lambda e: e < p))::INTEGER"


@query("roc_auc", f"{S}, {AUC} SELECT grp, round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(t.scored_items(spark, sf_dir))


@query("pr_auc", f"{CURVE} SELECT grp, round(sum(pos * prec) / sum(pos), 6) AS pr_auc FROM pr GROUP BY grp")
def pr_auc(spark, sf_dir):
    return metrics.average_precision(t.scored_items(spark, sf_dir))


@query("operating_points", f"{CURVE} SELECT grp, round(max_by(prec, p) FILTER (recall >= 0.8), 6) AS precision_at_recall, round(max(recall) FILTER (prec >= 0.3), 6) AS recall_at_precision FROM pr GROUP BY grp")
def operating_points(spark, sf_dir):
    return metrics.operating_points(t.scored_items(spark, sf_dir))


@query("confusion_metrics", f"""{S}, c AS (SELECT grp, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn,
  count(*) FILTER (p < 0.5 AND y = 0) AS tn, avg((p - y) ** 2) AS brier FROM scored GROUP BY grp)
SELECT grp, tp, fp, fn, tn, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier FROM c""")
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(t.scored_items(spark, sf_dir))


def _ece(n: int) -> str:
    return f"SELECT grp, {n}::INTEGER AS bins, round(sum(n * abs(c - acc)) / sum(n), 6) AS ece FROM (SELECT grp, {_width(n)} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS acc FROM scored GROUP BY 1, 2) GROUP BY grp"


@query("ece_equal_width", f"{S} {_ece(10)}")
def ece_equal_width(spark, sf_dir):
    return metrics.ece_width(t.scored_items(spark, sf_dir))


@query("ece_bin_sensitivity", f"{S} " + " UNION ALL ".join(_ece(n) for n in (5, 10, 15, 20)))
def ece_bin_sensitivity(spark, sf_dir):
    return metrics.ece_width(t.scored_items(spark, sf_dir), (5, 10, 15, 20))


@query("ece_equal_frequency", f"""{S}, q AS (SELECT grp, list_sort(list_distinct(quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS cut FROM scored GROUP BY grp),
b AS (SELECT grp, greatest(0, len(list_filter(cut, lambda e: e < p)) - 1) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS acc FROM scored JOIN q USING (grp) GROUP BY 1, 2)
SELECT grp, round(sum(n * abs(c - acc)) / sum(n), 6) AS ece FROM b GROUP BY grp""")
def ece_equal_frequency(spark, sf_dir):
    return metrics.ece_frequency(t.scored_items(spark, sf_dir))


@query("reliability_curve", f"""{S}, b AS (SELECT grp, {_width(10)} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS acc FROM scored GROUP BY 1, 2),
spine AS (SELECT DISTINCT grp, unnest(range(10))::INTEGER AS bin FROM scored)
SELECT grp, bin, coalesce(n, 0) AS n, round(coalesce(c, (bin + 0.5) / 10), 6) AS confidence, round(acc, 6) AS accuracy FROM spine LEFT JOIN b USING (grp, bin)""")
def reliability_curve(spark, sf_dir):
    return metrics.reliability(t.scored_items(spark, sf_dir))


@query("score_separation", f"""{S}, {AUC}, c AS (SELECT grp, avg(p) FILTER (y = 1) AS mp, avg(p) FILTER (y = 0) AS mn, var_samp(p) FILTER (y = 1) AS vp, var_samp(p) FILTER (y = 0) AS vn,
  count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn, quantile_cont(p, [.25, .5, .75]) FILTER (y = 1) AS qp, quantile_cont(p, [.25, .5, .75]) FILTER (y = 0) AS qn FROM scored GROUP BY grp)
SELECT grp, round(roc_auc, 6) AS roc_auc, round(1 - round(roc_auc, 6), 6) AS roc_auc_inverted, round(mp, 6) AS mean_pos, round(mn, 6) AS mean_neg, round(qp[2], 6) AS median_pos, round(qn[2], 6) AS median_neg,
  round(qp[3] - qp[1], 6) AS iqr_pos, round(qn[3] - qn[1], 6) AS iqr_neg, round((mp - mn) / sqrt(((np - 1) * vp + (nn - 1) * vn) / (np + nn - 2)), 6) AS effect,
  CASE WHEN roc_auc <= 0.47 THEN 'reversed' WHEN abs(roc_auc - 0.5) <= 0.03 THEN 'chance' ELSE 'expected' END AS ordering FROM c JOIN auc USING (grp)""")
def score_separation(spark, sf_dir):
    return metrics.separation(t.scored_items(spark, sf_dir))


@query("prevalence", f"{S} SELECT grp, count(*) AS n_test, round(avg(y), 6) AS prevalence FROM scored GROUP BY grp")
def prevalence(spark, sf_dir):
    return metrics.prevalence(t.scored_items(spark, sf_dir))


@query("subset_metrics", "WITH scored AS (SELECT CASE WHEN l_quantity > 25 THEN 'affected' ELSE 'unaffected' END AS grp, (l_returnflag = 'R')::INTEGER AS y, l_discount * 8 + l_tax AS p FROM lineitem), " + AUC + " SELECT grp, round(roc_auc, 6) AS roc_auc FROM auc")
def subset_metrics(spark, sf_dir):
    items = t.table(spark, sf_dir, "lineitem")
    grp = F.when(F.col("l_quantity") > 25, "affected").otherwise("unaffected")
    return metrics.roc_auc(items.select(grp.alias("grp"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 8 + F.col("l_tax")).alias("p")))
