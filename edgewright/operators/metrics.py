"""Ranking, threshold and calibration metrics of scored outcomes (grp, y, p), by group.

Rankings work on one row for each different score of a group (positives and negatives there), made
by an aggregate with partial sums; running sums over those rows are taken in slices of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.operators.ranges import quantiles, running

DIGITS = 6


def _rounded(x: Column) -> Column:
    return F.round(x, DIGITS)


def score_counts(scored: DataFrame, weight: Column | None = None) -> DataFrame:
    """(grp, p, pos, neg): how many (or how much weight of) positives and negatives have a score."""
    w = F.lit(1) if weight is None else weight
    return scored.groupBy("grp", "p").agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))


def roc_auc(scored: DataFrame, weight: Column | None = None) -> DataFrame:
    """(grp, roc_auc): the chance that a positive outscores a negative, ties half; null for one class."""
    return area(score_counts(scored, weight))


def area(counts: DataFrame) -> DataFrame:
    """(grp, roc_auc) of counts of scores (grp, p, pos, neg)."""
    counts = running(counts, ["grp"], "p", {"up": F.col("neg")}).withColumn("below", F.col("up") - F.col("neg") / 2)
    total = F.sum("pos") * F.sum("neg")
    return counts.groupBy("grp").agg(_rounded(F.try_divide(F.sum(F.col("pos") * F.col("below")), total)).alias("roc_auc"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """(grp, p, pos, tp, fp, recall, precision) at each different score as the threshold."""
    curve = running(score_counts(scored), ["grp"], "p", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True)
    return curve.select("grp", "p", "pos", "tp", "fp", F.try_divide("tp", "all_tp").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def average_precision(scored: DataFrame) -> DataFrame:
    return pr_curve(scored).groupBy("grp").agg(_rounded(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos"))).alias("pr_auc"))


def operating_points(scored: DataFrame, recall: float = 0.8, precision: float = 0.3) -> DataFrame:
    """Per group: the precision at the highest threshold that reaches a recall, and the highest recall at a precision."""
    curve = pr_curve(scored)
    return curve.groupBy("grp").agg(
        _rounded(F.max_by("precision", F.when(F.col("recall") >= recall, F.col("p")))).alias("precision_at_recall"),
        _rounded(F.max(F.when(F.col("precision") >= precision, F.col("recall")))).alias("recall_at_precision"),
    )


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per group: counts at a threshold and what follows from them; 0 where a ratio is undefined."""
    hit, real = F.col("p") >= threshold, F.col("y") == 1
    c = scored.groupBy("grp").agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return c.select(
        "grp", "tp", "fp", "fn", "tn", _rounded(mcc).alias("mcc"), _rounded(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), _rounded(ratio(tp, tp + fp)).alias("precision"), _rounded(recall).alias("recall"),
        _rounded(specificity).alias("specificity"), _rounded(ratio(tp + tn, tp + tn + fp + fn)).alias("accuracy"), _rounded((recall + specificity) / 2).alias("balanced_accuracy"), _rounded(F.col("brier")).alias("brier"),
    )


def width_bin(p: Column, bins: int) -> Column:
    """The 0-based bin of equal width: how many inner edges lie strictly below p."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < p))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(grp, bin, n, confidence, accuracy) of bins of equal width; an empty bin has its middle and no accuracy."""
    filled = scored.groupBy("grp", width_bin(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("acc"))
    spine = scored.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(filled, ["grp", "bin"], "left").select("grp", "bin", F.coalesce("n", F.lit(0)).alias("n"), _rounded(F.coalesce(F.col("c"), (F.col("bin") + 0.5) / bins)).alias("confidence"), _rounded(F.col("acc")).alias("accuracy"))


def _ece(binned: DataFrame, *keys: str) -> DataFrame:
    each = binned.groupBy("grp", *keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("acc"))
    return each.groupBy("grp", *keys).agg(_rounded(F.sum(F.col("n") * F.abs(F.col("c") - F.col("acc"))) / F.sum("n")).alias("ece"))


def ece_width(scored: DataFrame, bins: tuple[int, ...] = (10,)) -> DataFrame:
    """(grp, bins, ece) with bins of equal width, for several numbers of bins in one pass."""
    choices = F.array(*[F.struct(F.lit(n).alias("bins"), width_bin(F.col("p"), n).alias("bin")) for n in bins])
    return _ece(scored.select("grp", "y", "p", F.inline(choices)), "bins")


def ece_frequency(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(grp, ece) with bins between distinct quantiles; 0 where all scores are equal."""
    edges = quantiles(scored, ["grp"], "p", [i / bins for i in range(bins + 1)], "edges").withColumn("edges", F.array_distinct("edges"))
    inner = F.greatest(F.lit(0), F.size(F.filter("edges", lambda e: e < F.col("p"))) - 1)
    binned = scored.join(edges, "grp").select("grp", "y", "p", inner.alias("bin"), (F.size("edges") < 2).alias("constant"))
    return _ece(binned.withColumn("p", F.when(F.col("constant"), F.lit(0.0)).otherwise(F.col("p"))).withColumn("y", F.when(F.col("constant"), 0).otherwise(F.col("y"))))


def ece_frequencies(scored: DataFrame, bins: tuple[int, ...]) -> DataFrame:
    """(grp, bins, ece) with bins of equal frequency, for several numbers of bins."""
    parts = [ece_frequency(scored, n).withColumn("bins", F.lit(n)) for n in bins]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("grp", "bins", "ece")


def separation(scored: DataFrame) -> DataFrame:
    """Per group: how classes' scores differ, and whether the ordering is reversed, chance or expected."""
    pos, neg = F.when(F.col("y") == 1, F.col("p")), F.when(F.col("y") == 0, F.col("p"))
    c = scored.groupBy("grp").agg(F.avg(pos).alias("mp"), F.avg(neg).alias("mn"), F.var_samp(pos).alias("vp"), F.var_samp(neg).alias("vn"), F.count(pos).alias("np"), F.count(neg).alias("nn"))
    quartiles = quantiles(scored, ["grp", "y"], "p", [0.25, 0.5, 0.75], "q")
    for name, y in (("qp", 1), ("qn", 0)):
        c = c.join(quartiles.filter(F.col("y") == y).select("grp", F.col("q").alias(name)), "grp", "left")
    pooled = F.sqrt(F.try_divide((F.col("np") - 1) * F.col("vp") + (F.col("nn") - 1) * F.col("vn"), F.col("np") + F.col("nn") - 2))
    auc = F.col("roc_auc")
    order = F.when(auc <= 0.47, "reversed").when(F.abs(auc - 0.5) <= 0.03, "chance").otherwise("expected")
    return c.join(roc_auc(scored), "grp").select(
        "grp", "roc_auc", _rounded(1 - auc).alias("roc_auc_inverted"), _rounded(F.col("mp")).alias("mean_pos"), _rounded(F.col("mn")).alias("mean_neg"), _rounded(F.col("qp")[1]).alias("median_pos"), _rounded(F.col("qn")[1]).alias("median_neg"),
        _rounded(F.col("qp")[2] - F.col("qp")[0]).alias("iqr_pos"), _rounded(F.col("qn")[2] - F.col("qn")[0]).alias("iqr_neg"), _rounded(F.try_divide(F.col("mp") - F.col("mn"), pooled)).alias("effect"), order.alias("ordering"),
    )


def prevalence(scored: DataFrame) -> DataFrame:
    return scored.groupBy("grp").agg(F.count("*").alias("n_test"), _rounded(F.avg("y")).alias("prevalence"))
