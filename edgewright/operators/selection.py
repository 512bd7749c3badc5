"""The first k rows of each group by ticket, exactly, where k is a share of the group.

Tickets are hexadecimal, so a histogram of their first digits tells in which range the k-th one lies:
rows of lesser ranges are in, those of greater ranges are out, and only the range that is left is
counted by its next digits, until it is small enough to be ranked. No group is sorted, or sent
anywhere, whole; each step is one aggregate that gives a bounded number of rows for a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.ranges import checkpointed

#: Digits of a histogram, rows of a range that are ranked at most, and digits of a ticket.
DIGITS, RANKED, LENGTH = 3, 1 << 16, 32


def rounded(n: Column, share: float) -> Column:
    """How many of n rows a share is, halves to the even number."""
    return F.bround(n.cast("double") * F.lit(float(share)), 0).cast("long")


def first(rows: DataFrame, group: list[str], ticket: str, ties: list[str], share: float | None = None, count: int | None = None) -> DataFrame:
    """``rows`` with ``chosen``: whether a row is among the first of its group by (ticket, ties).

    How many are is ``share`` of the group, rounded, or ``count``, or all if the group has fewer."""
    own = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    rows = checkpointed(rows.withColumns({o: F.struct(g) for o, g in zip(own, group, strict=True)} if group else {"_g0": F.lit(0)}))  # a null is a group too
    n = rows.groupBy(*own).agg(F.count("*").alias("_n"))
    k = rounded(F.col("_n"), share) if share is not None else F.least(F.col("_n"), F.lit(count).cast("long"))
    everything = F.when(F.col("_k") >= F.col("_n"), "g").otherwise("")  # beyond any digit
    cuts = checkpointed(n.withColumn("_k", k).withColumn("_prefix", everything))
    wide = (F.col("_n") > RANKED) & (F.col("_k") > 0) & (F.col("_prefix") != "g") & (F.length("_prefix") < LENGTH)
    while not (open_ := cuts.filter(wide)).isEmpty():
        inside = rows.join(open_.select(*own, "_prefix"), own).filter(F.expr(f"left({ticket}, length(_prefix)) = _prefix"))
        bins = inside.groupBy(*own, F.expr(f"left({ticket}, length(_prefix) + {DIGITS})").alias("_bin")).agg(F.count("*").alias("_c"))
        up = bins.withColumn("_up", F.sum("_c").over(Window.partitionBy(*own).orderBy("_bin"))).join(open_.select(*own, "_k"), own)  # 16 ** DIGITS rows a group
        here = up.filter((F.col("_up") >= F.col("_k")) & (F.col("_up") - F.col("_c") < F.col("_k")))
        deeper = here.select(*own, F.col("_c").alias("_n"), (F.col("_k") - F.col("_up") + F.col("_c")).alias("_k"), F.col("_bin").alias("_prefix"))
        cuts = checkpointed(cuts.filter(~wide).union(deeper))
    placed = rows.join(cuts.select(*own, "_k", "_prefix"), own)
    head = F.expr(f"left({ticket}, length(_prefix))")
    at = (head == F.col("_prefix")) & (F.col("_k") > 0)
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(ticket, *ties))
    ranked = placed.filter(at).withColumn("chosen", rank <= F.col("_k"))
    rest = placed.filter(~at).withColumn("chosen", head < F.col("_prefix"))
    return ranked.union(rest).drop(*own, "_k", "_prefix")
