"""Uncertainty of scores over pairs that share entities: resampling whole graph components.

Scored pairs carry (component, y, p). A component's counts of each score are made once; replicates
and left-out components then reweigh these counts and never copy rows. The area under the curve of
a replicate needs positives and negatives below each score, summed over different scores.

How often each replicate draws a component is a byte. A task makes all draws of a replicate, or those of
``RANGE`` components of it, and counts them; the counts are dealt to ``SHARD`` components each and turned,
so that a component has its bytes of all replicates in one row. Counts of scores are joined with these
bytes, and a task adds up what all replicates take of the components that it meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgewright.functions.draws import below, below_each
from edgewright.operators.metrics import area, roc_auc
from edgewright.operators.ranges import checkpointed, running

SEED, DIGITS = 42, 6
#: Components whose draws a task counts at once, and those that are turned at once.
RANGE, SHARD = 1 << 24, 1 << 11
#: Draws between two counts of them; a component's scores in a row; rows and scores that are weighed at once.
AT_ONCE, SCORES, ROWS, ENTRIES = 1 << 20, 1024, 512, 2048
#: Different scores whose sums over replicates a task holds before it hands them on.
HELD = 1024


def without_each(scored: DataFrame) -> DataFrame:
    """(component, n_left, roc_auc) of all rows but a component's; null where one class is left.

    Leaving a component out subtracts: of its own pairs, and of pairs between it and the rest, which
    one join on scores of all rows gives. Work grows with rows, not with rows times components."""
    counts = checkpointed(scored.groupBy("component", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    by_score = running(counts.groupBy("p").agg(F.sum("pos").alias("of_pos"), F.sum("neg").alias("of_neg")), [], "p", {"pos_up": F.col("of_pos"), "neg_up": F.col("of_neg")})
    by_score = checkpointed(by_score.select("p", "of_pos", "of_neg", (F.col("neg_up") - F.col("of_neg") / 2).alias("neg_below"), (F.col("all_pos_up") - F.col("pos_up") + F.col("of_pos") / 2).alias("pos_above")))
    total = by_score.agg(F.sum("of_pos").alias("P"), F.sum("of_neg").alias("N"), F.sum(F.col("of_pos") * F.col("neg_below")).alias("U"))
    own = running(counts, ["component"], "p", {"own_up": F.col("neg")}).drop("all_own_up")
    each = own.withColumn("own_below", F.col("own_up") - F.col("neg") / 2).join(by_score, "p")
    c = each.groupBy("component").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"), F.sum(F.col("pos") * F.col("neg_below")).alias("mine_over"), F.sum(F.col("neg") * F.col("pos_above")).alias("over_mine"), F.sum(F.col("pos") * F.col("own_below")).alias("inside"))
    left = c.join(F.broadcast(total))  # one row of totals
    u = F.col("U") - F.col("mine_over") - F.col("over_mine") + F.col("inside")
    p, n = F.col("P") - F.col("cp"), F.col("N") - F.col("cn")
    return left.select("component", (p + n).alias("n_left"), F.try_divide(u, p * n).alias("roc_auc"))


def jackknife(scored: DataFrame) -> DataFrame:
    """One row: usable components, the full score, and the delete-one variance of the area."""
    scored = checkpointed(scored)
    left = without_each(scored).filter("roc_auc IS NOT NULL")
    v = left.agg(F.count("*").alias("g"), F.var_pop("roc_auc").alias("v"))
    full = roc_auc(scored.withColumn("grp", F.lit(0))).select(F.col("roc_auc").alias("full_auc"))
    return v.join(full).select(F.col("g").alias("components"), "full_auc", F.round(F.when(F.col("g") >= 2, (F.col("g") - 1) * F.col("v")), 9).alias("variance"))


def multiplicities(components: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, component, times): as many components as there are, drawn with replacement.

    Components are numbered; a draw is a number. Zero times give no row."""
    listed = checkpointed(running(components.select("component").distinct(), [], "component", {"number": F.lit(1)}).select("component", (F.col("number") - 1).alias("number")))
    n = listed.agg(F.count("*").alias("n"))
    slots = listed.select(F.col("number").alias("slot")).join(F.broadcast(n)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))  # one row
    drawn = slots.select("replicate", below(F.col("n"), seed, "replicate", "slot").cast("int").alias("number"))
    return drawn.groupBy("replicate", "number").agg(F.count("*").alias("times")).join(listed, "number").select("replicate", "component", "times")


def times_drawn(components: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(component, times): ``multiplicities`` with a byte for each replicate in a row; a component that no
    replicate draws has a row as well."""
    spark = components.sparkSession
    listed = checkpointed(running(components.select("component").distinct(), [], "component", {"number": F.lit(1)}).select("component", (F.col("number") - 1).cast("long").alias("number")))
    n, most, shard = listed.count(), RANGE // SHARD * SHARD, SHARD
    parts = max(1, -(-n // most))
    tasks = min(replicates * parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                replicate, low = i // parts, i % parts * most
                high = min(n, low + most)
                counted = np.zeros(high - low, np.int64)
                for start in range(0, n, AT_ONCE):
                    number = below_each(n, seed, replicate, start, min(n, start + AT_ONCE))
                    number = number if parts == 1 else number[(number >= low) & (number < high)]
                    counted += np.bincount(number - low, minlength=high - low)
                if counted.max(initial=0) > 255:
                    raise OverflowError("a replicate draws a component more than 255 times")
                data = counted.astype(np.uint8).tobytes()
                cut = range(0, len(data), shard)
                columns = [pa.array([(low + c) // shard for c in cut], pa.int64()), pa.array([replicate] * len(cut), pa.int32()), pa.array([data[c : c + shard] for c in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "replicate", "times"])

    def turn(table: pa.Table) -> pa.Table:
        (first,) = set(table.column("shard").to_pylist())
        data = table.column("times").to_pylist()
        turned = np.zeros((replicates, len(data[0])), np.uint8)
        for replicate, times in zip(table.column("replicate").to_pylist(), data, strict=True):
            turned[replicate] = np.frombuffer(times, np.uint8)
        numbers = first * shard + np.arange(turned.shape[1], dtype=np.int64)
        return pa.Table.from_arrays([pa.array(numbers), pa.array([x.tobytes() for x in np.ascontiguousarray(turned.T)], pa.binary())], ["number", "times"])

    counts = spark.range(0, replicates * parts if n else 0, 1, tasks).mapInArrow(draw, "shard long, replicate int, times binary")
    turned = counts.groupBy("shard").applyInArrow(turn, "number long, times binary")
    return listed.join(turned, "number").select("component", "times")


def weighed(batch: pa.RecordBatch, replicates: int, *names: str) -> Iterator[tuple]:
    """Blocks of rows (times, lists...) of an Arrow batch: (times as numbers, by row and replicate; the row
    that each entry of the lists is in; entries of each list), at most ``ROWS`` and about ``ENTRIES`` of them."""
    lists = [batch.column(batch.schema.get_field_index(name)) for name in names]
    bytes_, size = batch.column(batch.schema.get_field_index("times")), np.asarray(lists[0].value_lengths())
    a = 0
    while a < len(batch):
        b = a + 1 + int(np.searchsorted(np.cumsum(size[a + 1 : a + ROWS]) + size[a], ENTRIES, "right"))
        times = np.frombuffer(b"".join(bytes_.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, replicates).astype(float)
        yield times, np.repeat(np.arange(b - a), size[a:b]), *(np.asarray(x.slice(a, b - a).flatten()) for x in lists)
        a = b


def of_each(row: np.ndarray, key: np.ndarray, keys: int, values: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sum of ``values`` of entries by key and replicate, as often as each replicate takes their row."""
    by = np.bincount(key * len(times) + row, values, keys * len(times)).reshape(keys, len(times))
    return by @ times


def score_lists(scored: DataFrame) -> DataFrame:
    """(component, score, p, pos, neg as lists): a component's different scores, about ``SCORES`` in a row.

    ``score`` tells which one of several scores of the same pairs it is."""
    counts = scored.groupBy("component", "score", F.coalesce("p", F.lit(-math.inf)).alias("p")).agg(F.coalesce(F.sum("y"), F.lit(0)).cast("double").alias("pos"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).cast("double").alias("neg"))
    size = counts.groupBy("component").agg(F.ceil(F.count("*") / SCORES).alias("slices"))
    dealt = counts.join(size, "component").withColumn("slice", F.pmod(F.xxhash64("score", "p"), F.col("slices")))
    rows = dealt.groupBy("component", "slice").agg(F.collect_list(F.struct("score", "p", "pos", "neg")).alias("s"))
    return rows.select("component", *(F.col(f"s.{c}").alias(c) for c in ("score", "p", "pos", "neg")))


def bootstraps(scored: DataFrame, replicates: int = 200, seed: int = SEED) -> DataFrame:
    """(score, replicate, roc_auc) of rows (component, score, y, p): several scores in the same replicates,
    over components drawn with replacement, as weights."""
    rows = checkpointed(score_lists(scored))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sums = np.stack(list(held.values())) if held else np.zeros((0, 2, replicates))
            at, replicate = np.nonzero(sums.any(axis=1))
            score, p = np.array([k[0] for k in held], np.int32), np.array([k[1] for k in held], float)
            columns = [pa.array(score[at]), pa.array(replicate.astype(np.int32)), pa.array(p[at]), *(pa.array(sums[at, i, replicate].astype(np.int64)) for i in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["score", "replicate", "p", "pos", "neg"])

        for batch in batches:
            for times, row, score, p, pos, neg in weighed(batch, replicates, "score", "p", "pos", "neg"):
                for s in np.unique(score).tolist():
                    mine = score == s
                    found, key = np.unique(p[mine], return_inverse=True)
                    sums = np.stack([of_each(row[mine], key, len(found), x[mine], times) for x in (pos, neg)], axis=1)
                    for k, v in zip(found.tolist(), sums, strict=True):
                        held[s, k] = held[s, k] + v if (s, k) in held else v
                if len(held) > HELD:
                    yield out()
        yield out()

    parts = rows.join(times_drawn(rows, replicates, seed), "component").mapInArrow(add, "score int, replicate int, p double, pos long, neg long")
    counts = parts.groupBy(F.struct("score", "replicate").alias("grp"), "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return area(counts).select("grp.score", "grp.replicate", "roc_auc")


def bootstrap(scored: DataFrame, replicates: int = 200, seed: int = SEED) -> DataFrame:
    """(replicate, roc_auc) over components drawn with replacement, as weights.

    A component's counts of scores are made once, and weighed before anything is sorted."""
    return bootstraps(scored.select("component", F.lit(0).alias("score"), "y", "p"), replicates, seed).drop("score")


def bootstrap_pair(first: DataFrame, second: DataFrame, replicates: int = 200, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``bootstrap`` of two scores of the same components, with the draws made once."""
    both = first.select("component", F.lit(0).alias("score"), "y", "p").union(second.select("component", F.lit(1), "y", "p"))
    found = checkpointed(bootstraps(both, replicates, seed))
    return tuple(found.filter(F.col("score") == i).select("replicate", "roc_auc") for i in (0, 1))


def interval(replicates: DataFrame, null: float = 0.5) -> DataFrame:
    """One row: valid replicates, the 95 % percentile interval, and the two-sided p-value."""
    q = F.percentile("roc_auc", F.array(F.lit(0.025), F.lit(0.975)))
    up, down = F.avg((F.col("roc_auc") >= null).cast("double")), F.avg((F.col("roc_auc") <= null).cast("double"))
    found = replicates.filter("roc_auc IS NOT NULL").agg(F.count("*").alias("valid"), q.alias("q"), F.least(F.lit(1.0), 2 * F.least(up, down)).alias("p"))
    return found.select("valid", F.round(F.col("q")[0], DIGITS).alias("low"), F.round(F.col("q")[1], DIGITS).alias("high"), F.round("p", DIGITS).alias("p_value"))


def adjusted(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(family, test, p) with ``p_adj`` and ``reject`` by Benjamini and Hochberg in each family.

    Null p-values take no part and stay null. Equal ones share the rank of the last, which the running
    minimum gives them anyway; so different values are enough, and a family needn't meet in a task."""
    real = checkpointed(tests.filter("p IS NOT NULL"))
    counts = running(real.groupBy("family", "p").agg(F.count("*").alias("n")), ["family"], "p", {"rank": F.col("n")})
    raw = counts.select("family", "p", (F.col("p") * F.col("all_rank") / F.col("rank")).alias("raw"))
    least = running(raw, ["family"], "p", least={"above": F.col("raw")}, descending=True)
    p_adj = least.select("family", "p", F.round(F.least(F.lit(1.0), "raw", "above"), 9).alias("p_adj"))
    done = real.join(p_adj, ["family", "p"]).select("family", "test", "p", "p_adj").withColumn("reject", F.col("p_adj") <= alpha)
    return done.union(tests.filter("p IS NULL").select("family", "test", "p", F.lit(None).cast("double"), F.lit(False)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """The chance that Student's t with ``df`` degrees of freedom lies as far from 0 as t, either side."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(df / 2 + 0.5) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x))
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        return front * _beta_fraction(df / 2, 0.5, x) / (df / 2)
    return 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5


def t_quantile(share: float, df: float) -> float:
    """The value that Student's t stays below with chance ``share`` over a half, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < share else (low, mid)
    return (low + high) / 2


_INTERVAL = T.StructType([T.StructField(name, T.DoubleType()) for name in ("low", "high", "p_value")])


@F.pandas_udf(_INTERVAL)
def t_interval(estimate: pd.Series, variance: pd.Series, groups: pd.Series) -> pd.DataFrame:
    """The 95 % interval around an estimate and its p-value against 0.5, with groups - 1 degrees."""
    rows = []
    for e, v, g in zip(estimate, variance, groups, strict=True):
        if g < 2 or v is None or math.isnan(v):
            rows.append((None, None, None))
        elif v == 0:
            rows.append((e, e, 1.0 if e == 0.5 else 0.0))
        else:
            half = t_quantile(0.975, g - 1) * math.sqrt(v)
            rows.append((e - half, e + half, t_two_sided((e - 0.5) / math.sqrt(v), g - 1)))
    return pd.DataFrame(rows, columns=["low", "high", "p_value"])


def welch(x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> dict[str, Column]:
    """Difference, its standard error and degrees of freedom of two (estimate, variance, groups)."""
    (ex, vx, gx), (ey, vy, gy) = x, y
    both = vx + vy
    return {"difference": ex - ey, "se": F.sqrt(both), "df": F.try_divide(both * both, vx * vx / (gx - 1) + vy * vy / (gy - 1))}


def paired_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(replicate, roc_auc) with the difference of two scores' areas in the same replicates."""
    x, y = first.select("replicate", F.col("roc_auc").alias("x")), second.select("replicate", F.col("roc_auc").alias("y"))
    return x.join(y, "replicate").select("replicate", F.round(F.col("x") - F.col("y"), DIGITS).alias("roc_auc"))


def mean_differences(values: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, difference) of the means of side 1 and side 0 of (side, key, x), either side drawn
    with replacement: each row is taken a Poisson number of times, drawn for itself.

    A row needs no other row for its draws, so sides of any size are drawn without numbering them."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("side").cast("string"), F.col("key").cast("string"), F.col("replicate").cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    cumulative, term = [], math.exp(-1)
    total = 0.0
    for k in range(12):
        total += term
        cumulative.append(round(total, 12))
        term /= k + 1
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cumulative), F.lit(0))
    drawn = values.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("times", times)
    mean = lambda side: F.try_divide(F.sum(F.when(F.col("side") == side, F.col("times") * F.col("x"))), F.sum(F.when(F.col("side") == side, F.col("times"))))
    return drawn.groupBy("replicate").agg(F.round(mean(1) - mean(0), DIGITS).alias("difference"))


def unpaired_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(place, difference) of two scores' areas in replicates of their own: the valid ones of either are
    numbered, and paired by number as far as both go."""
    listed = lambda df, name: running(df.filter("roc_auc IS NOT NULL").select("replicate", F.col("roc_auc").alias(name)), [], "replicate", {"place": F.lit(1)}).select("place", name)
    return listed(first, "x").join(listed(second, "y"), "place").select("place", F.round(F.col("x") - F.col("y"), DIGITS).alias("difference"))


def paired_jackknife(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: the difference of two scores' areas over the same components, and its delete-one variance.

    Components that leave one class with either score don't count."""
    first, second = checkpointed(first), checkpointed(second)
    x, y = (without_each(df).filter("roc_auc IS NOT NULL").select("component", F.col("roc_auc").alias(n)) for df, n in ((first, "x"), (second, "y")))
    v = x.join(y, "component").agg(F.count("*").alias("components"), F.var_pop(F.col("x") - F.col("y")).alias("v"))
    full = [roc_auc(df.withColumn("grp", F.lit(0))).select(F.col("roc_auc").alias(n)) for df, n in ((first, "full_x"), (second, "full_y"))]
    one = v.join(full[0]).join(full[1])  # one row each
    return one.select("components", F.round(F.col("full_x") - F.col("full_y"), DIGITS).alias("difference"), F.round(F.when(F.col("components") >= 2, (F.col("components") - 1) * F.col("v")), 12).alias("variance"))


@F.pandas_udf(T.DoubleType())
def t_p_value(estimate: pd.Series, se: pd.Series, df: pd.Series) -> pd.Series:
    """The two-sided p-value of an estimate against 0 by Student's t; 1 or 0 without a standard error."""
    rows = [None if pd.isna(e) or pd.isna(s) or pd.isna(d) or d <= 0 else (1.0 if e == 0 else 0.0) if s == 0 else t_two_sided(e / s, d) for e, s, d in zip(estimate, se, df, strict=True)]
    return pd.Series(rows, dtype="float64")


def kolmogorov_p(ks: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sample p-value of a Kolmogorov-Smirnov distance."""
    root = F.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * ks
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 101)), F.lit(0.0))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def weighted_mean_bootstrap(rows: DataFrame, replicates: int, seed: int = SEED) -> DataFrame:
    """(replicate, difference) of the means of x on side 1 and side 0 of rows (component, side, x), over
    components drawn with replacement: a component's sums are made once."""
    sums = rows.groupBy("component", "side").agg(F.coalesce(F.sum("x"), F.lit(0)).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    lists = checkpointed(sums.groupBy("component").agg(F.collect_list(F.struct("side", "s", "n")).alias("s")).select("component", *(F.col(f"s.{c}").alias(c) for c in ("side", "s", "n"))))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, replicates))  # of side 0 and 1: sums and numbers
        for batch in batches:
            for times, row, side, s, n in weighed(batch, replicates, "side", "s", "n"):
                total += np.stack([of_each(row, side, 2, x, times) for x in (s, n)], axis=1)
        if not total.any():
            return
        columns = [pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(x) for x in total.reshape(4, replicates))]
        yield pa.RecordBatch.from_arrays(columns, ["replicate", "s0", "n0", "s1", "n1"])

    parts = lists.join(times_drawn(lists, replicates, seed), "component").mapInArrow(add, "replicate int, s0 double, n0 double, s1 double, n1 double")
    mean = lambda side: F.try_divide(F.sum(f"s{side}"), F.sum(f"n{side}"))
    return parts.groupBy("replicate").agg(F.round(mean(1) - mean(0), DIGITS).alias("difference"))
