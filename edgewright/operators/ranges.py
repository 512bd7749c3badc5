"""Running sums, numbers and quantiles of tables of any size: windows within slices of bounded size.

A running value of a row is that within its slice of the order plus what all slices before it hold.
Slices lie between approximate quantiles of the order, so neither one huge group nor a table that is
one group meets in a task; a table below ``SLICE`` rows is one slice.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a slice, about, and the most slices.
SLICE, MOST_SLICES = 1 << 20, 1 << 10


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in ``spark.checkpoint.dir``; in a local session, which shares its
    folders, one of our own is set where that is unset."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Checkpoints within it are deleted at its end, and shuffle files with the queries that made them, but
    what the function that it gives is called with stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.sparkContext.getCheckpointDir():
        checkpointed(spark.range(0))
    home, before = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0], spark.conf.get(key, None)  # Spark adds a folder of its own
    spark.sparkContext.setCheckpointDir(f"{home}/scratch")
    mine = [spark.sparkContext.getCheckpointDir()]
    spark.conf.set(key, "true")

    def kept(df: DataFrame) -> DataFrame:
        spark.sparkContext.setCheckpointDir(home)
        try:
            return df.checkpoint()
        finally:
            spark.sparkContext.setCheckpointDir(f"{home}/scratch")
            mine.append(spark.sparkContext.getCheckpointDir())

    try:
        yield kept
    finally:
        spark.sparkContext.setCheckpointDir(home)
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, mine):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, group: list[str], by: str, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, descending: bool = False) -> DataFrame:
    """``df`` with running sums, a row itself included, ``all_<name>``, each group's sum, and the minima
    over the rows before a row.

    ``by`` is a column of numbers or dates that differs between the rows of a group."""
    sums, least = sums or {}, least or {}
    rows = checkpointed(df)
    n = rows.count()
    step = F.desc(by) if descending else F.asc(by)
    if n <= SLICE:
        up, every = Window.partitionBy(*group).orderBy(step), Window.partitionBy(*group)
        to, past = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, -1)
        found = {x: F.sum(c).over(to) for x, c in sums.items()} | {x: F.min(c).over(past) for x, c in least.items()} | {f"all_{x}": F.sum(c).over(every) for x, c in sums.items()}
        return rows.withColumns(found)
    slices = min(MOST_SLICES, -(-n // SLICE) + 1)
    number = F.col(by).cast("double")
    cuts = rows.agg(F.percentile_approx(number, [i / slices for i in range(1, slices)], 100 * slices).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda e: e < number))
    sliced = checkpointed(rows.join(F.broadcast(cuts)).withColumn("_slice", -below if descending else below).drop("_cuts"))  # one row of MOST_SLICES numbers
    parts = sliced.groupBy(*group, "_slice").agg(*(F.sum(c).alias(f"_{x}") for x, c in sums.items()), *(F.min(c).alias(f"_{x}") for x, c in least.items()))
    before, every = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    ahead = parts.select(*group, "_slice", *(F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_{x}") for x in sums), *(F.min(f"_{x}").over(before).alias(f"_{x}") for x in least), *(F.sum(f"_{x}").over(every).alias(f"all_{x}") for x in sums))
    within = Window.partitionBy(*group, "_slice").orderBy(step)
    to, past = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.withColumns({f"_own_{x}": F.sum(c).over(to) for x, c in sums.items()} | {f"_own_{x}": F.min(c).over(past) for x, c in least.items()})
    joined = own.join(ahead, [*group, "_slice"])
    found = {x: F.col(f"_own_{x}") + F.col(f"_{x}") for x in sums} | {x: F.least(f"_own_{x}", f"_{x}") for x in least}
    return joined.withColumns(found).select(*rows.columns, *sums, *least, *(f"all_{x}" for x in sums))


def quantiles(df: DataFrame, group: list[str], x: str, shares: list[float], name: str) -> DataFrame:
    """Per group, the quantiles of ``x`` as an array, interpolated between neighbours; nulls don't count."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*group, x).agg(F.count("*").alias("_n"))
    up = running(counts, group, x, {"_up": F.col("_n")})

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("_all") - 1)
        return F.struct(F.min(F.when(F.col("_up") > F.floor(place), F.col(x))).alias("low"), F.min(F.when(F.col("_up") > F.ceil(place), F.col(x))).alias("high"), F.max(place - F.floor(place)).alias("part"))

    found = up.withColumnRenamed("all__up", "_all").groupBy(*group).agg(*(at(s).alias(f"_{i}") for i, s in enumerate(shares)))
    value = lambda i: F.col(f"_{i}.low") + (F.col(f"_{i}.high") - F.col(f"_{i}.low")) * F.col(f"_{i}.part")
    return found.select(*group, F.array(*(value(i).cast("double") for i in range(len(shares)))).alias(name))
