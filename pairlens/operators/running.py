"""Sums over all smaller values of a column, without one task per group.

Values are cut into ranges; range totals are summed up by a small window, and a
second window runs inside each range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of one range, about, and ranges at most.
RANGE_ROWS = 250_000
MOST_RANGES = 4096


def ranges_for(rows: int) -> int:
    """Number of ranges that keeps each of them small, were all rows of one group."""
    return max(1, min(MOST_RANGES, -(-rows // RANGE_ROWS)))


def with_ranges(df: DataFrame, group: list[str], x: str, ranges: int) -> DataFrame:
    """Adds ``_range``, a number that grows with ``x`` within each group: how many of the cuts are smaller, by bisection."""
    if ranges == 1:
        return df.withColumn("_range", F.lit(0))
    at = [i / ranges for i in range(1, ranges)]
    cuts = df.groupBy(*group).agg(F.percentile_approx(x, at, max(1000, 4 * ranges)).alias("_cuts"))
    steps = [1 << i for i in range(ranges.bit_length() - 1, -1, -1)]
    further = lambda p, s: F.when((p + s <= F.size("_cuts")) & (F.get("_cuts", p + s - 1) < F.col(x)), p + s).otherwise(p)
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    return df.join(cuts, group).withColumn("_range", found).drop("_cuts")


def sum_below(df: DataFrame, group: list[str], x: str, value: str, out: str, ranges: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the group with a smaller ``x`` (0 if none). ``df`` has ``_range``."""
    inside = Window.partitionBy(*group, "_range").orderBy(x).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*group, "_range").orderBy(x).rangeBetween(Window.currentRow, Window.currentRow)
    here = F.sum(value).over(inside) - F.sum(value).over(same)
    if ranges == 1:
        return df.withColumn(out, here)
    totals = df.groupBy(*group, "_range").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return df.join(totals, [*group, "_range"]).withColumn(out, F.col("_base") + here).drop("_base")


def cells(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Distinct pairs of values with their number of rows: ``group, x, y, n``. Written out, as several plans start here."""
    return cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("n")))
