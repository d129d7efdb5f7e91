"""Agreement of two numeric columns per group: Kendall's tau-b, Spearman's rho, mean absolute error."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .running import cells, ranges_for, sum_below, with_ranges

MIN_ROWS = 3


def _tie_sums(c: DataFrame, group: list[str], v: str) -> DataFrame:
    t = c.groupBy(*group, v).agg(F.sum("n").cast("double").alias("t"))
    p = F.col("t") * (F.col("t") - 1)
    return t.groupBy(*group).agg((F.sum(p) / 2).alias(f"ties_{v}"), F.sum(p * (2 * F.col("t") + 5)).alias(f"v_{v}"), F.sum(p * (F.col("t") - 2)).alias(f"w_{v}"))


def _concordance(c: DataFrame, group: list[str], ranges: int) -> DataFrame:
    """``con``, ``dis``: pairs of rows that both columns order alike, or against each other.

    Two places in the order of x differ first in some binary digit. So at each digit the cells with a 0
    there are set against those with a 1 that agree in all higher digits, by sums running over y.
    The work is cells times the number of digits; no pairs of cells arise.
    """
    xs = with_ranges(c.select(*group, "x").distinct().withColumn("_one", F.lit(1)), group, "x", ranges)
    places = sum_below(xs, group, "x", "_one", "_place", ranges).select(*group, "x", F.col("_place").cast("long").alias("_place"))
    placed = cut(with_ranges(c.join(places, [*group, "x"]), group, "y", ranges))
    top = placed.agg(F.max("_place")).first()[0] or 0
    digits = F.explode(F.array(*[F.lit(i) for i in range(max(1, int(top).bit_length()))]))
    at = placed.withColumn("_digit", digits)
    at = at.withColumn("_block", F.expr("shiftright(_place, _digit + 1)")).withColumn("_bit", F.expr("shiftright(_place, _digit) & 1"))
    g = [*group, "_digit", "_block"]
    sums = [F.sum(F.when(F.col("_bit") == bit, F.col("n")).otherwise(0)).alias(name) for bit, name in ((0, "give"), (1, "take"))]
    by_y = at.groupBy(*g, "y", "_range").agg(*sums)
    low = sum_below(by_y, g, "y", "give", "less", ranges)
    whole = by_y.groupBy(*g).agg(F.sum("give").alias("all"))
    both = low.withColumn("all", F.sum("give").over(Window.partitionBy(*g))) if ranges == 1 else low.join(whole, g)
    d = lambda x: F.col(x).cast("double")
    counted = both.groupBy(*group).agg(F.sum(d("take") * d("less")).alias("con"), F.sum(d("take") * (d("all") - d("less") - d("give"))).alias("dis"))
    return c.select(*group).distinct().join(counted, group, "left").fillna(0.0, ["con", "dis"])


def _mid_ranks(c: DataFrame, group: list[str], v: str, ranges: int) -> DataFrame:
    values = with_ranges(c.groupBy(*group, v).agg(F.sum("n").alias("t")), group, v, ranges)
    below = sum_below(values, group, v, "t", "below", ranges)
    return below.select(*group, v, (F.col("below") + (F.col("t") + 1) / 2).alias(f"r_{v}"))


def _spearman(c: DataFrame, group: list[str], ranges: int) -> DataFrame:
    r = c.join(_mid_ranks(c, group, "x", ranges), [*group, "x"]).join(_mid_ranks(c, group, "y", ranges), [*group, "y"])
    w = F.col("n").cast("double")
    n = F.sum(w)
    mean = (n + 1) / 2
    # Mid-ranks have the mean (n + 1) / 2 whatever the ties.
    cov = F.sum(w * F.col("r_x") * F.col("r_y")) - n * mean * mean
    vx = F.sum(w * F.col("r_x") * F.col("r_x")) - n * mean * mean
    vy = F.sum(w * F.col("r_y") * F.col("r_y")) - n * mean * mean
    return r.groupBy(*group).agg(F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(cov, F.sqrt(vx * vy))).alias("spearman"))


def correlate(df: DataFrame, group: list[str], x: str, y: str, ranges: int | None = None) -> DataFrame:
    """``group, tau, p_tau, spearman, p_spearman, mae, n_samples`` over rows where both columns are there.

    A constant column leaves tau, rho and their p-values null; so do fewer than
    two rows. Groups without any complete row are left out. Sums run within ``ranges`` of values, as many as the table needs.
    """
    c = cells(df, group, x, y)
    ranges = ranges or ranges_for(c.count())
    n = F.sum("n").cast("double")
    base = c.groupBy(*group).agg(F.sum("n").alias("n_samples"), (F.sum(F.abs(F.col("x") - F.col("y")) * F.col("n")) / n).alias("mae"))
    tau = base.join(_tie_sums(c, group, "x"), group).join(_tie_sums(c, group, "y"), group).join(_concordance(c, group, ranges), group)
    m = F.col("n_samples").cast("double")
    pairs = m * (m - 1) / 2
    free = (pairs - F.col("ties_x")) * (pairs - F.col("ties_y"))
    tau = tau.withColumn("tau", F.when(free > 0, (F.col("con") - F.col("dis")) / F.sqrt(free)))
    both = tau.join(_spearman(c, group, ranges), group)
    p_tau = _p_tau("n_samples", "con", "dis", "ties_x", "ties_y", "v_x", "v_y", "w_x", "w_y", "tau")
    return both.select(*group, "tau", p_tau.alias("p_tau"), "spearman", _p_rho("spearman", "n_samples").alias("p_spearman"), "mae", "n_samples")


def exact_tau_p(n: int, con: int) -> float:
    """Two-sided probability of at most so few concordant or discordant pairs, without ties."""
    c = int(min(con, n * (n - 1) // 2 - con))
    ways = [1.0]
    for k in range(2, n + 1):
        longer = [0.0] * min(len(ways) + k - 1, c + 1)
        run = 0.0
        for i in range(len(longer)):
            run += ways[i] if i < len(ways) else 0.0
            if i >= k:
                run -= ways[i - k] if i - k < len(ways) else 0.0
            longer[i] = run
        ways = [w / k for w in longer]
    return min(1.0, 2 * sum(ways[: c + 1])) if 4 * c != n * (n - 1) else 1.0


def normal_tau_p(n: float, con: float, dis: float, tx: float, ty: float, vx: float, vy: float, wx: float, wy: float) -> float | None:
    m = n * (n - 1)
    v = (m * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / m + (wx * wy / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(con - dis) / math.sqrt(v) / math.sqrt(2)) if v > 0 else None


def student_p(rho: float, n: float) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for i in range(1, 400):
        for k in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def _p_tau_udf(n: pd.Series, con: pd.Series, dis: pd.Series, tx: pd.Series, ty: pd.Series, vx: pd.Series, vy: pd.Series, wx: pd.Series, wy: pd.Series, tau: pd.Series) -> pd.Series:
    def one(r) -> float | None:
        if r[9] is None or r[9] != r[9]:
            return None
        pairs = r[0] * (r[0] - 1) / 2
        if not r[3] and not r[4] and (r[0] <= 33 or min(r[1], pairs - r[1]) <= 1):
            return exact_tau_p(int(r[0]), int(r[1]))
        return normal_tau_p(*r[:9])

    return pd.Series([one(r) for r in zip(n, con, dis, tx, ty, vx, vy, wx, wy, tau)], dtype="Float64")


def _p_tau(*names: str) -> Column:
    return _p_tau_udf(*names)


@F.pandas_udf(T.DoubleType())
def _p_rho_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or r != r else student_p(r, k) for r, k in zip(rho, n)], dtype="Float64")


def _p_rho(rho: str, n: str) -> Column:
    return _p_rho_udf(rho, n)


def complete_groups(df: DataFrame, group: list[str], x: str, y: str, least: int = MIN_ROWS) -> DataFrame:
    """Complete rows of groups that have ``least`` of them or more."""
    full = df.dropna(subset=[x, y])
    enough = full.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return full.join(enough, group, "left_semi") if group else full
