"""Findings of report pairs: de-duplication, significance, scores and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..session import cut

PAIR = ["study_id", "candidate_reporter"]


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that leaves no ties; null keys are keys of their own.

    An aggregate, not a window: a partial one runs before the shuffle, so a key with very many rows is no hot task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_one(df, keys, [F.col(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def attach_significance(compared: DataFrame, scored: DataFrame) -> DataFrame:
    """Each compared row with its score and rationale, or nulls if it has none; ``scored`` has one row per pair and entity."""
    right = scored.select(*PAIR, "entity", "significance_score", "rationale")
    return compared.join(right, [*PAIR, "entity"], "left")


def significance_status(compared: DataFrame, scored: DataFrame) -> DataFrame:
    """Strict check per pair: ``n_missing`` entities without a score, ``n_extra`` scores without a row, ``status``.

    Status is failed where either is above 0, or else ok. Null entities match nothing and count.
    """
    a = compared.select(*PAIR, "entity", F.lit(1).alias("_c"), F.lit(0).alias("_s"))
    b = scored.select(*PAIR, "entity", F.lit(0).alias("_c"), F.lit(1).alias("_s"))
    per = a.unionByName(b).groupBy(*PAIR, "entity").agg(F.sum("_c").alias("c"), F.sum("_s").alias("s"))
    lone = F.col("entity").isNull()
    missing = F.when((F.col("s") == 0) | lone, F.col("c")).otherwise(0)
    extra = F.when((F.col("c") == 0) | lone, F.col("s")).otherwise(0)
    out = per.groupBy(*PAIR).agg(F.sum(missing).alias("n_missing"), F.sum(extra).alias("n_extra"))
    return out.withColumn("status", F.when((F.col("n_missing") > 0) | (F.col("n_extra") > 0), "failed").otherwise("ok"))


def pair_scores(findings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Sum of penalties per pair; of ``pairs`` those without findings score 0."""
    scores = findings.groupBy(*PAIR).agg(F.sum(labels.penalty()).alias("pair_score"))
    if pairs is None:
        return scores
    return pairs.select(*PAIR).distinct().join(scores, PAIR, "left").fillna(0.0, ["pair_score"])


def error_counts(findings: DataFrame, variant: str) -> DataFrame:
    """Counts per pair and the score, in one pass."""
    return findings.groupBy(*PAIR).agg(F.sum(labels.penalty()).alias("pair_score"), *labels.count_columns(variant))


def explode_cells(df: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """Rows ``keys, pos`` and the fields of each finding of a nested array; pairs without findings keep one row of nulls."""
    return df.select(*keys, F.posexplode_outer(cell).alias("pos", "finding")).select(*keys, "pos", "finding.*")


def summary(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles (interpolated) and greatest value of a column."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("least"), q.alias("q"), F.max(column).alias("most"))
    return s.select("n", "mean", "std", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "most")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the column's range, as a plot needs them: ``bin, low, high, n``."""
    df = cut(df.select(column))  # the range is needed before the bins
    r = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, width = r["lo"], ((r["hi"] - r["lo"]) or 1.0) / bins
    b = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def first_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` least distinct values of a column, nulls apart, in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(n)
