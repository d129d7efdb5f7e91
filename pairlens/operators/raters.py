"""Tables of human raters' error counts, and their comparison with computed ones."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CATEGORY_BUCKET, COUNTS_A, COUNTS_B, WIDE_BUCKET, totals
from .correlation import correlate

KEYS = ["study_id", "candidate_type"]


def bucket() -> Column:
    """Count column of a rating, null for an unmapped category or an unknown significance."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CATEGORY_BUCKET.items()))
    suffix = F.when(F.col("clinically_significant"), "significant").when(~F.col("clinically_significant"), "insignificant")
    return F.concat(F.try_element_at(names, F.col("error_category")), F.lit("_"), suffix)


def rater_table(ratings: DataFrame, studies: DataFrame) -> DataFrame:
    """Benchmark A: sums of errors per study, candidate and rater in 12 columns, with totals.

    The study comes from its number; ratings of unknown studies, with null
    keys or in no bucket are left out. Sums of conditional values need no pivot, so one shuffle after partial sums.
    """
    ids = studies.select("study_number", F.col("study_id"))
    r = ratings.drop("study_id").withColumn("_b", bucket()).where(F.col("_b").isNotNull()).join(ids, "study_number")
    r = r.dropna(subset=["study_id", "candidate_type", "rater_index"])
    sums = [F.coalesce(F.sum(F.when(F.col("_b") == c, F.col("num_errors"))), F.lit(0)).cast("bigint").alias(c) for c in COUNTS_A]
    return r.groupBy(*KEYS, "rater_index").agg(*sums).withColumns(totals(COUNTS_A))


def average_rater(table: DataFrame) -> DataFrame:
    """Mean over the raters that have a row for the pair."""
    names = [c for c in table.columns if c not in (*KEYS, "rater_index")]
    return table.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in names])


def rater_table_wide(rows: DataFrame, key: str = "report_id") -> DataFrame:
    """Benchmark B: columns ``one`` to ``eight`` by error type become 14 columns per report; absent types are 0."""
    out = []
    for c in COUNTS_B:
        b, _, suffix = c.rpartition("_")
        source = reduce(Column.__add__, [F.coalesce(F.col(w), F.lit(0)) for w, x in WIDE_BUCKET.items() if x == b])
        out.append(F.coalesce(F.sum(F.when(F.col("error_type") == suffix, source)), F.lit(0)).cast("bigint").alias(c))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("study_id")).agg(*out).withColumns(totals(COUNTS_B))


def long_pairs(ours: DataFrame, theirs: DataFrame, on: list[str], columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Joined once, then one row per compared column: ``extra, column_name, ours, rater``. Columns absent on either side are skipped."""
    kept = [c for c in columns if c in ours.columns and c in theirs.columns]
    a = ours.select(*on, *[F.col(c).cast("double").alias(f"a_{c}") for c in kept])
    b = theirs.select(*on, *(extra or []), *[F.col(c).cast("double").alias(f"b_{c}") for c in kept])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").alias("ours"), F.col(f"b_{c}").alias("rater")) for c in kept]))
    return a.join(b, on).select(*(extra or []), pairs.alias("p")).select(*(extra or []), "p.*")


def compare(ours: DataFrame, theirs: DataFrame, on: list[str], columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Tau-b, rho and mean absolute error of each column, over all rows or per ``extra``."""
    return correlate(long_pairs(ours, theirs, on, columns, extra), [*(extra or []), "column_name"], "ours", "rater")


def score_against_counts(ours: DataFrame, score: str, targets: list[str]) -> DataFrame:
    """The pair score against the pair's own totals."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(score).alias("ours"), F.col(c).cast("double").alias("rater")) for c in targets]))
    return correlate(ours.select(pairs.alias("p")).select("p.*"), ["column_name"], "ours", "rater")


def collate_wide(long: DataFrame, models: list[str], stats: list[str]) -> DataFrame:
    """One row per column, one column ``model__stat`` per model and statistic; models are given, so no extra job looks for them."""
    cells = [F.max(F.when(F.col("model") == m, F.col(s))).alias(f"{m}__{s}") for m in models for s in stats]
    return long.groupBy("column_name").agg(*cells)


def scatter(ours: DataFrame, theirs: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Points of a scatter plot per column, equal ones counted, with the limits of both axes: ``column_name, ours, rater, n, low, high``."""
    points = long_pairs(ours, theirs, on, columns).groupBy("column_name", "ours", "rater").agg(F.count("*").alias("n"))
    limits = points.groupBy("column_name").agg((F.least(F.min("ours"), F.min("rater")) - 0.5).alias("low"), (F.greatest(F.max("ours"), F.max("rater")) + 0.5).alias("high"))
    return points.join(limits, "column_name").select("column_name", "ours", F.round("rater", 6).alias("rater"), "n", "low", "high")
