"""Labels of findings, the penalty per finding and the error counts per pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and column names that results must carry.
PRESENCE = ("POSITIVE", "NEGATIVE", "UNCERTAIN")
NOT_MENTIONED = "NOT MENTIONED"
DIAGNOSIS_LABELS = ("concordant", "partial", "discordant")
DETAIL_LABELS = ("concordant", "partial", "discordant", "not mentioned", "candidate-adds", "candidate-misses")
DISCREPANCIES = ("missing_in_candidate", "extra_in_candidate", "absent")
BUCKETS_A = ("false_prediction", "omission_finding", "incorrect_location", "incorrect_severity", "extra_comparison", "omitted_comparison")
BUCKETS_B = (*BUCKETS_A, "partial")
SUFFIXES = ("insignificant", "significant")
COUNTS_A = tuple(f"{b}_{s}" for b in BUCKETS_A for s in SUFFIXES)
COUNTS_B = tuple(f"{b}_{s}" for b in BUCKETS_B for s in SUFFIXES)
#: Rating categories 1 to 6 of benchmark A, in the order of ``BUCKETS_A``.
CATEGORY_BUCKET = {i + 1: b for i, b in enumerate(BUCKETS_A)}
#: Columns one to eight of benchmark B; seven and eight are partial errors.
WIDE_BUCKET = dict(zip(("one", "two", "three", "four", "five", "six"), BUCKETS_A)) | {"seven": "partial", "eight": "partial"}
SIGNIFICANT_FROM = {"a": 2, "b": 3}

DIAGNOSIS, LOCATION, SEVERITY, TEMPORAL, KIND, SCORE = "diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison", "discrepancy_type", "significance_score"


def _is(column: str, *labels: str) -> Column:
    return F.coalesce(F.col(column).isin(*labels), F.lit(False))


def _one(c: Column) -> Column:
    return c.cast("int")


def score_or_zero() -> Column:
    """The significance of a finding; an absent one counts as 0."""
    return F.coalesce(F.col(SCORE), F.lit(0))


def penalty() -> Column:
    """Significance times the number of differing aspects of a finding.

    A partial diagnosis weighs as much as a discordant one; unknown and absent labels weigh
    nothing. So missing and extra findings, all "not mentioned", score 0.
    """
    wrong = ("partial", "discordant", "candidate-adds", "candidate-misses")
    aspects = _one(_is(DIAGNOSIS, "partial", "discordant")) + reduce(Column.__add__, [_one(_is(c, *wrong)) for c in (LOCATION, SEVERITY, TEMPORAL)])
    return (score_or_zero() * aspects).cast("double")


def _hits(variant: str) -> dict[str, Column]:
    """How often a finding counts in each bucket."""
    extra, missing = _is(KIND, "extra_in_candidate"), _is(KIND, "missing_in_candidate")
    omitted = _one(_is(TEMPORAL, "candidate-misses"))
    if variant == "a":
        four = ("discordant", "partial", "candidate-misses", "candidate-adds")
        return {
            "false_prediction": _one(_is(DIAGNOSIS, "discordant", "partial") | extra | _is(TEMPORAL, "discordant")),
            "omission_finding": _one(missing),
            "incorrect_location": _one(_is(LOCATION, *four)),
            "incorrect_severity": _one(_is(SEVERITY, *four)),
            "extra_comparison": _one(_is(TEMPORAL, "candidate-adds", "partial")),
            "omitted_comparison": omitted,
        }
    three = ("discordant", "candidate-adds", "candidate-misses")
    false = _is(DIAGNOSIS, "discordant") | extra
    return {
        "false_prediction": _one(false),
        "omission_finding": _one(missing),
        "incorrect_location": _one(_is(LOCATION, *three)),
        "incorrect_severity": _one(_is(SEVERITY, *three)),
        "extra_comparison": _one(_is(TEMPORAL, "candidate-adds")),
        "omitted_comparison": omitted,
        "partial": _one(~false & _is(DIAGNOSIS, "partial")) + reduce(Column.__add__, [_one(_is(c, "partial")) for c in (LOCATION, SEVERITY, TEMPORAL)]),
    }


def count_columns(variant: str) -> list[Column]:
    """Aggregates: 12 (variant a) or 14 (variant b) counts of a pair. Score 0 counts nowhere; a finding may count in several buckets."""
    limit = SIGNIFICANT_FROM[variant]
    score = score_or_zero()
    in_class = {"significant": score >= limit, "insignificant": (score > 0) & (score < limit)}
    hits = _hits(variant)
    names = COUNTS_A if variant == "a" else COUNTS_B
    out = []
    for n in names:
        bucket, _, suffix = n.rpartition("_")
        out.append(F.coalesce(F.sum(F.when(in_class[suffix], hits[bucket]).otherwise(0)), F.lit(0)).cast("bigint").alias(n))
    return out


def totals(names: tuple[str, ...]) -> dict[str, Column]:
    """Row-wise sums of count columns, nulls as 0: all, significant and insignificant ones."""
    add = lambda cols: reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    return {
        "total_errors": add(names),
        "total_significant": add([n for n in names if n.endswith("_significant")]),
        "total_insignificant": add([n for n in names if n.endswith("_insignificant")]),
    }
