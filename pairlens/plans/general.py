"""Queries of the general problems: rows that fail to parse, references to nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.orphans import find_orphans, orphan_report
from ..session import table
from ..sources.malformed import read_objects, read_records

# The columns and labels of a findings record.
DIAGNOSIS = ("concordant", "partial", "discordant", "not mentioned")
CONCORDANCE = (*DIAGNOSIS, "candidate-adds", "candidate-misses")
DISCREPANCY = ("", "missing_in_candidate", "extra_in_candidate", "absent")
FINDINGS_RECORD = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("study_id", T.StringType()),
            ("candidate_reporter", T.StringType()),
            ("pos", T.LongType()),
            ("entity", T.StringType()),
            ("reference_report_finding", T.StringType()),
            ("candidate_report_finding", T.StringType()),
            ("diagnosis_concordance", T.StringType()),
            ("location_concordance", T.StringType()),
            ("severity_concordance", T.StringType()),
            ("temporal_comparison", T.StringType()),
            ("discrepancy_type", T.StringType()),
            ("significance_score", T.IntegerType()),
            ("rationale", T.StringType()),
        )
    ]
)
# The keys of a rating object.
_PARTS = ("entity_name", "location", "severity", "uncertainty")
_ASPECTS = ("completeness", "readability", "clinical_utility")
RATING_KEYS = (
    {f"{p} {e}": "count" for p in _PARTS for e in ("false_prediction", "omission")}
    | {f"{p} {e}_explanation": "text" for p in _PARTS for e in ("false_prediction", "omission")}
    | {f"{a}_score": "score" for a in _ASPECTS}
    | {f"{a}_reason": "text" for a in _ASPECTS}
    | {"weighted_final_score": "score"}
)


def _filled(c: Column) -> Column:
    return c != ""


FINDINGS_CHECKS = (
    {c: _filled for c in ("study_id", "candidate_reporter", "entity")}
    | {"pos": lambda c: c.rlike(r"\A[0-9]+\z"), "significance_score": lambda c: c.rlike(r"\A[0-4]\z")}
    | {"diagnosis_concordance": lambda c: c.isin(*DIAGNOSIS), "discrepancy_type": lambda c: c.isin(*DISCREPANCY)}
    | {c: lambda c: c.isin(*CONCORDANCE) for c in ("location_concordance", "severity_concordance", "temporal_comparison")}
)


def findings_records(spark: SparkSession, d: str) -> DataFrame:
    return read_records(table(spark, d, "findings_raw"), "raw_line", FINDINGS_RECORD, FINDINGS_CHECKS)


def rating_objects(spark: SparkSession, d: str) -> DataFrame:
    return read_objects(table(spark, d, "gema_scores"), "eval_result", RATING_KEYS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    bad = lambda df, name, key: df.where("reason is not null").select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "reason")
    return bad(findings_records(spark, d), "findings_raw", "raw_id").unionByName(bad(rating_objects(spark, d), "gema_scores", "score_id"))


def p4_loaded_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings_records(spark, d).where("reason is null").select("raw_id", "record.*")


def p4_loaded_ratings(spark: SparkSession, d: str) -> DataFrame:
    r = rating_objects(spark, d).where("eval_result is not null and reason is null")
    return r.select("score_id", *[F.col(f"record.`{k}`").alias(k.replace(" ", "_")) for k in RATING_KEYS])


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table, source and reason; the reason of loaded rows is ``loaded``."""
    f = findings_records(spark, d).select(F.lit("findings_raw").alias("table_name"), F.col("file_name").alias("source"), F.coalesce("reason", F.lit("loaded")).alias("reason"))
    g = rating_objects(spark, d).where("eval_result is not null").select(F.lit("gema_scores").alias("table_name"), "source", F.coalesce("reason", F.lit("loaded")).alias("reason"))
    return f.unionByName(g).groupBy("table_name", "source", "reason").agg(F.count("*").alias("n_rows"))


def _references(spark: SparkSession, d: str) -> list[tuple]:
    studies, raters = table(spark, d, "studies"), table(spark, d, "rexval_raters")
    scored, compared = table(spark, d, "scored_entities"), table(spark, d, "compare_rows")
    pair = ["study_id", "candidate_reporter", "entity"]
    return [
        ("rexval_raters", "rating_id", "study_number", raters, studies, ["study_number"], "rated_at", "added_at", "deleted_at"),
        ("rexval_raters", "rating_id", "study_id", raters, studies, ["study_id"], "rated_at", "added_at", "deleted_at"),
        ("scored_entities", "scored_id", "entity", scored, compared, pair, "scored_at", "created_at", "deleted_at"),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, row, field, refs, targets, keys, at, start, end in _references(spark, d):
        found = find_orphans(refs.select(row, *keys, at), targets, keys, at, start, end)
        parts.append(found.select(F.lit(name).alias("table_name"), F.col(row).alias("row_id"), F.lit(field).alias("ref_field")))
    return reduce(DataFrame.unionByName, parts)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, _, field, refs, targets, keys, at, start, end in _references(spark, d):
        report = orphan_report(refs, targets, keys, at, start, end)
        counts = [F.col(c) for c in ("n_missing", "n_deleted", "n_later", "n_orphans")]
        parts.append(report.select(F.lit(name).alias("table_name"), F.lit(field).alias("ref_field"), F.date_format("period", "yyyy-MM").alias("month"), *counts))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {f.__name__: f for f in (p4_found, p4_loaded_findings, p4_loaded_ratings, p4_report, p5_found, p5_report)}

_LIVE = "NOT EXISTS (SELECT 1 FROM {t} t WHERE {on} AND t.{s} <= r.{at} AND (t.deleted_at IS NULL OR t.deleted_at > r.{at}))"
_ORPHANS = [
    ("rexval_raters", "rating_id", "study_number", "rated_at", "studies", "t.study_number = r.study_number", "added_at"),
    ("rexval_raters", "rating_id", "study_id", "rated_at", "studies", "t.study_id = r.study_id", "added_at"),
    ("scored_entities", "scored_id", "entity", "scored_at", "compare_rows", "t.study_id = r.study_id AND t.candidate_reporter = r.candidate_reporter AND t.entity = r.entity", "created_at"),
]
_ORPHAN_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, r.{k} AS row_id, '{f}' AS ref_field FROM {n} r WHERE r.{f} IS NOT NULL AND " + _LIVE.format(t=t, on=on, s=s, at=at) for n, k, f, at, t, on, s in _ORPHANS
)
_ORPHAN_REPORT = " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, '{f}' AS ref_field, strftime(at_time, '%Y-%m') AS month,
 CAST(sum(CASE WHEN first_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
 CAST(sum(CASE WHEN first_at <= at_time THEN 1 ELSE 0 END) AS BIGINT) AS n_deleted,
 CAST(sum(CASE WHEN first_at > at_time THEN 1 ELSE 0 END) AS BIGINT) AS n_later,
 count(*) AS n_orphans FROM (SELECT r.{at} AS at_time, (SELECT min(t.{s}) FROM {t} t WHERE {on}) AS first_at
 FROM {n} r WHERE r.{f} IS NOT NULL AND """
    + _LIVE.format(t=t, on=on, s=s, at=at)
    + ") x GROUP BY 3"
    for n, k, f, at, t, on, s in _ORPHANS
)
_FIELD = '"(?:[^"]|"")*"|[^",]*'
_DETAILS = " AND ".join(f"f[{i}] IN ({', '.join(repr(x) for x in (DIAGNOSIS if i == 7 else CONCORDANCE))})" for i in (7, 8, 9, 10))
_LOADED = f"""WITH c AS (SELECT raw_id, regexp_extract_all(raw_line || ',', '({_FIELD}),', 1) AS f FROM findings_raw WHERE regexp_full_match(raw_line, '(?:{_FIELD})(?:,(?:{_FIELD}))*')),
 u AS (SELECT raw_id, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM c WHERE len(f) = 13)
 SELECT raw_id, {", ".join(f"CAST(f[{i + 1}] AS {'BIGINT' if x.name == 'pos' else 'INT' if x.name == 'significance_score' else 'VARCHAR'}) AS {x.name}" for i, x in enumerate(FINDINGS_RECORD))} FROM u
 WHERE f[1] <> '' AND f[2] <> '' AND f[4] <> '' AND regexp_full_match(f[3], '[0-9]+') AND {_DETAILS} AND f[11] IN ({', '.join(repr(x) for x in DISCREPANCY)}) AND regexp_full_match(f[12], '[0-4]')"""
ORACLE = {"p5_found": _ORPHAN_ROWS, "p5_report": _ORPHAN_REPORT, "p4_loaded_findings": _LOADED}
