"""Queries of the training-data problems, on their whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import consensus, leaks, mapping, pieces, pii, tokens, truncated

ENTITY_TABLES = {"entity_decisions": "decision_id", "compare_rows": "compare_id", "scored_entities": "scored_id"}
CUT_TEXTS = (("gema_scores", "score_id", "eval_result", True), ("report_sections", "section_id", "findings", False))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _free_entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose entity is no taxonomy key, and the taxonomy."""
    entries = table(spark, d, "taxonomy")
    rows = _all([table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(k).alias("row_id"), "entity") for t, k in ENTITY_TABLES.items()])
    keys = entries.select(F.col("entity_key").alias("entity"))
    return rows.where("entity is not null").join(keys, "entity", "left_anti"), entries


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows, entries = _free_entities(spark, d)
    forms = mapping.reference_forms(spark, entries, "ord", "category", "entity")
    return mapping.map_rows(rows, "entity", forms).select("table_name", "row_id", F.col("ord").cast("int").alias("entity_ord"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that fit no entry, with their rows per table."""
    rows, entries = _free_entities(spark, d)
    forms = mapping.reference_forms(spark, entries, "ord", "category", "entity")
    lost = mapping.map_rows(rows, "entity", forms).where("ord = 0")
    return lost.groupBy("table_name", "entity").agg(F.count("*").alias("n_rows"))


ITEM = ["study_number", "candidate_type", "error_category", "clinically_significant"]


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    """Usable ratings; a redelivered one, which differs by row id and load time only, comes once."""
    r = table(spark, d, "rexval_raters").where("study_number >= 0 and error_category between 1 and 6 and candidate_type is not null and clinically_significant is not null and num_errors is not null")
    return r.select(*ITEM[:3], F.col("clinically_significant").cast("int").alias("clinically_significant"), "rater_index", "num_errors", "rated_at").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.consensus(_ratings(spark, d), ITEM, "rater_index", "num_errors")
    return items.where("p_any >= 0.5").select(*ITEM)


def p2_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_ratings(spark, d), ITEM, "rater_index", "num_errors")[0]


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_ratings(spark, d), ITEM, "rater_index", "num_errors")[1].withColumnRenamed("rater", "rater_index")


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = consensus.agreement(_ratings(spark, d), ITEM, "num_errors", ["error_category", "clinically_significant"])
    return r.select("error_category", "clinically_significant", "n_items", "n_ratings", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")])


PII_KEYS = ["table_name", "row_id", "field_name"]


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    fields = (("reports", "report_row_id", "ground_truth"), ("reports", "report_row_id", "candidate_report"), ("report_sections", "section_id", "history"))
    return _all([table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(k).alias("row_id"), F.lit(c).alias("field_name"), F.col(c).alias("text")) for t, k, c in fields])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal(_personal_texts(spark, d), PII_KEYS, "text").select(*PII_KEYS, "pii_type", "start_pos")


def p3_masked(spark: SparkSession, d: str) -> DataFrame:
    """All texts, nulls included, with typed placeholders."""
    return pii.mask_personal(_personal_texts(spark, d), PII_KEYS, "text").withColumnRenamed("text", "masked_text")


def _truncation(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    return [(t, truncated.score_truncation(table(spark, d, t), k, c, "source", s).withColumnRenamed(k, "row_id")) for t, k, c, s in CUT_TEXTS]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _all([x.where("truncated").select(F.lit(t).alias("table_name"), "row_id") for t, x in _truncation(spark, d)])


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _all([truncated.truncation_report(x).select(F.lit(t).alias("table_name"), "*") for t, x in _truncation(spark, d)])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    items = table(spark, d, "eval_items").select("item_id", "item_set")
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents")).join(items, "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pieces(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_corpus(table(spark, d, "documents"), "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_consensus, p2_reliability, p2_agreement, p3_found, p3_masked, p6_found, p6_report, p7_ids, p8_found, p8_items, p9_found, p9_pieces)}
_RATINGS = """SELECT DISTINCT study_number, candidate_type, error_category, CAST(clinically_significant AS INT) AS clinically_significant, rater_index, num_errors, rated_at
 FROM rexval_raters WHERE study_number >= 0 AND error_category BETWEEN 1 AND 6 AND candidate_type IS NOT NULL AND clinically_significant IS NOT NULL AND num_errors IS NOT NULL"""
ORACLE = {
    "p2_agreement": f"""WITH r AS ({_RATINGS}), c AS (SELECT {", ".join(ITEM)}, num_errors AS label, count(*) AS n FROM r GROUP BY ALL),
 i AS (SELECT {", ".join(ITEM)}, sum(n) AS m, sum(n * (n - 1)) AS same FROM c GROUP BY ALL HAVING sum(n) > 1),
 o AS (SELECT error_category, clinically_significant, count(*) AS n_items, CAST(sum(m) AS BIGINT) AS n_ratings, sum(same / CAST(m - 1 AS DOUBLE)) / sum(m) AS observed FROM i GROUP BY ALL),
 l AS (SELECT error_category, clinically_significant, label, sum(n) AS n FROM c SEMI JOIN i USING ({", ".join(ITEM)}) GROUP BY ALL),
 e AS (SELECT error_category, clinically_significant, sum(n * (n - 1)) / CAST(sum(n) * (sum(n) - 1) AS DOUBLE) AS expected FROM l GROUP BY ALL)
 SELECT error_category, clinically_significant, n_items, n_ratings, round(observed, 6) AS observed, round(expected, 6) AS expected,
 round((observed - expected) / (1 - expected), 6) AS alpha FROM o JOIN e USING (error_category, clinically_significant)""",
}
