"""Entities of the two sides of a pair: shared, missing and extra ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NOT_MENTIONED, PRESENCE
from ..functions.text import squish, strip
from .findings import PAIR, keep_first, keep_last


def allowed(df: DataFrame, taxonomy: DataFrame, key: str = "entity_key") -> DataFrame:
    """Rows whose entity is a taxonomy key; a null entity is none."""
    return df.join(taxonomy.select(F.col(key).alias("entity")), "entity", "left_semi")


def with_presence(df: DataFrame, keep: tuple[str, ...] = PRESENCE) -> DataFrame:
    return df.where(F.col("presence").isin(*keep))


def side(df: DataFrame, which: str) -> DataFrame:
    return df.where(F.col("side") == which)


def overlap(ref: DataFrame, cand: DataFrame, row_id: str) -> DataFrame:
    """Entities of both sides, in the reference's order: ``pair, entity, pos``. Ends are stripped, inner spaces kept; first of repeats."""
    r = ref.where(F.col("entity").isNotNull()).withColumn("entity", strip(F.col("entity")))
    c = cand.where(F.col("entity").isNotNull()).select(*PAIR, strip(F.col("entity")).alias("entity"))
    return keep_first(r, [*PAIR, "entity"], "pos", row_id).join(c, [*PAIR, "entity"], "left_semi").select(*PAIR, "entity", "pos")


def _normal(df: DataFrame, row_id: str) -> DataFrame:
    """One row per pair and normalised entity, the last one."""
    return keep_last(df.where(F.col("entity").isNotNull()).withColumn("_key", squish(F.col("entity"))), [*PAIR, "_key"], "pos", row_id)


def one_sided(here: DataFrame, there: DataFrame, common: DataFrame, kind: str, row_id: str) -> DataFrame:
    """Entities of one side only, as discrepancy rows.

    Keys are normalised here but not for the overlap, so two spellings that differ in inner spaces are in neither result.
    """
    key = [*PAIR, "_key"]
    there_keys = there.select(*PAIR, squish(F.col("entity")).alias("_key"))
    common_keys = common.select(*PAIR, squish(F.col("entity")).alias("_key"))
    own = _normal(here, row_id).join(there_keys, key, "left_anti").join(common_keys, key, "left_anti")
    missing = kind == "missing_in_candidate"
    return own.select(
        *PAIR,
        F.col("entity"),
        (F.col("sentence") if missing else F.lit(None).cast("string")).alias("reference_report_finding"),
        (F.lit(None).cast("string") if missing else F.col("sentence")).alias("candidate_report_finding"),
        *[F.lit("not mentioned").alias(c) for c in ("diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison")],
        F.lit(kind).alias("discrepancy_type"),
        (F.col("presence") if missing else F.lit(NOT_MENTIONED)).alias("reference_presence"),
        (F.lit(NOT_MENTIONED) if missing else F.col("presence")).alias("candidate_presence"),
        F.col("_key").alias("entity_norm"),
    )


def merged(ref: DataFrame, cand: DataFrame, common: DataFrame, row_id: str) -> DataFrame:
    """Shared rows, then missing, then extra ones: ``section`` 0, 1, 2 and the order within it."""
    shared = common.withColumn("section", F.lit(0))
    missing = one_sided(ref, cand, common, "missing_in_candidate", row_id).withColumn("section", F.lit(1))
    extra = one_sided(cand, ref, common, "extra_in_candidate", row_id).withColumn("section", F.lit(2))
    return shared.unionByName(missing, allowMissingColumns=True).unionByName(extra, allowMissingColumns=True)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str], ok: str | None = None) -> DataFrame:
    """Rows still to do: those whose key has no result, or only failed ones."""
    finished = done.where(ok) if ok else done
    return todo.join(finished.select(*keys), keys, "left_anti")
