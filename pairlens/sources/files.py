"""Files: delimited tables under a schema, taxonomies, stored results and resumable sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonscan, text
from ..operators.entities import not_done

FINDING = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("entity", "reference_report_finding", "candidate_report_finding", "diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison", "discrepancy_type")]
    + [T.StructField("significance_score", T.IntegerType()), T.StructField("rationale", T.StringType())]
)


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType, pattern: str = "*.csv", skip: str | None = "_processed.csv") -> DataFrame:
    """CSV with a header and quoted line breaks; adds ``file_name``. Files whose name ends in ``skip`` are left out.

    All files of a directory are one job. A path without matching files gives
    an empty table with the schema's columns, as does an empty file.
    """
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", pattern).csv(path)
    named = df.withColumn("file_name", F.col("_metadata.file_name"))
    return named.where(~F.col("file_name").endswith(skip)) if skip else named


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, if it has all columns: checked before any plan is built on it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``ord, category, entity, entity_key`` of a YAML or JSON file that maps categories to lists, in file order."""
    raw = Path(path).read_text(encoding="utf-8")
    try:
        tree = json.loads(raw)
    except ValueError:
        tree = _plain_yaml(raw)
    rows = [(c, e) for c, es in tree.items() for e in es]
    if any(not isinstance(e, str) for _, e in rows):
        raise ValueError("entities must be texts")
    numbered = [(i + 1, c, e, f"{c} :: {e}") for i, (c, e) in enumerate(rows)]
    return spark.createDataFrame(numbered, "ord int, category string, entity string, entity_key string")


def _plain_yaml(raw: str) -> dict[str, list[str]]:
    """The part of YAML that a taxonomy uses: keys with lists of plain or quoted texts."""
    tree: dict[str, list[str]] = {}
    key = None
    for n, line in enumerate(raw.splitlines(), 1):
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        item = bare.strip()
        if item.startswith("- ") and key is not None:
            tree[key].append(item[2:].strip().strip("\"'"))
        elif item.endswith(":") and not bare[0].isspace():
            key = item[:-1].strip().strip("\"'")
            if key in tree:
                raise ValueError(f"line {n}: category given twice")
            tree[key] = []
        else:
            raise ValueError(f"line {n}: neither a category nor an entity")
    return tree


def literal_or_file(value: object) -> object:
    """An object itself; a text that names a file, or is JSON, as its content."""
    if not isinstance(value, str):
        return value
    try:
        if Path(value).is_file():
            return json.loads(Path(value).read_text(encoding="utf-8"))
        return json.loads(value)
    except (ValueError, OSError) as e:
        raise ValueError("neither a file nor JSON") from e


def import_findings(df: DataFrame, cell: str) -> DataFrame:
    """``cell``, the text of Python literals, becomes an array of findings. Unreadable cells become empty arrays."""
    return df.withColumn(cell, F.from_json(jsonscan.findings_json(F.col(cell)), T.ArrayType(FINDING)))


def processed_path(path: str) -> str:
    return path.replace(".csv", "_processed.csv")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def resume(todo: DataFrame, sink: str, keys: list[str], ok: str | None = "status <> 'failed'") -> DataFrame:
    """Rows of ``todo`` that the sink has no good result for; all of them if there is no sink yet. Failed ones are tried again."""
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(sink)
    except Exception as e:  # noqa: BLE001 - only a missing path means that nothing is done yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return todo
    return not_done(todo, done, keys, ok)


def append(df: DataFrame, sink: str) -> None:
    df.write.mode("append").parquet(sink)


def model_of_file(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("model", text.model_name(F.col("file_name"), prefix))
