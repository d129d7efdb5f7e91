"""Command line: ``python -m pairlens COMMAND --help``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import metrics, text
from .functions.labels import COUNTS_A, COUNTS_B, count_columns, penalty, totals
from .operators import findings, raters
from .operators.correlation import complete_groups, correlate
from .plans import scorers
from .plans.model import client_for
from .plans.pipeline import Prompts, parse_sections, run_batches
from .session import cut
from .sources import files

TOTALS = ["total_errors", "total_significant", "total_insignificant"]
_TEXT, _INT = T.StringType(), T.IntegerType()


def _struct(names: Sequence[str], kind: T.DataType = _TEXT) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


PAIRS = T.StructType(_struct(("study_id", "candidate_reporter", "reference_text", "candidate_text")))
EVALUATED = T.StructType(_struct(("study_id", "candidate_reporter", "findings")))
RATINGS_A = T.StructType([*_struct(("study_number",), _INT), *_struct(("candidate_type",)), *_struct(("rater_index", "error_category"), _INT), T.StructField("clinically_significant", T.BooleanType()), *_struct(("num_errors",), _INT)])
RATINGS_B = T.StructType([*_struct(("report_id", "error_type")), *_struct(("one", "two", "three", "four", "five", "six", "seven", "eight"), _INT)])
STUDIES = T.StructType([*_struct(("study_number",), _INT), *_struct(("study_id",))])


def load(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.csv") -> DataFrame:
    """CSV under a schema, or Parquet if the path ends so."""
    return spark.read.parquet(path) if path.endswith(".parquet") else files.read_table(spark, path, schema, pattern)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path) if path.endswith(".parquet") else files.write_csv(df, path)


def scored(spark: SparkSession, path: str, variant: str, pattern: str = "*.csv") -> DataFrame:
    """Counts, totals and scores per file and pair of evaluated pairs; the findings cells hold Python literals."""
    cells = files.import_findings(load(spark, path, EVALUATED, pattern), "findings")
    if "file_name" not in cells.columns:
        cells = cells.withColumn("file_name", F.col("_metadata.file_name"))
    keys = ["file_name", *findings.PAIR]
    rows = findings.explode_cells(cells, "findings", keys)
    counts = rows.groupBy(*keys).agg(F.sum(penalty()).alias("pair_score"), *count_columns(variant))
    return counts.withColumns(totals(COUNTS_A if variant == "a" else COUNTS_B))


def cmd_score(spark: SparkSession, a: argparse.Namespace) -> None:
    done = cut(scored(spark, a.input, a.variant, a.pattern))
    save(done, a.output or files.processed_path(a.input))
    findings.summary(done, "pair_score").show(truncate=False)


def cmd_compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Benchmark A: per rater and against their average; benchmark B: against the summed rows. All models of a folder at once."""
    ours = scored(spark, a.input, a.variant, a.pattern).withColumnRenamed("candidate_reporter", "candidate_type")
    ours = cut(ours.withColumn("model", text.model_name(F.col("file_name"), a.prefix, ".csv")))
    if a.variant == "a":
        table = cut(raters.rater_table(load(spark, a.ratings, RATINGS_A), load(spark, a.studies, STUDIES)).withColumn("pair_score", F.lit(0.0)))
        columns = [*COUNTS_A, *TOTALS, "pair_score"]
        by_rater = ours.join(table.select(*raters.KEYS, "rater_index"), raters.KEYS).withColumn("rater_of", F.col("rater_index"))
        save(raters.compare(table, by_rater, [*raters.KEYS, "rater_index"], columns, ["model", "rater_of"]), f"{a.output}/by_rater")
        average = raters.compare(raters.average_rater(table), ours, raters.KEYS, columns, ["model"])
    else:
        columns = [*COUNTS_B, *TOTALS]
        own = ours.groupBy("study_id", "model").agg(*[F.sum(c).alias(c) for c in columns])
        average = raters.compare(raters.rater_table_wide(load(spark, a.ratings, RATINGS_B)), own, ["study_id"], columns, ["model"])
    long = cut(average)
    save(raters.score_against_counts(ours, "pair_score", TOTALS), f"{a.output}/score_against_counts")
    save(long.orderBy("column_name", "model"), f"{a.output}/collated_long")
    models = [r[0] for r in long.select("model").distinct().orderBy("model").collect()]
    save(raters.collate_wide(long, models, ["tau", "p_tau", "spearman", "p_spearman", "mae", "n_samples"]), f"{a.output}/collated_wide")


def cmd_metrics(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = load(spark, a.input, PAIRS)
    files.require(pairs, "study_id", "candidate_reporter", "reference_text", "candidate_text")
    own = metrics.all_metrics("reference_text", "candidate_text")
    done = pairs.withColumns(own)
    save(done.select("study_id", "candidate_reporter", *own), f"{a.output}/metrics")
    if a.ratings:
        _correlated(spark, a, done.select("study_id", F.col("candidate_reporter").alias("candidate_type"), *own), list(own))


def _correlated(spark: SparkSession, a: argparse.Namespace, scores: DataFrame, names: list[str]) -> None:
    """Each score, negated, against the average rater's totals, with the name that reports show."""
    avg = raters.average_rater(raters.rater_table(load(spark, a.ratings, RATINGS_A), load(spark, a.studies, STUDIES)))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(t).alias("target"), F.col(n).alias("x"), F.col(f"total_{t}").alias("y")) for n in names for t in ("significant", "insignificant")]))
    long = complete_groups(scores.join(avg, raters.KEYS).select(cells.alias("c")).select("c.*"), ["metric", "target"], "x", "y")
    s = correlate(long, ["metric", "target"], "x", "y")
    shown = F.coalesce(*[F.when(F.col("metric") == m, name) for m, name in metrics.DISPLAY.items()], "metric")
    save(s.select(shown.alias("metric"), "target", (-F.col("tau")).alias("tau"), "p_tau", (-F.col("spearman")).alias("spearman"), "p_spearman", "n_samples"), f"{a.output}/correlations")


def cmd_judge(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = load(spark, a.input, PAIRS)
    keys = ["study_id", "candidate_reporter"]
    cache = spark.read.parquet(a.cache) if a.cache else None
    if a.program:
        done = scorers.external_scores(pairs, scorers.ProgramScorer(a.program.split()), "reference_text", "candidate_text", "judge", cache, keys)
    else:
        done = scorers.judge_scores(pairs, client_for(a.model, a.url), "reference_text", "candidate_text", cache=cache, keys=keys, max_tokens=a.max_tokens)
    save(done, f"{a.output}/scores.parquet")
    if a.ratings:
        _correlated(spark, a, spark.read.parquet(f"{a.output}/scores.parquet").withColumnRenamed("candidate_reporter", "candidate_type"), ["judge"])


def cmd_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    prompts = Prompts.read(a.extraction_prompt, a.comparison_prompt, a.significance_prompt)
    models = {m: (lambda m=m: client_for(m, a.url)) for m in a.model}
    for model, status in run_batches(load(spark, a.input, PAIRS), files.read_taxonomy(spark, a.taxonomy), models, a.output, a.slices, prompts).items():
        print(f"{model}: {status}")


def cmd_sections(spark: SparkSession, a: argparse.Namespace) -> None:
    done = parse_sections(load(spark, a.input, PAIRS), ["study_id", "candidate_reporter"], "reference_text", client_for(a.model, a.url), Prompts.read(sections=a.prompt))
    save(done, a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairlens", description="Compares candidate reports with reference reports.")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, text: str) -> argparse.ArgumentParser:  # noqa: ANN001
        c = commands.add_parser(name, help=text)
        c.set_defaults(run=run)
        c.add_argument("--input", required=True, help="file or folder, CSV or Parquet")
        c.add_argument("--output", required=name != "score")
        return c

    def add_ratings(c: argparse.ArgumentParser, required: bool) -> None:
        c.add_argument("--ratings", required=required)
        c.add_argument("--studies", help="study_number and study_id, for benchmark A")

    score = add("score", cmd_score, "counts and scores of evaluated pairs, with a summary")
    compare = add("compare", cmd_compare, "counts and scores against human raters, for all models of a folder")
    add_ratings(compare, True)
    compare.add_argument("--prefix", default="", help="of file names, before the model's name")
    for c in (score, compare):
        c.add_argument("--variant", choices="ab", default="a")
        c.add_argument("--pattern", default="*.csv")
    add_ratings(add("metrics", cmd_metrics, "text metrics, and their correlation with raters"), False)
    judge = add("judge", cmd_judge, "scores by a model or a program, and their correlation with raters")
    add_ratings(judge, False)
    judge.add_argument("--program", help="reads JSON lines, writes scores")
    judge.add_argument("--cache", help="earlier scores, Parquet")
    judge.add_argument("--max-tokens", type=int, default=256)
    evaluate = add("evaluate", cmd_evaluate, "the whole evaluation with one model or several; goes on where it stopped")
    evaluate.add_argument("--model", action="append", required=True, help="several times for several models; rule-based works offline")
    evaluate.add_argument("--taxonomy", required=True)
    evaluate.add_argument("--slices", type=int, default=16)
    for s in ("extraction", "comparison", "significance"):
        evaluate.add_argument(f"--{s}-prompt")
    sections = add("sections", cmd_sections, "reports split into sections")
    sections.add_argument("--prompt")
    for c in (judge, sections):
        c.add_argument("--model", default="rule-based")
    for c in (judge, sections, evaluate):
        c.add_argument("--url", help="of a hosted model; else CHAT_API_URL")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("pairlens").getOrCreate(), a)


if __name__ == "__main__":
    main()
