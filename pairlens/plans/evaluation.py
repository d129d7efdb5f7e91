"""Queries of the evaluation operators over the whole tables, and SQL with the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonscan, metrics, text
from ..functions.labels import CATEGORY_BUCKET, COUNTS_A, COUNTS_B, WIDE_BUCKET, penalty, score_or_zero, totals
from ..operators import entities, findings, raters
from ..operators.correlation import complete_groups, correlate
from ..session import cut, table
from . import pipeline, prompts, scorers
from .model import RuleBasedClient
from .pipeline import evaluate_pairs

PAIR = findings.PAIR
TOTALS = ["total_errors", "total_significant", "total_insignificant"]
COMPARED_A = [*COUNTS_A, *TOTALS, "pair_score"]
COMPARED_B = [*COUNTS_B, *TOTALS]
MODELS = ["mdl_aster", "mdl_birch", "mdl_cedar", "mdl_dune"]
DETAILS = ["diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison", "discrepancy_type"]


def live_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "compare_rows").where("deleted_at is null and study_id is not null and candidate_reporter is not null and entity is not null")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_entities").where("study_id is not null and candidate_reporter is not null and entity is not null")


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair and entity: the first comparison with its latest score. Only the columns that scores need."""
    own = live_compare(spark, d).select(*PAIR, "entity", *DETAILS, "pos", "compare_id")
    a = findings.keep_first(own, [*PAIR, "entity"], "pos", "compare_id")
    b = findings.keep_last(scored(spark, d).select(*PAIR, "entity", "significance_score", "rationale", "scored_at", "scored_id"), [*PAIR, "entity"], "scored_at", "scored_id")
    return findings.attach_significance(a, b)


def pair_score(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "reports").dropna(subset=PAIR)
    return findings.pair_scores(finding_rows(spark, d), pairs)


def entity_penalty(spark: SparkSession, d: str) -> DataFrame:
    return finding_rows(spark, d).select("compare_id", score_or_zero().alias("significance"), penalty().alias("penalty"))


def error_counts_a(spark: SparkSession, d: str) -> DataFrame:
    return findings.error_counts(finding_rows(spark, d), "a")


def error_counts_b(spark: SparkSession, d: str) -> DataFrame:
    return findings.error_counts(finding_rows(spark, d), "b")


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    s = findings.summary(pair_score(spark, d), "pair_score")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "q25", "q50", "q75", "most")])


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return findings.histogram(pair_score(spark, d), "pair_score")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = entities.with_presence(table(spark, d, "entity_decisions").dropna(subset=[*PAIR, "entity"])).select("decision_id", *PAIR, "side", "pos", "entity", "presence", "sentence")
    return entities.side(e, "ref"), entities.side(e, "cand")


def allowed_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.allowed(table(spark, d, "entity_decisions"), table(spark, d, "taxonomy")).groupBy("entity").agg(F.count("*").alias("n_rows"))


def entity_overlap(spark: SparkSession, d: str) -> DataFrame:
    return entities.overlap(*_sides(spark, d), "decision_id")


def _one_sided(spark: SparkSession, d: str, kind: str) -> DataFrame:
    ref, cand = _sides(spark, d)
    common = entities.overlap(ref, cand, "decision_id")
    here, there = (ref, cand) if kind == "missing_in_candidate" else (cand, ref)
    return entities.one_sided(here, there, common, kind, "decision_id").select(*PAIR, "entity", "entity_norm", "discrepancy_type", "reference_presence", "candidate_presence", "reference_report_finding", "candidate_report_finding")


def missing_in_candidate(spark: SparkSession, d: str) -> DataFrame:
    return _one_sided(spark, d, "missing_in_candidate")


def extra_in_candidate(spark: SparkSession, d: str) -> DataFrame:
    return _one_sided(spark, d, "extra_in_candidate")


def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    ref, cand = _sides(spark, d)
    m = entities.merged(ref, cand, entities.overlap(ref, cand, "decision_id"), "decision_id")
    return m.select(*PAIR, "section", "entity", "discrepancy_type")


def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_decisions").dropna(subset=[*PAIR, "side", "entity"]).select(*PAIR, "side", "entity", "pos", "decision_id")
    return findings.keep_first(e, [*PAIR, "side", "entity"], "pos", "decision_id")


def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity_decisions").dropna(subset=[*PAIR, "side", "entity"]).select(*PAIR, "side", "entity", "pos", "decision_id")
    return findings.keep_last(e, [*PAIR, "side", "entity"], "pos", "decision_id")


def significance_join(spark: SparkSession, d: str) -> DataFrame:
    return finding_rows(spark, d).select("compare_id", "significance_score", "rationale")


def significance_status(spark: SparkSession, d: str) -> DataFrame:
    return findings.significance_status(live_compare(spark, d), scored(spark, d))


def rater_table_a(spark: SparkSession, d: str) -> DataFrame:
    return raters.rater_table(table(spark, d, "rexval_raters"), table(spark, d, "studies"))


def rater_avg(spark: SparkSession, d: str) -> DataFrame:
    a = raters.average_rater(rater_table_a(spark, d))
    return a.select(*raters.KEYS, *[F.round(c, 6).alias(c) for c in (*COUNTS_A, *TOTALS)])


def _semi_wide(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark B's shape from the ratings: category 7 and 9 stand for its two kinds of partial errors."""
    r = table(spark, d, "rexval_raters").where("study_id is not null and clinically_significant is not null")
    sums = [F.sum(F.when(F.col("error_category") == c, F.col("num_errors"))).alias(n) for n, c in zip(WIDE_BUCKET, (1, 2, 3, 4, 5, 6, 7, 9))]
    kind = F.when(F.col("clinically_significant"), "significant").otherwise("insignificant")
    return r.groupBy(F.col("study_id").alias("report_id"), kind.alias("error_type")).agg(*sums)


def rater_table_b(spark: SparkSession, d: str) -> DataFrame:
    return raters.rater_table_wide(_semi_wide(spark, d))


def _ours(spark: SparkSession, d: str, variant: str) -> DataFrame:
    names = COUNTS_A if variant == "a" else COUNTS_B
    return findings.error_counts(finding_rows(spark, d), variant).withColumns(totals(names)).withColumnRenamed("candidate_reporter", "candidate_type")


def _round(c: Column) -> Column:
    """To six places, without a negative zero."""
    return F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6))


def _rounded(stats: DataFrame, *keys: str, p: bool = False) -> DataFrame:
    return stats.select(*keys, *[_round(F.col(c)).alias(c) for c in (("tau", "p_tau", "spearman", "p_spearman", "mae") if p else ("tau", "spearman", "mae"))], "n_samples")


def _zero_score(df: DataFrame) -> DataFrame:
    """Raters give no score; theirs counts as 0, so its tau and rho are null."""
    return df if "pair_score" in df.columns else df.withColumn("pair_score", F.lit(0.0))


def compare_per_rater(spark: SparkSession, d: str) -> DataFrame:
    s = raters.compare(_ours(spark, d, "a"), _zero_score(rater_table_a(spark, d)), raters.KEYS, COMPARED_A, ["rater_index"])
    return _rounded(s, "rater_index", "column_name")


def compare_avg(spark: SparkSession, d: str) -> DataFrame:
    s = raters.compare(_ours(spark, d, "a"), _zero_score(raters.average_rater(rater_table_a(spark, d))), raters.KEYS, COMPARED_A)
    return _rounded(s, "column_name")


def compare_avg_p(spark: SparkSession, d: str) -> DataFrame:
    """With p-values, for which SQL has no functions."""
    s = raters.compare(_ours(spark, d, "a"), _zero_score(raters.average_rater(rater_table_a(spark, d))), raters.KEYS, COMPARED_A)
    return _rounded(s, "column_name", p=True)


def compare_b(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark B: per study, zero-variance columns have null tau and rho."""
    ours = _ours(spark, d, "b").groupBy("study_id").agg(*[F.sum(c).alias(c) for c in (*COUNTS_B, *TOTALS)])
    return _rounded(raters.compare(ours, rater_table_b(spark, d), ["study_id"], COMPARED_B), "column_name")


def score_vs_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(raters.score_against_counts(_ours(spark, d, "a"), "pair_score", TOTALS), "column_name")


def collated_long(spark: SparkSession, d: str) -> DataFrame:
    avg = raters.average_rater(rater_table_a(spark, d)).withColumn("model", F.col("candidate_type"))
    s = raters.compare(_ours(spark, d, "a"), avg, raters.KEYS, [*COUNTS_A, *TOTALS], ["model"])
    return _rounded(s, "model", "column_name")


def collated_wide(spark: SparkSession, d: str) -> DataFrame:
    """The known models first, in any case, then all others of the table by name."""
    long = cut(collated_long(spark, d))
    others = sorted({r["model"] for r in long.select("model").distinct().collect()} - set(MODELS))
    return raters.collate_wide(long, [*MODELS, *others], ["tau", "spearman", "mae", "n_samples"])


def _report_texts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").dropna(subset=PAIR).select("report_row_id", *PAIR, "ground_truth", "candidate_report")
    return findings.keep_first(r, PAIR, "report_row_id")


def token_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_sections").select("section_id", text.squish(F.col("findings")).alias("normalised"), text.strip(F.col("findings")).alias("stripped"))


def bleu1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select("report_row_id", F.round(metrics.bleu1(F.col("ground_truth"), F.col("candidate_report")), 6).alias("bleu1"))


def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select("report_row_id", "ground_truth", "candidate_report").withColumns(metrics.all_metrics("ground_truth", "candidate_report")).drop("ground_truth", "candidate_report")


def greedy_cosine_f1(spark: SparkSession, d: str) -> DataFrame:
    """Texts of up to 32 token vectors: even ids of a run of ids are the reference's, odd ones the candidate's."""
    e = table(spark, d, "embeddings").select("label", F.floor(F.col("vec_id") / 32).alias("run"), "vec_id", "embedding")
    half = lambda p: F.collect_list(F.when(F.col("vec_id") % 2 == p, F.col("embedding")))  # noqa: E731 - 16 vectors at most
    return e.groupBy("label", "run").agg(half(0).alias("a"), half(1).alias("b")).select("label", "run", F.round(metrics.greedy_cosine_f1("a", "b"), 4).alias("f1"))


def metric_corr_combined(spark: SparkSession, d: str) -> DataFrame:
    """Every text metric there is, negated, against the average rater's significant and insignificant errors: one row per metric."""
    own = {m: F.round(c, 9) for m, c in metrics.all_metrics("ground_truth", "candidate_report").items()}
    m = _report_texts(spark, d).select("study_id", F.col("candidate_reporter").alias("candidate_type"), *[c.alias(m) for m, c in own.items()])
    avg = raters.average_rater(rater_table_a(spark, d)).select(*raters.KEYS, "total_significant", "total_insignificant")
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.lit(t).alias("target"), F.col(x).alias("x"), F.col(f"total_{t}").alias("y")) for x in own for t in ("significant", "insignificant")]))
    long = complete_groups(m.join(avg, raters.KEYS).select(pairs.alias("p")).select("p.*"), ["metric", "target"], "x", "y")
    s = correlate(long, ["metric", "target"], "x", "y")
    cell = lambda t, c, sign: _round(sign * F.max(F.when(F.col("target") == t, F.col(c))))
    out = [cell(t, c, -1).alias(f"{t}_{c}") for t in ("significant", "insignificant") for c in ("tau", "spearman")]
    return s.groupBy("metric").agg(*out, F.max(F.when(F.col("target") == "significant", F.col("n_samples"))).alias("n_samples"))


def metric_corr_bleu1(spark: SparkSession, d: str) -> DataFrame:
    return metric_corr_combined(spark, d).where("metric = 'bleu1'")


def scatter_points(spark: SparkSession, d: str) -> DataFrame:
    """Points and axis limits of the plots of our totals against the average rater's."""
    avg = raters.average_rater(rater_table_a(spark, d))
    return raters.scatter(_ours(spark, d, "a"), avg, raters.KEYS, TOTALS)


def collated_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The long result in the order of reports: by column, then model."""
    return collated_long(spark, d).orderBy("column_name", "model")


def done_files(spark: SparkSession, d: str) -> DataFrame:
    """Names of files in order, each once, though several patterns may meet it."""
    f = table(spark, d, "findings_raw").select("file_name")
    return f.where(F.col("file_name").endswith(".csv")).union(f.where(F.col("file_name").startswith("run_"))).distinct().orderBy("file_name")


def first_studies(spark: SparkSession, d: str) -> DataFrame:
    """The five first study ids, to look at."""
    return findings.first_values(table(spark, d, "reports"), "study_id", 5)


def _messages(df: DataFrame, key: str | list[str], m: Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.select(*keys, m.alias("m")).select(*keys, F.col("m")[0]["content"].alias("system"), F.element_at("m", -1)["content"].alias("asked"))


def extract_prompts(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "taxonomy").orderBy("ord").select("entity_key").collect()
    r = table(spark, d, "reports").where("ground_truth is not null")
    return _messages(r, "report_row_id", prompts.extraction(prompts.EXTRACTION, F.lit("\n".join(f"- {k[0]}" for k in keys)), F.col("ground_truth")))


def compare_prompts(spark: SparkSession, d: str) -> DataFrame:
    shared = entity_overlap(spark, d).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("l"))
    r = _report_texts(spark, d).where("ground_truth is not null and candidate_report is not null").join(shared, PAIR)
    listed = F.transform("l", lambda x: x["entity"])
    return _messages(r, PAIR, prompts.comparison(prompts.COMPARISON, listed, F.col("ground_truth"), F.col("candidate_report")))


def significance_prompts(spark: SparkSession, d: str) -> DataFrame:
    fields = ["entity", "reference_report_finding", "candidate_report_finding", *DETAILS]
    rows = findings.keep_first(live_compare(spark, d).select(*PAIR, "pos", "compare_id", *fields), [*PAIR, "entity"], "pos", "compare_id")
    listed = rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("compare_id", *fields))).alias("l"))
    r = _report_texts(spark, d).where("ground_truth is not null").join(listed, PAIR)
    return _messages(r, PAIR, prompts.significance(prompts.SIGNIFICANCE, F.col("ground_truth"), F.col("l"), fields)).drop("system")


def section_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("ground_truth is not null")
    return _messages(r, "report_row_id", prompts.sections(prompts.SECTIONS["system_prompt"], prompts.SECTIONS["user_template"], F.col("ground_truth")))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reports").where("ground_truth is not null and candidate_report is not null")
    return _messages(r, "report_row_id", prompts.judge(F.col("ground_truth"), F.col("candidate_report"))).drop("system")


def section_stage(spark: SparkSession, d: str) -> DataFrame:
    """Both texts of all reports split into sections by the offline client."""
    r = table(spark, d, "reports")
    return pipeline.parse_sections(r, ["report_row_id"], "ground_truth", RuleBasedClient())


def external_scores(spark: SparkSession, d: str) -> DataFrame:
    """The offline scorer, share of common words, on all report pairs."""
    r = table(spark, d, "reports").select("report_row_id", "ground_truth", "candidate_report")
    return scorers.external_scores(r, scorers.WordOverlap(), "ground_truth", "candidate_report", "overlap").select("report_row_id", F.round("overlap", 6).alias("overlap"))


def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of all report pairs by the offline client, through the same path as a model's."""
    r = table(spark, d, "reports").select("report_row_id", "ground_truth", "candidate_report")
    return scorers.judge_scores(r, RuleBasedClient(), "ground_truth", "candidate_report").select("report_row_id", "judge", "eval_result")


def judge_corr(spark: SparkSession, d: str) -> DataFrame:
    """Stored ratings, the latest of each pair, against the average rater's errors, negated."""
    g = table(spark, d, "gema_scores").where("study_id is not null and candidate_reporter is not null and gema is not null").select(*PAIR, "gema", "scored_at", "score_id")
    g = findings.keep_last(g, PAIR, "scored_at", "score_id").withColumnRenamed("candidate_reporter", "candidate_type")
    avg = raters.average_rater(rater_table_a(spark, d)).select(*raters.KEYS, "total_significant", "total_insignificant")
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col("gema").alias("x"), F.col(f"total_{t}").alias("y")) for t in ("significant", "insignificant")]))
    s = correlate(complete_groups(g.join(avg, raters.KEYS).select(pairs.alias("p")).select("p.*"), ["target"], "x", "y"), ["target"], "x", "y")
    return s.select("target", _round(-F.col("tau")).alias("tau"), _round(-F.col("spearman")).alias("spearman"), "n_samples")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pairs without a readable rating, so still to be scored."""
    done = table(spark, d, "gema_scores")
    todo = table(spark, d, "reports").dropna(subset=PAIR).select(*PAIR).distinct()
    return entities.not_done(todo, done, PAIR, "gema is not null")


def json_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gema_scores").select("score_id", text.sanitize_json(F.col("eval_result")).alias("clean"))


def json_first_array(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit('Answer: [1] [ {"entity": "'), F.col("entity"), F.lit('"}, {"n": [2]} ] and more [{}]'))
    return table(spark, d, "scored_entities").select("scored_id", text.first_array_by_pattern(wrapped).alias("found"))


def json_balanced(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gema_scores").select("score_id", "eval_result")
    return g.select("score_id", jsonscan.first_array("eval_result").alias("first_array"), jsonscan.first_object("eval_result").alias("first_object"), jsonscan.first_value("eval_result").alias("first_value"), jsonscan.score_object("eval_result").alias("score_object"))


def final_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gema_scores").select("score_id", jsonscan.score_of("eval_result").alias("parsed"), text.pattern_score(F.col("eval_result")).alias("by_pattern"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections written as JSON inside prose and read back under the fixed six keys."""
    s = table(spark, d, "report_sections")
    raw = F.concat(F.lit("Result: "), F.to_json(F.struct(*jsonscan.SECTION_KEYS, "status")), F.lit(" done."))
    parsed = F.from_json(jsonscan.sections_json(raw), ", ".join(f"{k} string" for k in jsonscan.SECTION_KEYS))
    return s.select("section_id", parsed.alias("p")).select("section_id", "p.*")


def taxonomy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The allowed list of each category, as a prompt shows it."""
    t = table(spark, d, "taxonomy")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_key"))), lambda x: x["entity_key"])
    return t.groupBy("category").agg(F.count("*").alias("n_entities"), text.entity_lines(keys).alias("prompt_lines"))


def model_routing(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings_raw").select("file_name").distinct()
    name = text.model_name(F.col("file_name"), r"run_[0-9]+_", ".csv")
    return f.select("file_name", name.alias("model"), text.file_safe(name).alias("safe_model"), text.is_hosted(name).alias("hosted"))


def pipeline_rule_based(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation with the offline client, on all report pairs."""
    reports = _report_texts(spark, d).select(*PAIR, F.col("ground_truth").alias("reference_text"), F.col("candidate_report").alias("candidate_text"))
    found, scores = evaluate_pairs(reports, table(spark, d, "taxonomy").select("ord", "entity", "entity_key"), RuleBasedClient())
    return scores.select(*PAIR, "pair_score", "n_findings", "status")


QUERIES = {
    f.__name__: f
    for f in (
        pair_score, entity_penalty, error_counts_a, error_counts_b, score_summary, score_histogram, allowed_entities, entity_overlap, missing_in_candidate, extra_in_candidate, merged_entities,
        dedup_keep_first, dedup_keep_last, significance_join, significance_status, rater_table_a, rater_avg, rater_table_b, compare_per_rater, compare_avg, compare_avg_p, compare_b, score_vs_counts,
        collated_long, collated_wide, token_norm, bleu1, text_metrics, greedy_cosine_f1, metric_corr_combined, resume_anti, json_sanitize, json_first_array, json_balanced, final_scores, sections,
        taxonomy_pairs, model_routing, pipeline_rule_based, metric_corr_bleu1, scatter_points, collated_ordered, done_files, first_studies, extract_prompts, compare_prompts, significance_prompts, section_prompts, judge_prompts,
        section_stage, external_scores, judge_scores, judge_corr,
    )
}

# ---- SQL with the same results ----

_FINDINGS = """fc AS (SELECT * FROM compare_rows WHERE deleted_at IS NULL AND study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND entity IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter, entity ORDER BY pos NULLS FIRST, compare_id) = 1),
 fs AS (SELECT * FROM scored_entities WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND entity IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter, entity ORDER BY scored_at DESC NULLS LAST, scored_id DESC) = 1),
 f AS (SELECT fc.*, fs.significance_score, fs.rationale, coalesce(fs.significance_score, 0) AS s,
  coalesce(diagnosis_concordance, '') AS dg, coalesce(location_concordance, '') AS lc, coalesce(severity_concordance, '') AS sv, coalesce(temporal_comparison, '') AS tp, coalesce(discrepancy_type, '') AS kd
  FROM fc LEFT JOIN fs ON fc.study_id = fs.study_id AND fc.candidate_reporter = fs.candidate_reporter AND fc.entity = fs.entity)"""
_WRONG = "('partial', 'discordant', 'candidate-adds', 'candidate-misses')"
_PENALTY = f"CAST(s * ((dg IN ('partial', 'discordant'))::INT + (lc IN {_WRONG})::INT + (sv IN {_WRONG})::INT + (tp IN {_WRONG})::INT) AS DOUBLE)"
_HITS = {
    "a": {
        "false_prediction": "(dg IN ('discordant', 'partial') OR kd = 'extra_in_candidate' OR tp = 'discordant')::INT",
        "omission_finding": "(kd = 'missing_in_candidate')::INT",
        "incorrect_location": f"(lc IN {_WRONG})::INT",
        "incorrect_severity": f"(sv IN {_WRONG})::INT",
        "extra_comparison": "(tp IN ('candidate-adds', 'partial'))::INT",
        "omitted_comparison": "(tp = 'candidate-misses')::INT",
    },
    "b": {
        "false_prediction": "(dg = 'discordant' OR kd = 'extra_in_candidate')::INT",
        "omission_finding": "(kd = 'missing_in_candidate')::INT",
        "incorrect_location": "(lc IN ('discordant', 'candidate-adds', 'candidate-misses'))::INT",
        "incorrect_severity": "(sv IN ('discordant', 'candidate-adds', 'candidate-misses'))::INT",
        "extra_comparison": "(tp = 'candidate-adds')::INT",
        "omitted_comparison": "(tp = 'candidate-misses')::INT",
        "partial": "((dg = 'partial' AND NOT (kd = 'extra_in_candidate'))::INT + (lc = 'partial')::INT + (sv = 'partial')::INT + (tp = 'partial')::INT)",
    },
}


def _counts_sql(variant: str) -> str:
    limit = 2 if variant == "a" else 3
    sig = {"significant": f"s >= {limit}", "insignificant": f"s > 0 AND s < {limit}"}
    names = COUNTS_A if variant == "a" else COUNTS_B
    return ", ".join(f"CAST(sum(CASE WHEN {sig[n.rpartition('_')[2]]} THEN {_HITS[variant][n.rpartition('_')[0]]} ELSE 0 END) AS BIGINT) AS {n}" for n in names)


def _totals_sql(names: tuple[str, ...]) -> str:
    add = lambda end: " + ".join(n for n in names if n.endswith(end))
    return f"{add('')} AS total_errors, {add('_significant')} AS total_significant, {add('_insignificant')} AS total_insignificant"


_OURS = {v: f"ours AS (SELECT *, {_totals_sql(n)} FROM (SELECT study_id, candidate_reporter AS candidate_type, sum({_PENALTY}) AS pair_score, {_counts_sql(v)} FROM f GROUP BY ALL) q)" for v, n in (("a", COUNTS_A), ("b", COUNTS_B))}
_BUCKET_SQL = "CASE error_category " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CATEGORY_BUCKET.items()) + " END || CASE WHEN clinically_significant THEN '_significant' WHEN NOT clinically_significant THEN '_insignificant' END"
_RATERS = f"""ra AS (SELECT *, {_totals_sql(COUNTS_A)} FROM (SELECT st.study_id, r.candidate_type, r.rater_index, {", ".join(f"CAST(coalesce(sum(CASE WHEN b = '{c}' THEN num_errors END), 0) AS BIGINT) AS {c}" for c in COUNTS_A)}
 FROM (SELECT *, {_BUCKET_SQL} AS b FROM rexval_raters) r JOIN studies st ON r.study_number = st.study_number WHERE b IS NOT NULL AND candidate_type IS NOT NULL AND rater_index IS NOT NULL AND st.study_id IS NOT NULL GROUP BY 1, 2, 3) q)"""
_AVG = f"av AS (SELECT study_id, candidate_type, {', '.join(f'avg({c}) AS {c}' for c in (*COUNTS_A, *TOTALS))} FROM ra GROUP BY 1, 2)"
_WIDE = ", ".join(f"sum(CASE WHEN error_category = {c} THEN num_errors END) AS {n}" for n, c in zip(WIDE_BUCKET, (1, 2, 3, 4, 5, 6, 7, 9)))


def _wide_sql() -> str:
    out = []
    for c in COUNTS_B:
        b, _, s = c.rpartition("_")
        add = " + ".join(f"coalesce({w}, 0)" for w, x in WIDE_BUCKET.items() if x == b)
        out.append(f"CAST(coalesce(sum(CASE WHEN error_type = '{s}' THEN {add} END), 0) AS BIGINT) AS {c}")
    return f"""sw AS (SELECT study_id AS report_id, CASE WHEN clinically_significant THEN 'significant' ELSE 'insignificant' END AS error_type, {_WIDE} FROM rexval_raters WHERE study_id IS NOT NULL AND clinically_significant IS NOT NULL GROUP BY 1, 2),
 rb AS (SELECT *, {_totals_sql(COUNTS_B)} FROM (SELECT report_id AS study_id, {", ".join(out)} FROM sw GROUP BY 1) q)"""


def _stats_sql(source: str, keys: list[str]) -> str:
    """CTEs over ``lp(keys, x, y)`` that end in ``stats``."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    return f"""lp AS ({source}), ok AS (SELECT * FROM lp WHERE x IS NOT NULL AND y IS NOT NULL),
 cl AS (SELECT {k}, x, y, CAST(count(*) AS DOUBLE) AS n FROM ok GROUP BY ALL),
 nm AS (SELECT {", ".join(f"a.{x}" for x in keys)}, sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS num FROM cl a JOIN cl b ON {on("a", "b")} GROUP BY ALL),
 tx AS (SELECT {k}, sum(t * (t - 1)) / 2 AS n1 FROM (SELECT {k}, x, sum(n) AS t FROM cl GROUP BY ALL) q GROUP BY ALL),
 ty AS (SELECT {k}, sum(t * (t - 1)) / 2 AS n2 FROM (SELECT {k}, y, sum(n) AS t FROM cl GROUP BY ALL) q GROUP BY ALL),
 rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY x) + (count(*) OVER (PARTITION BY {k}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {k} ORDER BY y) + (count(*) OVER (PARTITION BY {k}, y) - 1) / 2.0 AS ry FROM ok),
 sp AS (SELECT {k}, count(*) AS n_samples, avg(abs(x - y)) AS mae, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM rk GROUP BY ALL),
 stats AS (SELECT sp.*, CASE WHEN (n0 - n1) * (n0 - n2) > 0 THEN num / sqrt((n0 - n1) * (n0 - n2)) END AS tau
  FROM (SELECT *, n_samples * (n_samples - 1) / 2.0 AS n0 FROM sp) sp JOIN nm ON {on("sp", "nm")} JOIN tx ON {on("sp", "tx")} JOIN ty ON {on("sp", "ty")})"""


_ROUND = lambda x: f"CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END"
_R3 = f"{_ROUND('tau')} AS tau, {_ROUND('spearman')} AS spearman, {_ROUND('mae')} AS mae, n_samples"
_ZERO = lambda c: "0.0" if c == "pair_score" else "t.{c}".format(c=c)


def _compare_sql(ctes: str, theirs: str, keys: list[str], columns: list[str], group: list[str], model: bool = False) -> str:
    on = " AND ".join(f"o.{x} = t.{x}" for x in keys)
    extra = ("t.rater_index, " if "rater_index" in group else "") + ("t.candidate_type AS model, " if model else "")
    parts = " UNION ALL ".join(f"SELECT {extra}'{c}' AS column_name, CAST(o.{c} AS DOUBLE) AS x, CAST({_ZERO(c)} AS DOUBLE) AS y FROM ours o JOIN {theirs} t ON {on}" for c in columns)
    return f"WITH {ctes}, {_stats_sql(parts, group)}"


_W = r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+'"
_WORDS = lambda c: f"list_filter(regexp_split_to_array(coalesce({c}, ''), {_W}), lambda w: w <> '')"
_BLEU = """CASE WHEN len(c) > 0 AND m > 0 THEN (CASE WHEN len(c) > len(r) THEN 1.0 ELSE exp(1.0 - len(r) / CAST(len(c) AS DOUBLE)) END) * m / len(c) ELSE 0.0 END"""
_BLEU_FROM = f"(SELECT *, coalesce(list_sum(list_transform(list_distinct(c), lambda w: least(len(list_filter(c, lambda v: v = w)), len(list_filter(r, lambda v: v = w))))), 0) AS m FROM (SELECT *, {_WORDS('ground_truth')} AS r, {_WORDS('candidate_report')} AS c FROM %s) q1) q2"
_SIDES = """e AS (SELECT * FROM entity_decisions WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND entity IS NOT NULL AND presence IN ('POSITIVE', 'NEGATIVE', 'UNCERTAIN')),
 st AS (SELECT *, regexp_replace(entity, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g') AS sent FROM e),
 nk AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(entity, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> ''), ' ') AS k FROM e),
 ov AS (SELECT study_id, candidate_reporter, sent AS entity, pos FROM st r WHERE side = 'ref' AND EXISTS (SELECT 1 FROM st c WHERE c.side = 'cand' AND c.study_id = r.study_id AND c.candidate_reporter = r.candidate_reporter AND c.sent = r.sent)
  QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter, sent ORDER BY pos NULLS FIRST, decision_id) = 1),
 ok AS (SELECT study_id, candidate_reporter, array_to_string(list_filter(regexp_split_to_array(entity, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> ''), ' ') AS k FROM ov)"""


def _one_sided_sql(here: str, there: str) -> str:
    return f"""(SELECT * FROM nk a WHERE side = '{here}' AND NOT EXISTS (SELECT 1 FROM nk b WHERE b.side = '{there}' AND b.study_id = a.study_id AND b.candidate_reporter = a.candidate_reporter AND b.k = a.k)
 AND NOT EXISTS (SELECT 1 FROM ok o WHERE o.study_id = a.study_id AND o.candidate_reporter = a.candidate_reporter AND o.k = a.k)
 QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter, k ORDER BY pos DESC NULLS LAST, decision_id DESC) = 1) z"""


_MISSING = f"SELECT study_id, candidate_reporter, entity, k AS entity_norm, 'missing_in_candidate' AS discrepancy_type, presence AS reference_presence, 'NOT MENTIONED' AS candidate_presence, sentence AS reference_report_finding, CAST(NULL AS VARCHAR) AS candidate_report_finding FROM {_one_sided_sql('ref', 'cand')}"
_EXTRA = f"SELECT study_id, candidate_reporter, entity, k AS entity_norm, 'extra_in_candidate' AS discrepancy_type, 'NOT MENTIONED' AS reference_presence, presence AS candidate_presence, CAST(NULL AS VARCHAR) AS reference_report_finding, sentence AS candidate_report_finding FROM {_one_sided_sql('cand', 'ref')}"
_DEDUP = "SELECT study_id, candidate_reporter, side, entity, pos, decision_id FROM entity_decisions WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND side IS NOT NULL AND entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter, side, entity ORDER BY {o}) = 1"
_PAIR_SCORE = f"""SELECT p.study_id, p.candidate_reporter, coalesce(q.pair_score, 0.0) AS pair_score FROM (SELECT DISTINCT study_id, candidate_reporter FROM reports WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL) p
 LEFT JOIN (SELECT study_id, candidate_reporter, sum({_PENALTY}) AS pair_score FROM f GROUP BY ALL) q ON p.study_id = q.study_id AND p.candidate_reporter = q.candidate_reporter"""
_LONG = _compare_sql(f"{_FINDINGS}, {_OURS['a']}, {_RATERS}, {_AVG}", "av", raters.KEYS, [*COUNTS_A, *TOTALS], ["model", "column_name"], model=True)
_B_OURS = f"oursb AS (SELECT study_id, {', '.join(f'sum({c}) AS {c}' for c in (*COUNTS_B, *TOTALS))} FROM ours GROUP BY 1)"



def _text(s: str) -> str:
    """A text as SQL."""
    return "'" + s.replace("'", "''") + "'"


_STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"

ORACLE = {
    "pair_score": f"WITH {_FINDINGS} {_PAIR_SCORE}",
    "entity_penalty": f"WITH {_FINDINGS} SELECT compare_id, s AS significance, {_PENALTY} AS penalty FROM f",
    "error_counts_a": f"WITH {_FINDINGS} SELECT study_id, candidate_reporter, sum({_PENALTY}) AS pair_score, {_counts_sql('a')} FROM f GROUP BY 1, 2",
    "error_counts_b": f"WITH {_FINDINGS} SELECT study_id, candidate_reporter, sum({_PENALTY}) AS pair_score, {_counts_sql('b')} FROM f GROUP BY 1, 2",
    "score_summary": f"WITH {_FINDINGS}, z AS ({_PAIR_SCORE}) SELECT count(pair_score) AS n, round(avg(pair_score), 6) AS mean, round(stddev_samp(pair_score), 6) AS std, round(min(pair_score), 6) AS least, round(quantile_cont(pair_score, 0.25), 6) AS q25, round(quantile_cont(pair_score, 0.5), 6) AS q50, round(quantile_cont(pair_score, 0.75), 6) AS q75, round(max(pair_score), 6) AS most FROM z",
    "allowed_entities": "SELECT entity, count(*) AS n_rows FROM entity_decisions WHERE entity IN (SELECT entity_key FROM taxonomy) GROUP BY 1",
    "entity_overlap": f"WITH {_SIDES} SELECT * FROM ov",
    "missing_in_candidate": f"WITH {_SIDES} {_MISSING}",
    "extra_in_candidate": f"WITH {_SIDES} {_EXTRA}",
    "merged_entities": f"WITH {_SIDES} SELECT study_id, candidate_reporter, 0 AS section, entity, CAST(NULL AS VARCHAR) AS discrepancy_type FROM ov UNION ALL SELECT study_id, candidate_reporter, 1, entity, discrepancy_type FROM ({_MISSING}) UNION ALL SELECT study_id, candidate_reporter, 2, entity, discrepancy_type FROM ({_EXTRA})",
    "dedup_keep_first": _DEDUP.format(o="pos NULLS FIRST, decision_id"),
    "dedup_keep_last": _DEDUP.format(o="pos DESC NULLS LAST, decision_id DESC"),
    "significance_join": f"WITH {_FINDINGS} SELECT compare_id, significance_score, rationale FROM f",
    "significance_status": """WITH u AS (SELECT study_id, candidate_reporter, entity, 1 AS c, 0 AS s FROM compare_rows WHERE deleted_at IS NULL AND study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND entity IS NOT NULL
 UNION ALL SELECT study_id, candidate_reporter, entity, 0, 1 FROM scored_entities WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND entity IS NOT NULL),
 p AS (SELECT study_id, candidate_reporter, entity, sum(c) AS c, sum(s) AS s FROM u GROUP BY ALL),
 q AS (SELECT study_id, candidate_reporter, CAST(sum(CASE WHEN s = 0 THEN c ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN c = 0 THEN s ELSE 0 END) AS BIGINT) AS n_extra FROM p GROUP BY ALL)
 SELECT *, CASE WHEN n_missing > 0 OR n_extra > 0 THEN 'failed' ELSE 'ok' END AS status FROM q""",
    "rater_table_a": f"WITH {_RATERS} SELECT * FROM ra",
    "rater_avg": f"WITH {_RATERS}, {_AVG} SELECT study_id, candidate_type, {', '.join(f'round({c}, 6) AS {c}' for c in (*COUNTS_A, *TOTALS))} FROM av",
    "rater_table_b": f"WITH {_wide_sql()} SELECT * FROM rb",
    "compare_per_rater": _compare_sql(f"{_FINDINGS}, {_OURS['a']}, {_RATERS}", "ra", raters.KEYS, COMPARED_A, ["rater_index", "column_name"]) + f" SELECT rater_index, column_name, {_R3} FROM stats",
    "compare_avg": _compare_sql(f"{_FINDINGS}, {_OURS['a']}, {_RATERS}, {_AVG}", "av", raters.KEYS, COMPARED_A, ["column_name"]) + f" SELECT column_name, {_R3} FROM stats",
    "compare_b": _compare_sql(f"{_FINDINGS}, {_OURS['b']}, {_B_OURS}, {_wide_sql()}", "rb", ["study_id"], COMPARED_B, ["column_name"]).replace("FROM ours o", "FROM oursb o") + f" SELECT column_name, {_R3} FROM stats",
    "score_vs_counts": f"WITH {_FINDINGS}, {_OURS['a']}, {_stats_sql(' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS column_name, pair_score AS x, CAST({c} AS DOUBLE) AS y FROM ours' for c in TOTALS), ['column_name'])} SELECT column_name, {_R3} FROM stats",
    "collated_long": f"{_LONG} SELECT model, column_name, {_R3} FROM stats",
    "collated_wide": f"{_LONG}, z AS (SELECT model, column_name, {_R3} FROM stats) SELECT column_name, {', '.join(f'max(CASE WHEN model = {chr(39)}{m}{chr(39)} THEN {s} END) AS {m}__{s}' for m in MODELS for s in ('tau', 'spearman', 'mae', 'n_samples'))} FROM z GROUP BY 1",
    "token_norm": f"SELECT section_id, CASE WHEN findings IS NOT NULL THEN coalesce(array_to_string({_WORDS('findings')}, ' '), '') END AS normalised, regexp_replace(findings, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g') AS stripped FROM report_sections",
    "bleu1": f"SELECT report_row_id, round({_BLEU}, 6) AS bleu1 FROM {_BLEU_FROM % 'reports'}",
    "metric_corr_bleu1": f"""WITH {_RATERS}, {_AVG}, tr AS (SELECT * FROM reports WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter ORDER BY report_row_id) = 1),
 mb AS (SELECT study_id, candidate_reporter, round({_BLEU}, 9) AS bleu1 FROM {_BLEU_FROM % 'tr'}),
 {_stats_sql(" UNION ALL ".join(f"SELECT '{t}' AS target, bleu1 AS x, total_{t} AS y FROM mb JOIN av ON mb.study_id = av.study_id AND mb.candidate_reporter = av.candidate_type" for t in ("significant", "insignificant")), ["target"])}
 SELECT 'bleu1' AS metric, {", ".join(_ROUND(f"-max(CASE WHEN target = '{t}' THEN {c} END)") + f" AS {t}_{c}" for t in ("significant", "insignificant") for c in ("tau", "spearman"))}, max(CASE WHEN target = 'significant' THEN n_samples END) AS n_samples FROM stats""",
    "resume_anti": "SELECT DISTINCT study_id, candidate_reporter FROM reports r WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gema_scores g WHERE g.gema IS NOT NULL AND g.study_id = r.study_id AND g.candidate_reporter = r.candidate_reporter)",
    "json_sanitize": r"""SELECT score_id, regexp_replace(translate(regexp_replace(eval_result, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'), '“”’', '""'''), ',[\s\x0b]*([}\]])', '\1', 'g') AS clean FROM gema_scores""",
    "json_first_array": r"""SELECT scored_id, nullif(regexp_extract('Answer: [1] [ {"entity": "' || entity || '"}, {"n": [2]} ] and more [{}]', '(?s)(\[\s*\{.*?\}\s*\])', 1), '') AS found FROM scored_entities""",
    "sections": "SELECT section_id, " + ", ".join(f"coalesce(translate({k}, '“”’', '\"\"'''), '') AS {k}" for k in jsonscan.SECTION_KEYS) + " FROM report_sections",
    "taxonomy_pairs": "SELECT category, count(*) AS n_entities, string_agg('- ' || entity_key, chr(10) ORDER BY ord) AS prompt_lines FROM taxonomy GROUP BY 1",
    "model_routing": r"SELECT DISTINCT file_name, regexp_replace(regexp_replace(file_name, '^run_[0-9]+_', ''), '[.]csv$', '') AS model, replace(replace(regexp_replace(regexp_replace(file_name, '^run_[0-9]+_', ''), '[.]csv$', ''), '-', '_'), '/', '_') AS safe_model, false AS hosted FROM findings_raw",
    "score_histogram": f"""WITH {_FINDINGS}, z AS ({_PAIR_SCORE}), r AS (SELECT min(pair_score) AS lo, CASE WHEN max(pair_score) > min(pair_score) THEN max(pair_score) - min(pair_score) ELSE 1.0 END / 20 AS w FROM z),
 b AS (SELECT CAST(least(floor((pair_score - lo) / w), 19) AS INT) AS bin, lo, w FROM z, r) SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS n FROM b GROUP BY bin, lo, w""",
    "greedy_cosine_f1": """WITH e AS (SELECT label, CAST(floor(vec_id / 32) AS BIGINT) AS run, vec_id % 2 AS side, vec_id, embedding FROM embeddings),
 s AS (SELECT a.label, a.run, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM e a JOIN e b ON a.label IS NOT DISTINCT FROM b.label AND a.run = b.run AND a.side = 0 AND b.side = 1),
 r AS (SELECT label, run, avg(m) AS v FROM (SELECT label, run, i, max(c) AS m FROM s GROUP BY ALL) q GROUP BY ALL), p AS (SELECT label, run, avg(m) AS v FROM (SELECT label, run, j, max(c) AS m FROM s GROUP BY ALL) q GROUP BY ALL)
 SELECT g.label, g.run, round(CASE WHEN r.v + p.v <> 0 THEN 2 * p.v * r.v / (p.v + r.v) ELSE 0.0 END, 4) AS f1 FROM (SELECT DISTINCT label, run FROM e) g LEFT JOIN r ON g.label IS NOT DISTINCT FROM r.label AND g.run = r.run LEFT JOIN p ON g.label IS NOT DISTINCT FROM p.label AND g.run = p.run""",
    "scatter_points": f"WITH {_FINDINGS}, {_OURS['a']}, {_RATERS}, {_AVG}, j AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(ours.{c} AS DOUBLE) AS ours, av.{c} AS rater FROM ours JOIN av USING (study_id, candidate_type)" for c in TOTALS) + "), l AS (SELECT column_name, least(min(ours), min(rater)) - 0.5 AS low, greatest(max(ours), max(rater)) + 0.5 AS high FROM j GROUP BY 1) SELECT column_name, ours, round(rater, 6) AS rater, count(*) AS n, low, high FROM j JOIN l USING (column_name) GROUP BY column_name, ours, rater, low, high",
    "collated_ordered": f"{_LONG} SELECT model, column_name, {_R3} FROM stats ORDER BY column_name, model",
    "done_files": "SELECT DISTINCT file_name FROM findings_raw WHERE file_name LIKE '%.csv' OR starts_with(file_name, 'run_') ORDER BY 1",
    "first_studies": "SELECT DISTINCT study_id FROM reports WHERE study_id IS NOT NULL ORDER BY 1 LIMIT 5",
    "extract_prompts": f"SELECT report_row_id, replace({_text(prompts.EXTRACTION)}, '{{entity_list}}', (SELECT string_agg('- ' || entity_key, chr(10) ORDER BY ord) FROM taxonomy)) AS system, {_text(prompts.EXTRACT_FROM)} || ground_truth AS asked FROM reports WHERE ground_truth IS NOT NULL",
    "compare_prompts": f"""WITH {_SIDES}, l AS (SELECT study_id, candidate_reporter, '[' || chr(10) || '  ' || string_agg(CAST(to_json(entity) AS VARCHAR), ',' || chr(10) || '  ' ORDER BY pos NULLS FIRST, entity) || chr(10) || ']' AS l FROM ov GROUP BY 1, 2),
 tr AS (SELECT * FROM reports WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter ORDER BY report_row_id) = 1)
 SELECT study_id, candidate_reporter, replace({_text(prompts.COMPARISON)}, '{{ entity_list_json }}', l) AS system, {_text(prompts.COMPARE_THESE + prompts.REFERENCE)} || {_STRIP('ground_truth')} || chr(10) || chr(10) || {_text(prompts.CANDIDATE)} || {_STRIP('candidate_report')} AS asked
 FROM tr JOIN l USING (study_id, candidate_reporter) WHERE ground_truth IS NOT NULL AND candidate_report IS NOT NULL""",
    "significance_prompts": f"""WITH {_FINDINGS}, o AS (SELECT study_id, candidate_reporter, compare_id, '{{' || chr(10) || '    ' || array_to_string(list_filter([{", ".join(f"""{'CASE WHEN discrepancy_type IS NOT NULL THEN ' if c == 'discrepancy_type' else ''}'"{c}": ' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null'){' END' if c == 'discrepancy_type' else ''}""" for c in ("entity", "reference_report_finding", "candidate_report_finding", *DETAILS))}], lambda v: v IS NOT NULL), ',' || chr(10) || '    ') || chr(10) || '  }}' AS j FROM fc),
 l AS (SELECT study_id, candidate_reporter, '[' || chr(10) || '  ' || string_agg(j, ',' || chr(10) || '  ' ORDER BY compare_id) || chr(10) || ']' AS l FROM o GROUP BY 1, 2),
 tr AS (SELECT * FROM reports WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter ORDER BY report_row_id) = 1)
 SELECT study_id, candidate_reporter, {_text(prompts.REFERENCE)} || ground_truth || chr(10) || chr(10) || {_text(prompts.ENTITIES_JSON)} || l AS asked FROM tr JOIN l USING (study_id, candidate_reporter) WHERE ground_truth IS NOT NULL""",
    "section_prompts": f"SELECT report_row_id, {_text(prompts.SECTIONS['system_prompt'])} AS system, replace({_text(prompts.SECTIONS['user_template'])}, '{{report_text}}', {_STRIP('ground_truth')}) AS asked FROM reports WHERE ground_truth IS NOT NULL",
    "judge_prompts": f"SELECT report_row_id, {_text(prompts.JUDGE + chr(10) + prompts.JUDGE_CANDIDATE)} || candidate_report || chr(10) || chr(10) || {_text(prompts.JUDGE_REFERENCE)} || ground_truth || chr(10) AS asked FROM reports WHERE ground_truth IS NOT NULL AND candidate_report IS NOT NULL",
    "external_scores": f"""SELECT report_row_id, round(CASE WHEN len(r) + len(c) > 0 THEN len(list_intersect(r, c)) / CAST(len(list_distinct(list_concat(r, c))) AS DOUBLE) ELSE 0.0 END, 6) AS overlap
 FROM (SELECT report_row_id, list_distinct({_WORDS('ground_truth')}) AS r, list_distinct({_WORDS('candidate_report')}) AS c FROM reports) q""",
    "judge_corr": f"""WITH {_RATERS}, {_AVG}, gm AS (SELECT * FROM gema_scores WHERE study_id IS NOT NULL AND candidate_reporter IS NOT NULL AND gema IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id, candidate_reporter ORDER BY scored_at DESC NULLS LAST, score_id DESC) = 1),
 {_stats_sql(" UNION ALL ".join(f"SELECT '{t}' AS target, gema AS x, total_{t} AS y FROM gm JOIN av ON gm.study_id = av.study_id AND gm.candidate_reporter = av.candidate_type" for t in ("significant", "insignificant")), ["target"])}
 SELECT target, {_ROUND('-tau')} AS tau, {_ROUND('-spearman')} AS spearman, n_samples FROM stats""",
}
