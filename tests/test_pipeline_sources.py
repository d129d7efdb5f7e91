import datetime as dt
import json
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.__main__ import main
from pairlens.plans import prompts, scorers
from pairlens.plans.model import LocalClient, RuleBasedClient, ask, unload
from pairlens.plans.pipeline import LABELS, Prompts, compare_shared, evaluate_pairs, extract, first_of_each, parse_sections, rate, run_batches
from pairlens.sources import files
from pairlens.streaming import scoring

PAIRS = "study_id string, candidate_reporter string, reference_text string, candidate_text string"


class Broken(RuleBasedClient):
    """Gives a bad presence where the report says so: once, or in the repair as well."""

    def complete(self, messages, max_tokens=0, temperature=0.0):
        user = messages[-1]["content"]
        repair = "Validation error" in user
        if "raise" in user:
            raise OSError("down")
        if repair and "wrong once" in user:
            report = user.partition("Report:\n")[2].partition("\n\nValidation error")[0]
            listed = user.partition("Allowed entities:\n")[2].partition("\n\nReport:")[0]
            assert "presence must be one of" in user and "MAYBE" in user.partition("Bad output")[2]
            return super().complete([{"content": listed}, {"content": prompts.EXTRACT_FROM + report}])
        answer = super().complete(messages, max_tokens, temperature)
        if "wrong" in user and user.startswith(prompts.EXTRACT_FROM):
            return answer.replace("POSITIVE", "MAYBE").replace("NEGATIVE", "MAYBE")
        return answer


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([(1, "Nodule", "Lung :: Nodule"), (2, "Effusion", "Pleura :: Effusion"), (3, "Cardiomegaly", "Heart :: Cardiomegaly")], "ord int, entity string, entity_key string")


def test_whole_evaluation(spark, taxonomy):
    ref = "There is a nodule in the left lung. No effusion."
    rows = [("s", "same", ref, ref), ("s", "other", ref, "There is a nodule in the right lung. Cardiomegaly is seen."), ("s", "blank", ref, "  "), ("s", "null", None, None), ("s", "bad", ref, "nodule always wrong"), ("s", "down", ref, "nodule raise"), ("s", "mended", ref, "nodule wrong once")]
    found, scores = evaluate_pairs(spark.createDataFrame(rows, PAIRS), taxonomy, Broken())
    s = {r["candidate_reporter"]: r for r in scores.collect()}
    assert len(s) == 7 and s["mended"]["status"] == "repaired" and s["same"]["pair_score"] == 0 and s["other"]["pair_score"] > 0
    assert [s[k]["status"] for k in ("same", "other", "blank", "null", "bad", "down")] == ["ok", "ok", "empty", "empty", "failed", "failed"]
    assert "OSError" in s["down"]["error"] and s["same"]["error"] is None and "empty" in s["blank"]["error"]
    kinds = {(r["entity"], r["discrepancy_type"]) for r in found.where("candidate_reporter = 'other'").collect()}
    assert kinds == {("Lung :: Nodule", None), ("Pleura :: Effusion", "missing_in_candidate"), ("Heart :: Cardiomegaly", "extra_in_candidate")}


class Scripted:
    """Gives the answers it was made with, one after another per first words of the prompt."""

    threads = 1

    def __init__(self, *answers):
        self.answers = answers

    def complete(self, messages, max_tokens=0, temperature=0.0):
        second = any(x in messages[-1]["content"] for x in ("Validation error", "BAD_OUTPUT"))
        answer = self.answers[second]
        if answer is None:
            raise OSError("down")
        return answer


def test_failing_calls_stay_with_their_row(spark):
    d = spark.createDataFrame([(1, "raise"), (2, "x")], "k int, t string").select("k", prompts.messages(F.lit(""), F.concat(F.lit(prompts.EXTRACT_FROM), F.col("t"))).alias("messages"))
    got = {r["k"]: r for r in ask(d, Broken()).collect()}
    assert got[1]["raw"] is None and "OSError" in got[1]["error"] and got[2]["raw"].endswith("[]")


ENTITY = '{"entity": "Lung :: Nodule", "presence": "POSITIVE", "sentence": "a nodule"}'


@pytest.mark.parametrize(
    ("first", "second", "status", "n"),
    [
        (f"see [{ENTITY},]", None, "ok", 1), (f"[{ENTITY}, {ENTITY}]", None, "ok", 1), ("[]", None, "ok", 0), ("no array", f"[{ENTITY}]", "repaired", 1), (f"[{ENTITY[:-1]}, \"more\": 1}}]", "[]", "repaired", 0),
        (f"[{ENTITY.replace('POSITIVE', 'NOT MENTIONED')}]", "still none", "failed", 0), (f"[{ENTITY.replace('Nodule', 'Dragon')}]", None, "ok", 0), (f"[{ENTITY}, {{}}]", f"[{ENTITY}]", "repaired", 1), (None, f"[{ENTITY}]", "repaired", 1),
    ],
)
def test_extraction_answers(spark, taxonomy, first, second, status, n):
    pairs = spark.createDataFrame([("s", "c", "A nodule.", "")], PAIRS)
    rows = extract(pairs, taxonomy, Scripted(first, second)).where("side = 'ref'").collect()
    assert {r["status"] for r in rows} == {status} and sum(r["entity"] is not None for r in rows) == n


def compare_row(entity, **changes):
    return {"entity": entity, "reference_report_finding": "a", "candidate_report_finding": "b", "diagnosis_concordance": "partial", "location_concordance": "not mentioned", "severity_concordance": "concordant", "temporal_comparison": "candidate-adds"} | changes


def test_comparison_answers(spark):
    side = lambda *e: spark.createDataFrame([("s", "c", k, k, x) for k, x in enumerate(e)], "study_id string, candidate_reporter string, row int, pos int, entity string")
    pairs = spark.createDataFrame([("s", "c", " ref ", "cand")], PAIRS)
    run = lambda *a: compare_shared(pairs, side("B", "A", "only"), side("A", "B"), Scripted(*a)).collect()[0]
    assert run("x " + json.dumps([compare_row("A"), compare_row("B")]), None)["status"] == "ok"
    assert run("", None)["expected"] == ["B", "A"]
    lacking = run(json.dumps([compare_row("A")]), json.dumps([compare_row("A"), compare_row("B")]))
    assert lacking["status"] == "repaired"
    assert "left out: B" in run(json.dumps([compare_row("A")]), json.dumps([compare_row("A")]))["error"]
    assert "not asked for: C" in run("", json.dumps([compare_row(x) for x in "ABC"]))["error"]
    assert "location_concordance" in run("", json.dumps([compare_row("A", location_concordance="odd"), compare_row("B")]))["error"]
    assert compare_shared(pairs, side("A"), side("B"), Scripted(None, None)).collect() == []


def test_ratings_come_as_object_or_array(spark):
    rows = [{"entity": "A", "significance_score": 3, "rationale": "first"}, {"entity": "A", "significance_score": 1, "rationale": "again"}]
    pairs = spark.createDataFrame([("s", "c", "ref", "cand")], PAIRS)
    fields = ["reference_report_finding", "candidate_report_finding", *LABELS, "discrepancy_type"]
    merged = spark.createDataFrame([("s", "c", "A")], "study_id string, candidate_reporter string, entity string").select("*", *[F.lit("concordant").alias(c) for c in fields], F.lit(0).alias("section"), F.lit(0).alias("order"))
    for answer in (json.dumps(rows), "so: " + json.dumps({"scored_entities": rows})):
        got = rate(pairs, merged, Scripted(answer, None))
        assert [r["status"] for r in got.collect()] == ["ok"]
        assert [tuple(r)[2:] for r in first_of_each(got, "significance_score", "rationale").collect()] == [("A", 3, "first", 0)]
    for bad in (json.dumps({"scored_entities": rows, "more": 1}), json.dumps([rows[0] | {"significance_score": 5}]), json.dumps([rows[0] | {"entity": "B"}]), json.dumps([{"entity": "A", "significance_score": 1}])):
        assert rate(pairs, merged, Scripted(bad, bad)).collect()[0]["status"] == "failed"


def test_sections_of_reports(spark):
    d = spark.createDataFrame([(1, "FINDINGS: clear.\nIMPRESSION: none"), (2, " "), (3, None)], "id int, t string")
    got = {r["id"]: r for r in parse_sections(d, ["id"], "t", RuleBasedClient()).collect()}
    assert (got[1]["findings"], got[1]["impression"], got[1]["history"], got[1]["status"]) == ("clear.", "none", "", "ok")
    assert got[2]["status"] == got[3]["status"] == "empty" and got[3]["findings"] is None
    one = d.where("id = 1")
    assert parse_sections(one, ["id"], "t", Scripted("?", '{"findings": 5, "odd": 1,}')).collect()[0].asDict() == {"id": 1, "history": "", "technique": "", "comparison": "", "findings": "5", "impression": "", "others": "", "status": "repaired", "error": None}
    assert parse_sections(one, ["id"], "t", Scripted("?", "?")).collect()[0]["status"] == "failed"


def test_batches_go_on_where_they_stopped(spark, taxonomy, tmp_path):
    ref = "There is a nodule in the left lung."
    pairs = spark.createDataFrame([("s", str(k), ref, "raise" if k == 3 else ref) for k in range(6)], PAIRS)
    sink = str(tmp_path / "out")
    made = []

    def client():
        made.append(1)
        return Broken()

    def fatal():
        raise OSError("no such model")

    assert run_batches(pairs, taxonomy, {"a-b/c": client, "gone": fatal}, sink, slices=2) == {"a-b/c": "ok", "gone": "OSError: no such model"}
    done = spark.read.parquet(sink + "/a_b_c")
    assert done.count() == 6 and done.where("status = 'failed'").count() == 1 and {len(r["findings"]) for r in done.where("status = 'ok'").collect()} == {1}
    assert run_batches(pairs.where("candidate_reporter <> '3'"), taxonomy, {"a-b/c": client}, sink, slices=2) == {"a-b/c": "ok"}
    assert spark.read.parquet(sink + "/a_b_c").count() == 6


def test_prompt_files(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("# c\nprompt: |\n  One: {entity_list}\n\n    two # no comment\n")
    assert prompts.read_prompts(str(f), "prompt") == {"prompt": "One: {entity_list}\n\n  two # no comment\n"}
    f.write_text("system_prompt: a\nuser_template: |\n  b {report_text}\nrepair_instructions: 'c'\nmore: d\n")
    assert Prompts.read(sections=str(f)).sections == {"system_prompt": "a", "user_template": "b {report_text}\n", "repair_instructions": "c"}
    for keys in (("prompt",), ("system_prompt", "user_template", "repair_instructions")):
        with pytest.raises(ValueError, match="missing|unknown"):
            prompts.read_prompts(str(f), *keys)
    assert prompts.raw_prompt(str(f)).startswith("system_prompt: a")


def test_scorers(spark):
    d = spark.createDataFrame([(1, "a b", "a c"), (2, None, ""), (3, "x", "x")], "id int, a string, b string")
    got = {r["id"]: r["s"] for r in scorers.external_scores(d, scorers.WordOverlap(), "a", "b", "s").collect()}
    assert got == {1: pytest.approx(1 / 3), 2: 0.0, 3: 1.0}
    lengths = scorers.ProgramScorer([sys.executable, "-c", "import json, sys\nfor l in sys.stdin: print(len(json.loads(l)['reference']))"])
    assert sorted(r["s"] for r in scorers.external_scores(d, lengths, "a", "b", "s").collect()) == [0.0, 1.0, 3.0]
    with pytest.raises(RuntimeError, match="ended with 3: bad"):
        scorers.ProgramScorer([sys.executable, "-c", "import sys; sys.stderr.write('bad'); sys.exit(3)"]).score(["a"], ["b"])
    cache = spark.createDataFrame([(1, 9.0), (2, None)], "id int, s double")
    assert {r["id"]: r["s"] for r in scorers.external_scores(d, scorers.WordOverlap(), "a", "b", "s", cache, ["id"]).collect()} == {1: 9.0, 2: 0.0, 3: 1.0}
    with pytest.raises(ValueError, match="missing"):
        scorers.external_scores(d, scorers.WordOverlap(), "nope", "b", "s")


def test_judged_pairs(spark):
    d = spark.createDataFrame([(1, "a b", "a c"), (2, " ", "x"), (3, "q", "q")], "id int, a string, b string")
    got = {r["id"]: r for r in scorers.judge_scores(d, RuleBasedClient(), "a", "b").collect()}
    assert got[1]["judge"] == pytest.approx(1 / 3) and got[3]["judge"] == 1.0 and json.loads(got[2]["eval_result"]) == {"error": "empty input"}
    long = {r["id"]: r for r in scorers.judge_scores(d, Scripted("no score " * 400, None), "a", "b").collect()}
    assert long[1]["judge"] is None and len(json.loads(long[1]["eval_result"])["raw_output"]) == 500
    cache = spark.createDataFrame([(1, 0.5, "kept"), (3, None, "x")], "id int, judge double, eval_result string")
    again = {r["id"]: r for r in scorers.judge_scores(d, RuleBasedClient(), "a", "b", cache=cache, keys=["id"]).collect()}
    assert (again[1]["judge"], again[1]["eval_result"], again[3]["judge"]) == (0.5, "kept", 1.0)


def test_local_models_are_loaded_once():
    seen = []
    client = LocalClient("m", lambda name: seen.append(name) or (lambda m, n, t: f" {m[0]['content']} {t} "))
    assert [client.complete([{"content": "x"}], 5, 0.0) for _ in range(2)] == ["x 0.0"] * 2 and seen == ["m"]
    unload()
    with pytest.raises(RuntimeError, match="transformers"):
        LocalClient("m").complete([], 1, 0.0)


def test_files(spark, tmp_path):
    (tmp_path / "run_a.csv").write_text('id,note\n1,"two\nlines, ""quoted"""\n')
    (tmp_path / "run_a_processed.csv").write_text("id,note\n9,x\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("note", T.StringType())])
    got = files.model_of_file(files.read_table(spark, str(tmp_path), schema, "run_*.csv"), "run_").collect()
    assert [(r["id"], r["note"]) for r in got] == [(1, 'two\nlines, "quoted"')]
    assert files.processed_path("x.csv") == "x_processed.csv"
    with pytest.raises(ValueError, match="missing"):
        files.require(spark.range(1), "id", "nope")


def test_taxonomy_and_literals(spark, tmp_path):
    y = tmp_path / "t.yaml"
    y.write_text("Lung:\n  - Nodule\n  - 'Mass'\n\nHeart:  # organ\n  - Large\n")
    assert [tuple(r) for r in files.read_taxonomy(spark, str(y)).orderBy("ord").collect()] == [(1, "Lung", "Nodule", "Lung :: Nodule"), (2, "Lung", "Mass", "Lung :: Mass"), (3, "Heart", "Large", "Heart :: Large")]
    j = tmp_path / "t.json"
    j.write_text(json.dumps({"a": ["b"]}))
    assert files.literal_or_file(str(j)) == {"a": ["b"]} and files.literal_or_file("[1]") == [1] and files.literal_or_file(3) == 3
    with pytest.raises(ValueError):
        files.literal_or_file("not json")


def test_import_resume_and_stream(spark, tmp_path):
    d = spark.createDataFrame([("s", "m", "[{'entity': 'a', 'diagnosis_concordance': 'partial', 'significance_score': 2}]"), ("t", "m", "junk")], "study_id string, candidate_reporter string, cell string")
    flat = files.import_findings(d, "cell").select("study_id", "candidate_reporter", F.explode_outer("cell").alias("f")).select("study_id", "candidate_reporter", "f.*")
    sink = str(tmp_path / "sink")
    assert files.resume(d, sink, ["study_id"]).count() == 2
    files.append(d.where("study_id = 's'").withColumn("status", F.lit("ok")), sink)
    assert [r["study_id"] for r in files.resume(d, sink, ["study_id"]).collect()] == ["t"]
    source = str(tmp_path / "in")
    flat.write.parquet(source)
    q = scoring.score_batches(scoring.findings_stream(spark, source, flat.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = {r["study_id"]: r["pair_score"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"s": 2.0, "t": 0.0}


def test_stream_adds_up_over_batches(spark, tmp_path):
    schema = "study_id string, candidate_reporter string, entity string, diagnosis_concordance string, location_concordance string, severity_concordance string, temporal_comparison string, discrepancy_type string, significance_score int"
    rows = [("s", "m", "a", "partial", None, None, None, None, 2), ("s", "m", "b", "discordant", "partial", None, None, None, 3), ("t", "m", "a", "concordant", None, None, None, None, 0)]
    source = str(tmp_path / "in")
    for k, own in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append" if k else "overwrite").parquet(source)
    out = str(tmp_path / "out")
    scoring.score_batches(scoring.findings_stream(spark, source, spark.createDataFrame([], schema).schema, 1), out, str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    got = {r["study_id"]: r for r in scoring.scores_so_far(spark, out).collect()}
    assert got["s"]["pair_score"] == 8.0 and got["s"]["false_prediction_significant"] == 2 and got["t"]["pair_score"] == 0.0
    scoring.compact(spark, out, str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2


def test_windowed_stream(spark, tmp_path):
    schema = "candidate_reporter string, diagnosis_concordance string, location_concordance string, severity_concordance string, temporal_comparison string, significance_score int, at timestamp"
    d = spark.createDataFrame([("m", "partial", None, None, None, 2, dt.datetime(2024, 1, 1, h)) for h in (1, 5)] + [("m", "partial", None, None, None, 1, dt.datetime(2024, 1, 2))], schema)
    d.write.parquet(str(tmp_path / "in"))
    w = scoring.windowed_scores(scoring.findings_stream(spark, str(tmp_path / "in"), d.schema), "at")
    w.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    assert sorted((r["start"].day, r["penalty"], r["n_findings"]) for r in spark.table("windows").collect()) == [(1, 4.0, 2), (2, 1.0, 1)]


def test_command_line(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    cell = "[{'entity': 'a', 'diagnosis_concordance': 'partial', 'significance_score': %d, 'discrepancy_type': None}]"
    for model in ("m_one", "m_two"):
        lines = [f's{k},c,"{cell % (k % 4)}"' for k in range(8)]
        (tmp_path / "runs" / f"eval_{model}.csv").write_text("study_id,candidate_reporter,findings\n" + "\n".join(lines) + "\n")
    (tmp_path / "studies.csv").write_text("study_number,study_id\n" + "".join(f"{k},s{k}\n" for k in range(8)))
    (tmp_path / "ratings.csv").write_text("study_number,candidate_type,rater_index,error_category,clinically_significant,num_errors\n" + "".join(f"{k},c,{r},1,{'true' if k % 2 else 'false'},{(k + r) % 3}\n" for k in range(8) for r in range(2)))
    (tmp_path / "pairs.csv").write_text("study_id,candidate_reporter,reference_text,candidate_text\n" + "".join(f's{k},c,"A nodule {k}.","A nodule in the lung {k % 3}."\n' for k in range(8)))
    (tmp_path / "taxonomy.yaml").write_text("Lung:\n  - Nodule\n")
    at = lambda x: str(tmp_path / x)
    rows = lambda x: spark.read.option("header", True).csv(at(x)).collect()
    rated = ["--ratings", at("ratings.csv"), "--studies", at("studies.csv")]
    main(["score", "--input", at("runs"), "--output", at("scores")], spark)
    assert {float(r["pair_score"]) for r in rows("scores")} == {0.0, 1.0, 2.0, 3.0} and len(rows("scores")) == 16
    main(["compare", "--input", at("runs"), "--output", at("cmp"), "--prefix", "eval_", *rated], spark)
    assert {r["model"] for r in rows("cmp/collated_long")} == {"m_one", "m_two"} and {r["rater_of"] for r in rows("cmp/by_rater")} == {"0", "1"}
    assert "m_one__tau" in rows("cmp/collated_wide")[0].asDict() and len(rows("cmp/score_against_counts")) == 3
    main(["metrics", "--input", at("pairs.csv"), "--output", at("met"), *rated], spark)
    assert {r["metric"] for r in rows("met/correlations")} == {"BLEU-1", "ROUGE-L", "METEOR"} and len(rows("met/metrics")) == 8
    main(["judge", "--input", at("pairs.csv"), "--output", at("judge"), *rated], spark)
    assert len(rows("judge/correlations")) == 2
    main(["sections", "--input", at("pairs.csv"), "--output", at("sec")], spark)
    assert {r["status"] for r in rows("sec")} == {"ok"}
    main(["evaluate", "--input", at("pairs.csv"), "--output", at("ev"), "--model", "rule-based", "--taxonomy", at("taxonomy.yaml"), "--slices", "1"], spark)
    assert spark.read.parquet(at("ev/rule_based")).count() == 8
    with pytest.raises(SystemExit):
        main(["nothing"], spark)
