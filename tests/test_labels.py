import random

from pairlens.functions import labels
from pairlens.operators import findings

COLUMNS = "study_id string, candidate_reporter string, entity string, diagnosis_concordance string, location_concordance string, severity_concordance string, temporal_comparison string, discrepancy_type string, significance_score int"


def row(study="s", diag="concordant", loc="concordant", sev="concordant", temp="concordant", kind=None, score=1, entity="e"):
    return (study, "m", entity, diag, loc, sev, temp, kind, score)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def penalties(spark, *rows):
    return [r[0] for r in frame(spark, list(rows)).select(labels.penalty()).collect()]


def test_penalty_cases(spark):
    got = penalties(
        spark,
        row(score=4),
        row(diag="discordant", loc="discordant", sev="discordant", temp="discordant", score=4),
        row(diag="partial", score=2),
        row(loc="candidate-adds", score=3),
        row(sev="candidate-misses", score=2),
        row(diag="discordant", score=0),
        row(diag=None, loc=None, sev=None, temp=None, score=3),
        row(*["s"], *["not mentioned"] * 4, kind="missing_in_candidate", score=4),
        row(diag="partial", score=None),
        row(diag="unheard of", loc="?", score=3),
    )
    assert got == [0, 16, 2, 3, 2, 0, 0, 0, 0, 0]


def test_scores_of_pairs_without_findings(spark):
    f = frame(spark, [row("a", diag="partial", score=2), row("a", loc="partial", sev="partial", score=1, entity="f")])
    pairs = spark.createDataFrame([("a", "m"), ("b", "m")], "study_id string, candidate_reporter string")
    assert {(r[0], r["pair_score"]) for r in findings.pair_scores(f, pairs).collect()} == {("a", 4.0), ("b", 0.0)}
    assert findings.pair_scores(f.limit(0)).collect() == []


def counts(spark, variant, *rows):
    r = findings.error_counts(frame(spark, list(rows)), variant).first().asDict()
    return {k: v for k, v in r.items() if isinstance(v, int) and v}


def test_counts_a(spark):
    got = counts(spark, "a", row(diag="discordant", score=3), row(kind="missing_in_candidate", score=2), row(loc="discordant", score=1), row(temp="candidate-adds", score=2), row(temp="discordant", diag="partial", score=1), row(sev="partial", score=0), row(temp="candidate-misses", score=None))
    assert got == {"false_prediction_significant": 1, "omission_finding_significant": 1, "incorrect_location_insignificant": 1, "extra_comparison_significant": 1, "false_prediction_insignificant": 1}


def test_counts_b_differ(spark):
    got = counts(spark, "b", row(diag="partial", loc="partial", sev="partial", temp="partial", score=3), row(diag="partial", kind="extra_in_candidate", score=2), row(temp="discordant", score=4))
    assert got == {"partial_significant": 4, "false_prediction_insignificant": 1}


def test_score_is_additive_and_free_of_order(spark):
    rng = random.Random(1)
    rows = [row(rng.choice("ab"), rng.choice(labels.DIAGNOSIS_LABELS), *[rng.choice(labels.DETAIL_LABELS) for _ in range(3)], score=rng.randrange(5)) for _ in range(60)]
    one = {r[0]: r["pair_score"] for r in findings.pair_scores(frame(spark, rows)).collect()}
    rng.shuffle(rows)
    assert one == {r[0]: r["pair_score"] for r in findings.pair_scores(frame(spark, rows)).collect()}
    half = [findings.pair_scores(frame(spark, x)).collect() for x in (rows[:30], rows[30:])]
    assert sum(r["pair_score"] for h in half for r in h) == sum(one.values())


def test_keep_first_and_last(spark):
    d = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", None, 3), (None, 1, 4), (None, 0, 5)], "k string, pos int, id int")
    assert {r["id"] for r in findings.keep_first(d, ["k"], "pos", "id").collect()} == {3, 5}
    assert {r["id"] for r in findings.keep_last(d, ["k"], "pos", "id").collect()} == {1, 4}


def test_significance_strict_and_not(spark):
    c = frame(spark, [row(entity="x"), row(entity="y")]).drop("significance_score")
    s = spark.createDataFrame([("s", "m", "x", 2, "r"), ("s", "m", "z", 1, "q")], "study_id string, candidate_reporter string, entity string, significance_score int, rationale string")
    assert {(r["entity"], r["significance_score"]) for r in findings.attach_significance(c, s).collect()} == {("x", 2), ("y", None)}
    r = findings.significance_status(c, s).first()
    assert (r["n_missing"], r["n_extra"], r["status"]) == (1, 1, "failed")


def test_summary_histogram_and_cells(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)] + [(None,)], "v double")
    s = findings.summary(d, "v").first()
    assert (s["n"], s["mean"], s["q25"], s["q50"], s["most"]) == (4, 2.5, 1.75, 2.5, 4.0)
    assert sum(r["n"] for r in findings.histogram(d, "v", 3).collect()) == 4
    assert findings.histogram(d.limit(0), "v").collect() == []
    nested = spark.createDataFrame([("p", [("e", 1)]), ("q", [])], "k string, f array<struct<entity:string,n:int>>")
    assert {(r["k"], r["pos"], r["entity"]) for r in findings.explode_cells(nested, "f", ["k"]).collect()} == {("p", 0, "e"), ("q", None, None)}
