from pairlens.operators import entities, raters

E = "study_id string, candidate_reporter string, side string, pos int, entity string, presence string, sentence string, row int"


def make(spark, ref, cand):
    rows = [("s", "m", side, i, e, "POSITIVE", f"about {e}", i) for side, es in (("ref", ref), ("cand", cand)) for i, e in enumerate(es)]
    d = spark.createDataFrame(rows, E)
    return entities.side(d, "ref"), entities.side(d, "cand")


def merged(spark, ref, cand):
    r, c = make(spark, ref, cand)
    rows = entities.merged(r, c, entities.overlap(r, c, "row"), "row").orderBy("section", "pos", "entity").collect()
    return [(x["section"], x["entity"]) for x in rows]


def test_merge_cases(spark):
    assert merged(spark, ["H :: A"], ["H :: A"]) == [(0, "H :: A")]
    assert merged(spark, ["H :: A"], []) == [(1, "H :: A")]
    assert merged(spark, [], ["H :: A"]) == [(2, "H :: A")]
    assert merged(spark, ["H :: A", "H :: B"], ["H :: C", " H :: B "]) == [(0, "H :: B"), (1, "H :: A"), (2, "H :: C")]


def test_inner_space_is_in_neither_result(spark):
    assert merged(spark, ["Heart  ::  X"], ["Heart :: X"]) == []


def test_swapping_sides_swaps_missing_and_extra(spark):
    a = merged(spark, ["A", "B", "C"], ["B", "D"])
    b = merged(spark, ["B", "D"], ["A", "B", "C"])
    assert {(3 - s if s else 0, e) for s, e in a} == set(b)


def test_nulls_and_repeats(spark):
    assert merged(spark, ["A", None, "A"], [None, "A"]) == [(0, "A")]


def test_resume_retries_failed(spark):
    todo = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "study_id string, candidate_reporter string")
    done = spark.createDataFrame([("a", "m", "ok"), ("b", "m", "failed")], "study_id string, candidate_reporter string, status string")
    assert {r[0] for r in entities.not_done(todo, done, ["study_id", "candidate_reporter"], "status <> 'failed'").collect()} == {"b", "c"}


R = "study_number int, study_id string, candidate_type string, rater_index int, error_category int, clinically_significant boolean, num_errors int"


def test_rater_table_a(spark):
    ratings = spark.createDataFrame(
        [(0, "x", "m", 0, 1, True, 2), (0, "x", "m", 0, 1, True, 1), (0, "x", "m", 0, 6, False, 4), (0, "x", "m", 1, 2, True, None), (0, "x", "m", 1, 9, True, 5), (0, "x", "m", 1, 1, None, 5), (7, "x", "m", 0, 1, True, 5), (None, "x", "m", 0, 1, True, 5), (0, "x", None, 0, 1, True, 5)], R
    )
    studies = spark.createDataFrame([(0, "s0"), (1, "s1")], "study_number int, study_id string")
    t = {r["rater_index"]: r for r in raters.rater_table(ratings, studies).collect()}
    assert set(t) == {0, 1} and t[0]["study_id"] == "s0"
    assert (t[0]["false_prediction_significant"], t[0]["omitted_comparison_insignificant"], t[0]["total_errors"], t[0]["total_significant"]) == (3, 4, 7, 3)
    assert t[1]["total_errors"] == 0
    avg = raters.average_rater(raters.rater_table(ratings, studies)).first()
    assert avg["false_prediction_significant"] == 1.5 and avg["total_errors"] == 3.5


def test_rater_table_b_fills_absent_types(spark):
    rows = spark.createDataFrame([("r", "significant", 1, 0, None, 0, 0, 2, 3, 4)], "report_id string, error_type string, one int, two int, three int, four int, five int, six int, seven int, eight int")
    t = raters.rater_table_wide(rows).first()
    assert (t["false_prediction_significant"], t["partial_significant"], t["partial_insignificant"], t["total_errors"]) == (1, 7, 0, 10)


def test_collated_names(spark):
    long = spark.createDataFrame([("m1", "c", 0.5), ("m2", "c", 0.25)], "model string, column_name string, tau double")
    assert raters.collate_wide(long, ["m1", "m2"], ["tau"]).first().asDict() == {"column_name": "c", "m1__tau": 0.5, "m2__tau": 0.25}
