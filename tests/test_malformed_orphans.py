import csv
import datetime as dt
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators import orphans
from pairlens.operators.orphans import find_orphans, merge_intervals, orphan_report
from pairlens.plans.general import RATING_KEYS, p4_loaded_ratings
from pairlens.sources.malformed import CORRUPT, object_fields, object_reason, read_objects, read_records

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("b", T.StringType())])
CHECKS = {"a": lambda c: c != "", "n": lambda c: c.rlike(r"\A[0-9]+\z")}


def read(spark, lines):
    d = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "id int, line string, reason_of string")
    return {r["id"]: r for r in read_records(d, "line", SCHEMA, CHECKS).collect()}


def test_records(spark):
    cases = [("x,1,y", None), ('"x","1","y"', None), ('"x, z",1,"say ""hi"""', None), ('"two\nlines",1,', None), ("x,1", "fields"), ("x,1,y,z", "fields"), ('x,1,y"z', "syntax"), ('"x,1,y', "syntax"), ('"x" ,1,y', "syntax"), (',1,y', "value"), ("x,one,y", "value"), ("", "fields"), (None, "fields"), ('"x"y,1,z', "syntax"), ('""""",1,', "syntax"), ('"""",1,', None), ("x,1,back\\slash", None), ("x\ny,1,z", None), ("x" * 200_000 + ",1,y", None)]
    got = read(spark, [c for c, _ in cases])
    assert [got[i]["reason"] for i in range(len(cases))] == [w for _, w in cases]
    assert tuple(got[2]["record"]) == ("x, z", 1, 'say "hi"') and tuple(got[15]["record"]) == ('"', 1, "") and tuple(got[17]["record"]) == ("x\ny", 1, "z")
    assert got[4]["record"] is None and got[4][CORRUPT] == "x,1" and got[0]["reason_of"] == "extra"
    assert read(spark, []) == {}


def test_records_round_trip(spark):
    rng = random.Random(2)
    rows = [["".join(rng.choice('ab,"\n\r \\#') for _ in range(rng.randrange(1, 9))), str(rng.randrange(99)), "".join(rng.choice('ab,"\n') for _ in range(rng.randrange(9)))] for _ in range(200)]
    lines = []
    for r in rows:
        s = io.StringIO()
        csv.writer(s, lineterminator="").writerow(r)
        lines.append(s.getvalue())
    got = read(spark, lines)
    assert [tuple(got[i]["record"]) for i in range(len(rows))] == [(a, int(n), b) for a, n, b in rows]


def rating(**changes):
    import json

    values = {k: {"count": 0, "score": 0.5, "text": ""}[v] for k, v in RATING_KEYS.items()} | changes
    return json.dumps({k: v for k, v in values.items() if v != "drop"})


@pytest.mark.parametrize(
    ("body", "want"),
    [(rating(), None), ("see " + rating() + " end }", None), (None, None), ("no object", "syntax"), (rating()[:-1], "syntax"), (rating()[:-1] + ",}", "syntax"), (rating().replace('"', "'"), "syntax"), (rating(weighted_final_score="drop"), "fields"), (rating(more=1), "fields"), (rating(weighted_final_score=1.5), "value"), (rating(weighted_final_score=True), "value"), (rating(**{"location omission": 1.5}), "value"), (rating(**{"location omission": -1}), "value"), (rating(readability_reason=None), "value"), (rating(weighted_final_score=1), None), (rating().replace("0.5", "NaN"), "syntax"), (rating(readability_reason="a\nb").replace("\\n", "\n"), "syntax"), ("[" * 100_000, "syntax"), ("{" + '"a":{' * 5000, "syntax"), ("", "syntax")],
)
def test_objects(body, want):
    assert object_reason(body, RATING_KEYS) == want


def test_objects_keep_raw_text(spark):
    d = spark.createDataFrame([(1, "x " + rating() + "\n"), (2, "{"), (3, None)], "id int, t string")
    got = {r["id"]: r for r in read_objects(d, "t", RATING_KEYS).collect()}
    assert got[1]["record"]["weighted_final_score"] == 0.5 and got[1][CORRUPT] is None
    assert (got[2]["reason"], got[2]["record"], got[2][CORRUPT]) == ("syntax", None, "{")
    assert (got[3]["reason"], got[3]["record"]) == (None, None)


def test_loaded_ratings_are_whole(spark, tmp_path):
    body = rating(**{"location omission": 2**53 + 1, "location omission_explanation": 'a "b"\nc', "readability_reason": "é"})
    d = spark.createDataFrame([(1, "x " + body + "\n"), (2, "{"), (3, None)], "score_id int, eval_result string")
    d.write.parquet(str(tmp_path / "gema_scores.parquet"))
    got = p4_loaded_ratings(spark, str(tmp_path)).collect()
    assert [r["score_id"] for r in got] == [1] and len(got[0]) == 1 + len(RATING_KEYS) == 24
    r = got[0].asDict()
    assert (r["location_omission"], r["location_omission_explanation"], r["readability_reason"]) == (2**53 + 1, 'a "b"\nc', "é")
    assert r["severity_false_prediction_explanation"] == "" and r["weighted_final_score"] == 0.5


def test_both_readings_of_objects_agree(spark):
    """What the engine vouches for is what the strict parser accepts, and no value gets lost."""
    rng = random.Random(6)
    odd = ['1.0', '-0', '0', '1e0', '12345678901234567890', '9' * 38, '9' * 41, '1' + '0' * 1100, '0.' + '1' * 60, '1e-400', '1e400', '"a"', 'null', '{}', '[1]', '"\\ud83d\\ude00"', '"\\ud800"', '"\\u0041\\n"', "'a'", 'NaN', '01', 'true', '"' + "x" * 70_000 + '"', '1.00000000000000000000000001', '"back\\\\slash"', '"é 日本"']
    texts = []
    for _ in range(400):
        own = {k: {"count": "2", "score": "0.25", "text": '"t"'}[v] for k, v in RATING_KEYS.items()}
        for k in rng.sample(list(own), rng.choice([0, 1, 1, 2])):
            own[k] = rng.choice(odd)
        pairs = [f'"{k}": {v}' for k, v in own.items()]
        rng.shuffle(pairs)
        pairs += rng.choice([[], [], [], [pairs[0]], ['"more": 1']])
        texts.append(rng.choice(["", "see [1] ", "}"]) + "{" + ", ".join(pairs) + "}" + rng.choice(["", " end.", "}", " {"]))
    texts += [x[: rng.randrange(len(x))] for x in texts[:40]] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r for r in read_objects(d, "t", RATING_KEYS).collect()}
    loaded = 0
    for i, x in enumerate(texts):
        want, values = object_fields(x, RATING_KEYS)
        assert got[i]["reason"] == want
        assert (got[i]["record"] is not None) == (values is not None) and (got[i][CORRUPT] is None) == (want is None)
        if values is not None:
            loaded += 1
            kinds = {"count": lambda v: Decimal(v), "score": float, "text": str}
            assert tuple(got[i]["record"]) == tuple(kinds[k](v) for k, v in zip(RATING_KEYS.values(), values))
    assert loaded > 80


def test_values_that_no_column_holds_are_not_loaded(spark):
    got = read(spark, ["x,99999999999,y", "x,2147483647,y"])
    assert (got[0]["reason"], got[0]["record"]) == ("value", None) and got[1]["record"]["n"] == 2147483647
    assert object_reason(rating(**{"location omission": 10**40}), RATING_KEYS) == "value"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def live(refs, targets, keys):
    out = set()
    for r in refs:
        if r["ref"] is None:
            continue
        ok = any(all(t[k] == r[k] and r[k] is not None for k in keys) and r["at"] is not None and t["s"] is not None and t["s"] <= r["at"] and (t["e"] is None or r["at"] < t["e"]) for t in targets)
        if not ok:
            out.add(r["id"])
    return out


@pytest.mark.parametrize("limit", [200_000, 3])
def test_orphans_against_brute_force(spark, limit):
    rng = random.Random(4)
    refs = [{"id": i, "grp": rng.choice(["g", "h", None]), "ref": rng.choice(["hot"] * 5 + ["a", "b", "c", None]), "at": rng.choice([None] + [day(k) for k in range(40)] * 3)} for i in range(300)]
    targets = [{"grp": rng.choice(["g", "h"]), "ref": rng.choice(["hot", "a", "b"]), "s": (s := day(rng.randrange(40))), "e": rng.choice([None, s + dt.timedelta(days=rng.randrange(0, 9)), s - dt.timedelta(days=1)])} for _ in range(40)]
    r = spark.createDataFrame(refs, "id int, grp string, ref string, at timestamp").withColumn("s", F.lit("clash"))
    t = spark.createDataFrame(targets, "grp string, ref string, s timestamp, e timestamp").withColumn("id", F.lit(1))
    got = find_orphans(r, t, ["grp", "ref"], "at", "s", "e", broadcast_rows=limit)
    assert {x["id"] for x in got.collect()} == live(refs, targets, ["grp", "ref"])
    rep = orphan_report(r, t, ["grp", "ref"], "at", "s", "e").collect()
    assert sum(x["n_orphans"] for x in rep) == got.count() == sum(x["n_missing"] + x["n_deleted"] + x["n_later"] for x in rep)


def test_report_counts_references_before_the_split(spark, monkeypatch):
    given = []
    monkeypatch.setattr(orphans, "find_orphans", lambda refs, *a: given.append(refs) or find_orphans(refs, *a))
    r = spark.createDataFrame([("a", day(1))] * 50 + [("a", day(40)), (None, day(1)), ("b", None)], "ref string, at timestamp")
    t = spark.createDataFrame([("a", day(30), None)], "ref string, s timestamp, e timestamp")
    got = {x["period"] and x["period"].month: tuple(x)[1:] for x in orphan_report(r, t, ["ref"], "at", "s", "e").collect()}
    assert got == {1: (0, 0, 50, 50), None: (1, 0, 0, 1)} and given[0].count() == 4


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([(1, "a", day(1))], "id int, ref string, at timestamp")
    t = spark.createDataFrame([], "ref string, s timestamp, e timestamp")
    assert [x["id"] for x in find_orphans(r, t, ["ref"], "at", "s", "e").collect()] == [1]
    assert find_orphans(r.limit(0), t, ["ref"], "at", "s", "e").collect() == []


def test_intervals_join(spark):
    d = spark.createDataFrame([("k", day(0), day(2)), ("k", day(2), day(3)), ("k", day(5), day(6)), ("k", day(1), day(2))], "k string, start timestamp, end timestamp")
    assert {(r["start"], r["end"]) for r in merge_intervals(d, ["k"]).collect()} == {(day(0), day(3)), (day(5), day(6))}
