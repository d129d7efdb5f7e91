import json

import pytest
from pyspark.sql import functions as F

from pairlens.functions import jsonscan, metrics, text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value", ["a  b\tc", "  x ", "", " a b\x1c", "a\x85b", "　"])
def test_squish_is_split_and_join(spark, value):
    assert one(spark, text.squish, value) == " ".join(value.split())
    assert one(spark, text.strip, value) == value.strip()


@pytest.mark.parametrize(("raw", "want"), [('{"a": 1,}', '{"a": 1}'), ("[1, 2, ]", "[1, 2]"), ("“a” ’s", "\"a\" 's"), ('  {"a": 1}\n', '{"a": 1}'), ('{"a": 1}', '{"a": 1}'), (None, None)])
def test_sanitize(spark, raw, want):
    assert one(spark, text.sanitize_json, raw) == want


@pytest.mark.parametrize(("raw", "opening", "want"), [("see [1, 2] end", "[", "[1, 2]"), ("none", "[", None), ("[[1], [2]] x", "[", "[[1], [2]]"), ('[{"a": "]"}]', "[", '[{"a": "]"}]'), ('x ["a\\"]"] y', "[", '["a\\"]"]'), ('{"a": "}"} z', "{", '{"a": "}"}'), ("a [1] {2}", "{[", "[1]"), ("[1", "[", None), (None, "[", None), ("", "[", None), ("😀 [é]", "[", "[é]")])
def test_balanced(raw, opening, want):
    assert jsonscan.balanced(raw, opening) == want


def test_score_by_object_then_pattern():
    assert jsonscan.final_score('x {"a": {"b": 1}, "weighted_final_score": 0.5} y') == 0.5
    assert jsonscan.final_score('{"weighted_final_score": 0.25, broken') == 0.25
    assert jsonscan.final_score('{"weighted_final_score": null}') is None
    assert jsonscan.final_score(None) is None and jsonscan.final_score("no score") is None


def test_cells(spark):
    assert json.loads(jsonscan.literal_findings("[{'entity': 'a', 'x': None, 'ok': True}]")) == [{"entity": "a", "x": None, "ok": True}]
    assert json.loads(jsonscan.literal_findings("([{'entity': 'a'}], 3.0)")) == [{"entity": "a"}]
    assert json.loads(jsonscan.literal_findings("{'entity': 'a'}")) == [{"entity": "a"}]
    assert [jsonscan.literal_findings(x) for x in ("", None, "junk(", "3")] == ["[]"] * 4


def test_sections_are_coerced():
    assert jsonscan.sections('ok {"findings": null, "history": 3, "more": 1,}') == {"history": "3", "technique": "", "comparison": "", "findings": "", "impression": "", "others": ""}
    assert jsonscan.sections("nothing") is None and jsonscan.sections(None) is None


def test_routing(spark):
    d = spark.createDataFrame([("databricks-x",), ("My-DataBricks",), ("",), (None,), ("llama",)], "v string")
    assert [r[0] for r in d.select(text.is_hosted(F.col("v"))).collect()] == [True, True, False, False, False]


def test_metrics(spark):
    d = spark.createDataFrame([("the cat sat", "the the cat"), ("a b", ""), (None, "x"), ("a b c d", "a b c d"), ("a b", "c d")], "r string, c string")
    bleu = [r[0] for r in d.select(metrics.bleu1(F.col("r"), F.col("c"))).collect()]
    assert bleu == pytest.approx([2 / 3, 0, 0, 1, 0])
    short = spark.createDataFrame([("a b c d", "a b")], "r string, c string").select(metrics.bleu1(F.col("r"), F.col("c"))).first()[0]
    assert short == pytest.approx(0.36787944)
    m = d.select(metrics.rouge_l("r", "c").alias("l"), metrics.meteor_exact("r", "c").alias("m")).collect()
    assert [r["l"] for r in m] == pytest.approx([2 * 2 / 6, 0, 0, 1, 0])
    assert m[3]["m"] == pytest.approx(1 - 0.5 / 64) and m[4]["m"] == 0
    assert metrics.greedy_f1(__import__("numpy").eye(2), __import__("numpy").eye(2)) == pytest.approx(1)


def test_lcs_against_table():
    import random

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.lcs_length(a, b) == t[-1][-1]
