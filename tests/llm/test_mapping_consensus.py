import random

import pytest

from pairlens.llm import consensus, mapping

ENTRIES = [(1, "Pleura", "Free Pleural Fluid"), (2, "Chest Wall", "Breast Absence"), (3, "Lung Density", "Lung Mass"), (4, "Lung Density", "Lung Nodule"), (5, "Lung Diseases", "Tubercular Disease")]


@pytest.fixture(scope="module")
def forms(spark):
    e = spark.createDataFrame(ENTRIES, "ord int, category string, entity string")
    return mapping.reference_forms(spark, e, "ord", "category", "entity")


CASES = {
    "free pleural fluid": 1, "Fluid, Free Pleural": 1, "FREE_PLEURAL_FLUID!": 1, "1) Frée Pleural Fluid": 1, "Free Pleural Fliud": 1, "poss. free pleural fluids": 1, "Pleura - Free Pleural Fluid": 1, "Pleuraerguß": 1,
    "Fre​e pleural fluid (Pleura)": 1, "mastectmy": 2, "Breast Absence likely": 2, "lung mass": 3, "Mass, Lung": 3, "coin lesion": 4, "TB": 5, "TBD": 0, "coffee break": 0, "": 0, "???": 0, "lung": 0, "appendix wart": 0, "Other :: tooth mass": 0, "x" * 3000: 0,
}


def test_values(spark, forms):
    rows = [(i, v, 9) for i, v in enumerate([*CASES, None])] + [(100 + i, "mastectmy", 9) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, entity string, ord int")
    got = {r["id"]: r["ord"] for r in mapping.map_rows(d, "entity", forms).collect()}
    assert {v: got[i] for i, v in enumerate(CASES)} == CASES
    assert len(CASES) not in got and all(got[100 + i] == 2 for i in range(200))
    assert mapping.map_rows(d.limit(0), "entity", forms).collect() == []
    assert all(r["ord"] == 0 for r in mapping.map_rows(d, "entity", forms.limit(0)).collect())


def test_join_loses_no_similar_pair(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(30)]
    refs = [(i, " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(40)]
    values = []
    for _, f in refs:
        k = rng.randrange(len(f))
        values.append(f[:k] + rng.choice("xyz") + f[k + 1 :] if f[k] != " " else f)
    want = {}
    for v in set(values):
        pv = " ".join(mapping.plain_words(v))
        best = []
        for o, f in refs:
            pf = " ".join(mapping.plain_words(f))
            a, b = set(mapping.letter_runs(pv.split())), set(mapping.letter_runs(pf.split()))
            d = mapping.spelling_distance(pv, pf)
            if len(a & b) >= mapping.least_overlap(max(len(a), len(b)), len(pv.replace(" ", ""))) and d < 9:
                best.append((-len(a & b) / len(a | b), d, o))
        if best:
            want[v] = min(best)[2]
    got = mapping.map_values(spark.createDataFrame([(v,) for v in set(values)], "value string"), spark.createDataFrame(refs, "ord int, form string"))
    assert {r["value"]: r["ord"] for r in got.collect()} == want


def test_edits():
    assert [mapping.edits(a, b, 2) for a, b in (("ab", "ba"), ("abc", "abc"), ("abc", "abcd"), ("abc", "xyz"), ("", "a"))] == [1, 0, 1, 3, 1]


def simulated(spark, n=400, seed=1):
    rng = random.Random(seed)
    care = {0: 0.95, 1: 0.92, 2: 0.9, 3: None, 4: "random"}
    rows, truth = [], {}
    for i in range(n):
        truth[i] = rng.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]
        for r, c in care.items():
            if rng.random() < 0.2:
                continue
            label = 0 if c is None else rng.randrange(3) if c == "random" else truth[i] if rng.random() < c else rng.randrange(3)
            rows.append((i, r, label))
    return spark.createDataFrame(rows, "item int, rater int, label int"), truth


def test_consensus_finds_truth_and_care(spark):
    d, truth = simulated(spark)
    items, raters = consensus.consensus(d, ["item"], "rater", "label", rounds=12)
    got = {r["item"]: r["label"] for r in items.collect()}
    assert sum(got[i] == truth[i] for i in got) / len(got) > 0.95
    r = {x["rater"]: x for x in raters.collect()}
    assert r[0]["accuracy"] > 0.88 and r[3]["p_hit"] < 0.05 and r[4]["accuracy"] < 0.5
    assert sum(x["n_ratings"] for x in r.values()) == d.count()


def test_consensus_is_the_same_by_joins(spark):
    d, _ = simulated(spark)
    own = [consensus.consensus(d, ["item"], "rater", "label", rounds=6, matrix_cells=cells) for cells in (consensus.MATRIX_CELLS, 0)]
    for a, b in zip(*[[sorted(x.collect()) for x in pair] for pair in own]):
        assert len(a) == len(b) > 0
        assert all(x == pytest.approx(y, abs=1e-6) for x, y in zip(a, b))


def test_consensus_of_raters_with_names(spark):
    rows = [(i, r, i % 2) for i in range(12) for r in "abc"] + [(i, "d", 1) for i in range(12)]
    items, raters = consensus.consensus(spark.createDataFrame(rows, "item int, rater string, label int"), ["item"], "rater", "label")
    assert {r["item"]: r["label"] for r in items.collect()} == {i: i % 2 for i in range(12)}
    assert {r["rater"] for r in raters.collect()} == set("abcd")


def test_consensus_of_odd_tables(spark):
    rows = [(1, 0, 2), (1, 0, 2), (2, 0, None), (None, 0, 1), (3, None, 1), (4, 1, 99), (5, 1, -1)]
    d = spark.createDataFrame(rows, "item int, rater int, label int")
    items, raters = consensus.consensus(d, ["item"], "rater", "label", rounds=2)
    assert {r["item"] for r in items.collect()} == {1, 4} and {r["rater"] for r in raters.collect()} == {0, 1}
    items, raters = consensus.consensus(d.limit(0), ["item"], "rater", "label", rounds=1)
    assert items.collect() == [] and raters.collect() == []


def test_consensus_keeps_large_labels_apart(spark):
    rows = [(i, r, 5 if i % 2 else 9) for i in range(20) for r in range(3)] + [(i, 3, 9 if i % 2 else 5) for i in range(20)]
    items, raters = consensus.consensus(spark.createDataFrame(rows, "item int, rater int, label int"), ["item"], "rater", "label", rounds=5)
    assert {r["item"]: r["label"] for r in items.collect()} == {i: 5 if i % 2 else 9 for i in range(20)}
    accuracy = {r["rater"]: r["accuracy"] for r in raters.collect()}
    assert accuracy[0] > 0.9 and accuracy[3] < 0.1


def test_agreement(spark):
    rows = [(1, 0), (1, 0), (2, 1), (2, 1), (3, 0), (3, 1), (4, 5)]
    a = consensus.agreement(spark.createDataFrame(rows, "item int, label int"), ["item"], "label").first()
    # Three pairable items, two of them agree; chance: (3 * 2 + 3 * 2) / (6 * 5).
    assert (a["n_items"], a["n_ratings"]) == (3, 6) and a["observed"] == pytest.approx(2 / 3) and a["expected"] == pytest.approx(0.4)
    assert a["alpha"] == pytest.approx((2 / 3 - 0.4) / 0.6)
    one = consensus.agreement(spark.createDataFrame([(1, 0), (1, 0)], "item int, label int"), ["item"], "label").first()
    assert one["alpha"] is None
