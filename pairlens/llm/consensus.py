"""One label per item from several raters who disagree.

Method: expectation-maximisation over a confusion matrix per rater and a
posterior over labels per item, with smoothed counts. Agreement beyond chance
is measured on the ratings alone. Items with the same ratings are one pattern, so the steps work
on distinct patterns with their numbers of items.

A round is one pass over the patterns: the confusion matrices, a number per
rater and pair of labels, go to all tasks, and expected counts of that size
come back. Nothing else is shuffled. Raters whose matrices are too many for
that are joined to their ratings instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

#: Rounds at most; they end when no label's expected number of items changes by more than this share of all items.
ROUNDS = 50
TOLERANCE = 1e-4
#: Pseudo-counts of a rater's confusion matrix: for the right label and for each other one.
SMOOTH_RIGHT, SMOOTH_OTHER = 2.0, 0.3
#: Numbers in all confusion matrices together that are sent to the tasks, at most.
MATRIX_CELLS = 2_000_000


def _each(k: int) -> list[str]:
    return [f"c{i}" for i in range(k)]


def rating_patterns(ratings: DataFrame, item: list[str], rater: str, label: str) -> DataFrame:
    """``pattern`` of every item: its raters, labels and how often each was given. ``ratings`` holds no redeliveries."""
    clean = ratings.dropna(subset=[*item, rater, label]).where(F.col(label) >= 0)
    given = clean.groupBy(*item, F.col(rater).alias("rater"), F.col(label).cast("int").alias("label")).agg(F.count("*").cast("double").alias("n"))
    return given.groupBy(*item).agg(F.array_sort(F.collect_list(F.struct("rater", "label", "n"))).alias("pattern"))


def log_matrices(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each given label at each true one, per rater, from expected counts ``[rater, given, true]``."""
    k = counts.shape[1]
    return np.log((counts + SMOOTH_OTHER + (SMOOTH_RIGHT - SMOOTH_OTHER) * np.eye(k)) / (counts.sum(1, keepdims=True) + SMOOTH_RIGHT + (k - 1) * SMOOTH_OTHER))


def posteriors(first: np.ndarray, rater: np.ndarray, label: np.ndarray, n: np.ndarray, k: int, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Per pattern the probability of each label; ``first`` has the bounds of each pattern's ratings.

    Without a model: the share of each label among the ratings.
    """
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    scores = np.zeros((len(size), k))
    if model is None:
        np.add.at(scores, (row, label), n)
        return scores / scores.sum(1, keepdims=True)
    prior, matrices = model
    np.add.at(scores, row, n[:, None] * matrices[rater, label])
    scores += prior
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def _flat(column: pa.ListArray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = column.offsets.to_numpy()
    rows = column.values.slice(first[0], first[-1] - first[0])
    rater, label, n = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return first - first[0], rater, np.searchsorted(given, label), n


def _round(patterns: DataFrame, raters: int, given: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected numbers of each label over all items, and of each rater's labels at each true one."""
    k = len(given)
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((raters * k, k)), np.zeros(k)
        for batch in batches:
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            first, rater, label, n = _flat(batch.column(0), given)
            p = posteriors(first, rater, label, n, k, shared.value) * weight[:, None]
            np.add.at(counts, rater * k + label, n[:, None] * np.repeat(p, np.diff(first), axis=0))
            total += p.sum(0)
        some = np.flatnonzero(counts.any(1))
        cells = np.concatenate([counts[some], total[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), *[pa.array(cells[:, i]) for i in range(k)]], names=["cell", *_each(k)])

    sums = patterns.select("pattern", "weight").mapInArrow(step, "cell long, " + ", ".join(f"{c} double" for c in _each(k))).groupBy("cell").agg(*[F.sum(c).alias(c) for c in _each(k)])
    counts, total = np.zeros((raters * k, k)), np.zeros(k)
    for row in sums.collect():  # a row for each rater and label
        if row[0] < 0:
            total = np.array(row[1:])
        else:
            counts[row[0]] = row[1:]
    shared.unpersist()
    return total, counts.reshape(raters, k, k)


def _with_posteriors(patterns: DataFrame, given: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``pattern_id, p0..`` of every pattern."""
    k = len(given)
    shared = patterns.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = posteriors(*_flat(batch.column(0), given), k, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(p[:, i]) for i in range(k)]], names=["pattern_id", *[f"p{i}" for i in range(k)]])

    return patterns.select("pattern", "pattern_id").mapInArrow(score, "pattern_id long, " + ", ".join(f"p{i} double" for i in range(k)))


def _by_joins(patterns: DataFrame, given: list[int], rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Posteriors ``pattern_id, p0..`` and expected counts ``rater, label, c0..`` where the matrices stay distributed."""
    k = len(given)
    place = (F.array_position(F.array(*[F.lit(x) for x in given]), F.col("m.label")) - 1).cast("int").alias("label")
    long = cut(patterns.select("pattern_id", "weight", F.explode("pattern").alias("m")).select("pattern_id", "weight", "m.rater", place, "m.n"))
    ps = [f"p{i}" for i in range(k)]
    share = [(F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0.0)) / F.sum("n")).alias(p) for i, p in enumerate(ps)]
    posterior = cut(long.groupBy("pattern_id", "weight").agg(*share))
    before = np.zeros(k)
    for _ in range(rounds):
        counts = long.join(posterior.drop("weight"), "pattern_id").groupBy("rater", "label").agg(*[F.sum(F.col("weight") * F.col("n") * F.col(p)).alias(f"c{i}") for i, p in enumerate(ps)])
        sums = counts.groupBy("rater").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(_each(k))])
        whole = SMOOTH_RIGHT + (k - 1) * SMOOTH_OTHER
        full = counts.join(sums, "rater")
        log = [F.log((F.col(f"c{i}") + F.when(F.col("label") == i, SMOOTH_RIGHT).otherwise(SMOOTH_OTHER)) / (F.col(f"s{i}") + whole)).alias(f"l{i}") for i in range(k)]
        total = np.array(posterior.agg(*[F.coalesce(F.sum(F.col("weight") * F.col(p)), F.lit(0.0)) for p in ps]).first())
        if np.abs(total - before).max() <= tolerance * total.sum():
            break
        before = total
        prior = np.log((total + 1) / (total.sum() + k))
        scores = long.join(full.select("rater", "label", *log), ["rater", "label"]).groupBy("pattern_id", "weight").agg(*[(F.sum(F.col("n") * F.col(f"l{i}")) + float(prior[i])).alias(f"z{i}") for i in range(k)])
        top = F.greatest(*[f"z{i}" for i in range(k)])
        exps = scores.withColumns({f"e{i}": F.exp(F.col(f"z{i}") - top) for i in range(k)})
        posterior = cut(exps.select("pattern_id", "weight", *[(F.col(f"e{i}") / reduce(Column.__add__, [F.col(f"e{j}") for j in range(k)])).alias(f"p{i}") for i in range(k)]))
    counts = long.join(posterior.drop("weight"), "pattern_id").groupBy("rater", "label").agg(*[F.sum(F.col("weight") * F.col("n") * F.col(p)).alias(f"c{i}") for i, p in enumerate(ps)])
    return posterior.drop("weight"), counts


def _by_broadcast(patterns: DataFrame, given: list[int], names: list, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The same with the matrices sent to the tasks; raters are numbers in the patterns."""
    spark, k = patterns.sparkSession, len(given)
    kind = dict(patterns.select(F.explode("pattern").alias("m")).select("m.rater").dtypes)["rater"]
    shared = spark.sparkContext.broadcast(names)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            first, rows = batch.column(0).offsets, batch.column(0).values
            known = pa.array(shared.value, rows.field(0).type) if known is None else known
            cells = pa.StructArray.from_arrays([pc.index_in(rows.field(0), known), rows.field(1), rows.field(2)], names=["rater", "label", "n"])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(first, cells), batch.column(1), batch.column(2)], names=["pattern", "weight", "pattern_id"])

    own = cut(spread(patterns.select("pattern", "weight", "pattern_id")).mapInArrow(code, "pattern array<struct<rater:int,label:int,n:double>>, weight double, pattern_id long"))
    labels = np.array(given)
    model, before = None, np.zeros(k)
    for _ in range(rounds):
        total, counts = _round(own, len(names), labels, model)
        if np.abs(total - before).max() <= tolerance * total.sum():
            break
        before = total
        model = np.log((total + 1) / (total.sum() + k)), log_matrices(counts)
    else:
        total, counts = _round(own, len(names), labels, model)
    rows = [(n, i, *map(float, counts[r, i])) for r, n in enumerate(names) for i in range(k) if counts[r, i].any()]
    expected = spark.createDataFrame(rows, f"rater {kind}, label int, " + ", ".join(f"{c} double" for c in _each(k)))
    return _with_posteriors(own, labels, model or (np.zeros(k), log_matrices(counts))), expected


def consensus(ratings: DataFrame, item: list[str], rater: str, label: str, rounds: int = ROUNDS, tolerance: float = TOLERANCE, matrix_cells: int = MATRIX_CELLS) -> tuple[DataFrame, DataFrame]:
    """Labels of items and reliability of raters.

    Returns ``item columns, label, p_label, p_any, n_ratings`` (the most
    probable label, its probability, the probability of any label above 0) and
    ``rater, n_ratings, accuracy, p_hit, p_false_alarm`` (how often a rater
    gives the true label; a label above 0 where the true one is; and where it is 0).
    Ratings with a null in item, rater or label, or a negative label, count
    nowhere. Of equally probable labels the smaller is taken. An item
    with a single rating is judged by the rater's reliability and the frequency of labels.
    The labels are 0, 1 and every other that was given; the work grows with their number squared.
    Rounds end when no label's expected number of items changes by more than ``tolerance`` of all items.
    """
    items = cut(rating_patterns(ratings, item, rater, label))
    patterns = cut(items.groupBy("pattern").agg(F.count("*").cast("double").alias("weight")).withColumn("pattern_id", F.monotonically_increasing_id()))  # written out, so the ids stay
    ratings_of = patterns.select(F.explode("pattern").alias("m"))
    given = sorted({0, 1} | {row[0] for row in ratings_of.select("m.label").distinct().collect()})
    k = len(given)
    some = ratings_of.select("m.rater").distinct().limit(matrix_cells // (k * k) + 1).collect()
    if len(some) * k * k <= matrix_cells:
        posterior, counts = _by_broadcast(patterns, given, sorted(r[0] for r in some), rounds, tolerance)
    else:
        posterior, counts = _by_joins(patterns, given, rounds, tolerance)
    best = F.greatest(*[F.col(f"p{i}") for i in range(k)])
    chosen = reduce(lambda rest, i: F.when(F.col(f"p{i}") == F.col("p_label"), given[i]).otherwise(rest), range(k - 1, -1, -1), F.lit(None).cast("int"))
    labels = patterns.select("pattern", "pattern_id").join(posterior, "pattern_id").withColumn("p_label", best).select("pattern", chosen.alias("label"), "p_label", (F.lit(1.0) - F.col("p0")).alias("p_any"))
    n_ratings = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + x["n"]).cast("long")
    per_item = items.withColumn("n_ratings", n_ratings).join(labels, "pattern").select(*item, "label", "p_label", "p_any", "n_ratings")
    both = reduce(Column.__add__, [F.col(c) for c in _each(k)])
    right = reduce(Column.__add__, [F.when(F.col("label") == i, F.col(f"c{i}")).otherwise(0.0) for i in range(k)])
    some_label = reduce(Column.__add__, [F.col(c) for c in _each(k)[1:]])
    raised = F.col("label") > 0
    raters = counts.groupBy("rater").agg(
        F.round(F.sum(both)).cast("long").alias("n_ratings"),
        (F.sum(right) / F.sum(both)).alias("accuracy"),
        F.try_divide(F.sum(F.when(raised, some_label).otherwise(0.0)), F.sum(some_label)).alias("p_hit"),
        F.try_divide(F.sum(F.when(raised, F.col("c0")).otherwise(0.0)), F.sum("c0")).alias("p_false_alarm"),
    )
    return per_item, raters


def agreement(ratings: DataFrame, item: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """Krippendorff's nominal alpha, over all or per ``by``: ``n_items, n_ratings, observed, expected, alpha``.

    Only items with two ratings or more can agree; others are left out. Alpha is null if only
    one label was ever given, as chance then explains everything.
    """
    by = by or []
    counted = ratings.dropna(subset=[*item, label]).groupBy(*item, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    per_item = counted.groupBy(*item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pairable = per_item.where("m > 1")
    observed = pairable.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum("m").alias("n_ratings"), (F.sum(F.col("same") / (F.col("m") - 1)) / F.sum("m")).alias("observed"))
    kept = counted.join(pairable.select(*item), item, "left_semi").groupBy(*by, "label").agg(F.sum("n").alias("n"))
    chance = kept.groupBy(*by).agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("expected"))
    both = observed.join(chance, by) if by else observed.withColumn("_", F.lit(1)).join(chance.withColumn("_", F.lit(1)), "_").drop("_")
    return both.withColumn("alpha", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))
