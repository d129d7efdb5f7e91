"""Text metrics of a candidate against a reference."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, words


def bleu1(reference: Column, candidate: Column) -> Column:
    """Clipped unigram precision times the brevity penalty, over white-space words.

    All in the JVM. Null texts count as empty; an empty candidate or no common word gives 0.
    """
    r, c = words(F.coalesce(reference, F.lit(""))), words(F.coalesce(candidate, F.lit("")))
    common = _common(r, c)
    n, m = F.size(c), F.size(r)
    brevity = F.when(n > m, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - F.try_divide(m.cast("double"), n.cast("double"))))
    return F.when((n > 0) & (common > 0), brevity * common / n).otherwise(F.lit(0.0))


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags of words: after one sort both sides' runs of a word stand side by side."""
    tagged = lambda x, side: F.transform(x, lambda w: F.struct(w.alias("w"), F.lit(side).alias("s")))

    def of_sorted(z: Column) -> Column:
        n = F.size(z)
        cuts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(z, i) != F.get(z, i - 1)))

        def of_cuts(k: Column) -> Column:
            def step(total: Column, i: Column) -> Column:
                begin, middle, end = F.get(k, i), F.get(k, i + 1), F.get(k, i + 2)
                same = F.get(z, begin)["w"] == F.get(z, middle)["w"]
                return total + F.when(same, F.least(middle - begin, end - middle)).otherwise(0)

            return F.when(F.size(k) < 3, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(k) - 3, F.lit(0))), F.lit(0), step))

        return let(cuts, of_cuts)

    return let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), of_sorted)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | masks.get(w, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def _rouge_l(reference: str | None, candidate: str | None) -> float:
    a, b = (reference or "").split(), (candidate or "").split()
    common = lcs_length(a, b)
    return 2.0 * common / (len(a) + len(b)) if common else 0.0


def _meteor(reference: str | None, candidate: str | None) -> float:
    """Exact-match stage: harmonic mean with recall weighted nine to one, less the penalty for chunks."""
    a, b = (reference or "").lower().split(), (candidate or "").lower().split()
    places: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    left = Counter(a) & Counter(b)
    common = sum(left.values())
    if not common:
        return 0.0
    matched, used, last = [], set(), -2
    first = dict.fromkeys(places, 0)  # of each word's places, those before are used
    for w in b:
        if left[w] > 0:
            i = last + 1
            if not (i < len(a) and a[i] == w and i not in used):
                while places[w][first[w]] in used:
                    first[w] += 1
                i = places[w][first[w]]
            used.add(i)
            left[w] -= 1
            matched.append(i)
            last = i
        else:
            last = -2
            matched.append(None)
    chunks = sum(i is not None and (k == 0 or matched[k - 1] is None or matched[k - 1] + 1 != i) for k, i in enumerate(matched))
    p, r = common / len(b), common / len(a)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / common) ** 3)


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([_rouge_l(a, b) for a, b in zip(reference, candidate)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def meteor_exact(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([_meteor(a, b) for a, b in zip(reference, candidate)], dtype="float64")


def greedy_f1(a: np.ndarray, b: np.ndarray) -> float:
    """Each vector matched to the most similar one of the other side: F of the two means. Empty sides give 0."""
    if not len(a) or not len(b):
        return 0.0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = unit(a) @ unit(b).T
    r, p = s.max(axis=1).mean(), s.max(axis=0).mean()
    return float(2 * p * r / (p + r)) if p + r else 0.0


@F.pandas_udf(T.DoubleType())
def greedy_cosine_f1(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """Of two arrays of vectors, such as the token embeddings of a pluggable model."""
    side = lambda x: np.array([list(v) for v in x], float) if x is not None and len(x) else np.zeros((0, 1))
    return pd.Series([greedy_f1(side(a), side(b)) for a, b in zip(reference, candidate)], dtype="float64")


# Metrics by column, in the order of reports; those without a plug-in are null.
DISPLAY = {"bleu1": "BLEU-1", "rougeL": "ROUGE-L", "meteor": "METEOR", "bertscore": "BertScore", "bluert": "BLUERT", "radgraphf1": "RadGraphF1", "ratescore": "RaTEScore"}


def all_metrics(reference: str, candidate: str, plugins: dict | None = None) -> dict[str, Column]:
    """Columns of all metrics; ``plugins`` maps a metric's column to a function of two columns, others stay null."""
    own = {"bleu1": bleu1, "rougeL": rouge_l, "meteor": meteor_exact} | (plugins or {})
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in (reference, candidate))
    return {m: own[m](a, b) if m in own else F.lit(None).cast("double") for m in DISPLAY}
