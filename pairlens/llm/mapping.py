"""Freely entered values led back to the entries of a reference list.

Method: a prefix-filter set-similarity join. Values and reference forms become
sets of three-letter runs; the sets are ordered by the rarity of their members
over all values; only members of the rare prefixes are joined, lengths and
positions filter the pairs, Jaccard similarity is verified exactly and the
most similar form is kept. How similar two must be depends on the value's
length: an edit takes four runs at most, and a short value may have few edits. So
the prefixes are short, and made of runs that are rare. A check of the edits themselves tells
misspelt forms from other words of like letters.
"""

from __future__ import annotations

import csv
import os
import re
import unicodedata
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Members that one edit takes from a set, at most.
PER_EDIT = 4
HEAVY_SHARE = 0.005
#: Names that mean an entry, by the entry's own name: a parameter, a tab-separated file.
ALIASES = os.environ.get("PAIRLENS_ALIASES", str(Path(__file__).with_name("aliases.tsv")))
# Words beside a value that say nothing about what it names.
REMARKS = frozenset("known poss possible possibly probable probably likely noted y yes entity finding query suspected see also the a an of in".split())
_FOLD = {ord(a): b for a, b in {"ß": "ss", "æ": "ae", "ø": "o", "œ": "oe", "ł": "l", "đ": "d"}.items()}
_NUMBERING = re.compile(r"^\s*(?:\(?\d{1,3}[.):]\s*)+")
_WORDS = re.compile(r"[^\W_]+")


def plain_words(value: str) -> list[str]:
    """Lower-case words of a value without accents, list numbers, punctuation and remarks; ``#`` is short for fracture."""
    v = _NUMBERING.sub("", unicodedata.normalize("NFKD", value).casefold().translate(_FOLD))
    v = "".join(c for c in v if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").replace("#", " fracture ")
    words = _WORDS.findall(v)
    return [w for w in words if w not in REMARKS] or words


def letter_runs(words: Sequence[str]) -> list[str]:
    """The set of three-letter runs of some words, with marks for their ends; the order of words plays no part."""
    return sorted({p[i : i + 3] for w in words for p in [f"^^{w}$"] for i in range(len(p) - 2)})


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two strings, or ``most + 1`` beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most and (not row or min(row) > most):
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def _allowed(letters: int) -> int:
    return 0 if letters < 5 else 1 if letters < 12 else 2 if letters < 24 else 3


def spelling_distance(value: str, form: str) -> int:
    """Edits that turn the words of a value into those of a form in any order, or 9 if those are too many."""
    a, b = value.split(), form.split()
    joined = "".join(a)
    most = min(_allowed(len(joined)), _allowed(sum(map(len, b))))
    best = edits(joined, "".join(b), most)
    if best > most and len(a) == len(b):
        left, total = list(b), 0
        for w in sorted(a, key=len, reverse=True):
            near = min(left, key=lambda x: edits(w, x, 2))
            d = edits(w, near, 2)
            total += d if d <= max(1, _allowed(len(w))) else 9
            left.remove(near)
        best = total
    if best > most and len(a) > 1:  # words in another order, one of them divided or joined
        best = min(best, edits("".join(sorted(a)), "".join(sorted(b)), most))
    return best if best <= most else 9


def read_aliases(path: str = ALIASES) -> list[tuple[str, str]]:
    with open(path, encoding="utf-8") as f:
        return [(r["entity"], a) for r in csv.DictReader(f, delimiter="\t") for a in r["aliases"].split("|")]


def reference_forms(spark: SparkSession, entries: DataFrame, ord_: str, category: str, entity: str, aliases: str | None = ALIASES) -> DataFrame:
    """All forms of the entries, ``ord, form``: name, name with category, and aliases with and without."""
    e = entries.select(F.col(ord_).alias("ord"), F.col(category).alias("category"), F.col(entity).alias("entity"))
    names = e.select("ord", "category", F.col("entity").alias("form"))
    if aliases:
        known = spark.createDataFrame(read_aliases(aliases), "entity string, form string")
        names = names.unionByName(e.join(known, "entity").select("ord", "category", "form"))
    return names.select("ord", "form").unionByName(names.select("ord", F.concat_ws(" ", "category", "form").alias("form"))).dropna().distinct()


@F.pandas_udf(T.StringType())
def _plain(values: pd.Series) -> pd.Series:
    return values.map(lambda v: " ".join(plain_words(v)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _runs(values: pd.Series) -> pd.Series:
    return values.map(lambda v: letter_runs(v.split()))


@F.pandas_udf(T.IntegerType())
def _distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, forms in batches:
        yield pd.Series([spelling_distance(a, b) for a, b in zip(values, forms)], dtype="int32")


def least_overlap(n: int, letters: int) -> int:
    """Members that the larger of two sets, of ``n`` members, must share for a value of so many letters."""
    return n - PER_EDIT * _allowed(letters)


def _lost(letters: Column) -> Column:
    """Members that the edits allowed to a value of so many letters take, at most."""
    return F.when(letters < 5, 0).when(letters < 12, PER_EDIT).when(letters < 24, 2 * PER_EDIT).otherwise(3 * PER_EDIT)


def _prefixes(df: DataFrame, rank: DataFrame) -> DataFrame:
    """The rare prefix of each set: ``id, lost, size, at, run``. Sets that differ by no more than ``lost`` members share a member of these."""
    long = df.select("id", "lost", F.size("runs").alias("size"), F.explode("runs").alias("run")).join(rank, "run")
    ordered = long.groupBy("id", "lost", "size").agg(F.sort_array(F.collect_list(F.struct("freq", "run"))).alias("members"))
    return ordered.select("id", "lost", "size", F.posexplode(F.slice("members", F.lit(1), F.col("lost") + 1)).alias("at", "m")).select("id", "lost", "size", "at", "m.run")


def candidate_pairs(v: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs ``v, f`` of sets ``id, lost, runs`` that pass the prefix, length and position filters."""
    rank = v.select(F.explode("runs").alias("run")).unionByName(r.select(F.explode("runs").alias("run"))).groupBy("run").agg(F.count("*").alias("freq"))
    a = _prefixes(v, rank).select(F.col("id").alias("v"), "lost", F.col("size").alias("vs"), F.col("at").alias("va"), "run")
    b = _prefixes(r, rank).select(F.col("id").alias("f"), F.col("size").alias("fs"), F.col("at").alias("fa"), "run")
    need = F.greatest("vs", "fs") - F.col("lost")
    lengths = F.least("vs", "fs") >= need
    positions = F.least(F.col("vs") - F.col("va"), F.col("fs") - F.col("fa")) >= need - F.least(F.col("va"), F.col("fa"))
    return a.join(b, "run").where(lengths & positions).select("v", "f").distinct()


def map_values(values: DataFrame, forms: DataFrame) -> DataFrame:
    """Best entry of each distinct value: ``value, ord, form, similarity, edits``; values that fit none are left out.

    ``values`` has ``value`` (distinct), ``forms`` has ``ord`` and ``form``. Of
    several entries the most similar is kept, then the one with fewer edits, then the
    first by ``ord``. Nulls, and values without letters or digits, fit none.
    """
    letters = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    plain = values.where(F.col("value").isNotNull()).select("value", _plain("value").alias("plain"))
    v = plain.where("plain <> ''").select("plain").distinct().select(F.col("plain").alias("id"), _lost(letters(F.col("plain"))).alias("lost"), _runs("plain").alias("runs"))
    # A form's value may have three letters more, and so more edits.
    r = forms.select("ord", _plain("form").alias("form")).where("form <> ''").groupBy("form").agg(F.min("ord").alias("ord")).select(F.col("form").alias("id"), "ord", _lost(letters(F.col("form")) + 3).alias("lost"), _runs("form").alias("runs"))
    v, r, plain = cut(v), cut(r), cut(plain)
    met = candidate_pairs(v, r)
    both = met.join(r.select(F.col("id").alias("f"), "ord", F.col("runs").alias("fp")), "f").join(v.select(F.col("id").alias("v"), "lost", F.col("runs").alias("vp")), "v")
    shared = F.size(F.array_intersect("vp", "fp"))
    exact = both.where(F.greatest(F.size("vp"), F.size("fp")) - shared <= F.col("lost"))
    exact = exact.select("v", "f", "ord", (shared / (F.size("vp") + F.size("fp") - shared)).alias("similarity"))
    exact = cut(exact)  # else the spelling check would run before the filters
    near = exact.withColumn("edits", _distance("v", "f")).where("edits < 9")
    best = near.groupBy("v").agg(F.min_by(F.struct("ord", F.col("f").alias("form"), "similarity", "edits"), F.struct(-F.col("similarity"), "edits", "ord")).alias("b"))
    return plain.join(best, F.col("plain") == F.col("v")).select("value", "b.*")


def map_rows(rows: DataFrame, column: str, forms: DataFrame) -> DataFrame:
    """Adds ``ord`` to rows whose ``column`` is not null: the entry meant, or 0 if none fits.

    Values are reduced to distinct ones before the similarity join. Values
    held by more than a two-hundredth of the rows, at most two hundred, are
    joined back by broadcast, so no task gets all rows of one value.
    """
    rows = rows.where(F.col(column).isNotNull())
    counted = cut(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    mapped = map_values(counted.select("value"), forms).select("value", "ord")
    mapped = cut(counted.join(mapped, "value", "left").select(F.col("value").alias("_value"), F.coalesce("ord", F.lit(0)).alias("ord"), (F.col("n") > max(1.0, HEAVY_SHARE * total)).alias("_heavy")))
    heavy = mapped.where("_heavy").drop("_heavy")
    light = mapped.where("not _heavy").drop("_heavy")
    first = rows.drop("ord").join(F.broadcast(heavy), F.col(column) == F.col("_value"), "left")
    done = first.where(F.col("_value").isNotNull()).drop("_value")
    rest = first.where(F.col("_value").isNull()).drop("_value", "ord").join(light, F.col(column) == F.col("_value")).drop("_value")
    return done.unionByName(rest)
