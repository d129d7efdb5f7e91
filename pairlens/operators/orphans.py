"""References to rows that are missing, deleted or not there yet.

Method: targets become disjoint live intervals per key; references are reduced
to one row per key and period, the few heavy keys are checked against a broadcast of their intervals,
all other keys by a shuffled anti-join, and both results are united.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import at_most, cut

_END = "9999-12-31 00:00:00"


def merge_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins overlapping or touching ``[start, end)`` rows of the same keys."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    flagged = df.withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = flagged.withColumn("_island", F.sum(F.when(F.col("start") <= F.col("_before"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def live_intervals(targets: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint live intervals ``(keys, start, end)`` of each key.

    Rows with a null key or start, or with an end not after their start, are
    never live. Equal starts are reduced before any sort, and months are merged
    before whole keys, so that a key holding many rows is cut into small groups.
    """
    t = targets.select(*keys, F.col(start).alias("start"), F.coalesce(F.col(end), F.lit(_END).cast(targets.schema[start].dataType)).alias("end"))
    t = t.where("start < end").dropna(subset=list(keys)).groupBy(*keys, "start").agg(F.max("end").alias("end"))
    by_month = merge_intervals(t.withColumn("_month", F.trunc("start", "month")), [*keys, "_month"]).drop("_month")
    return merge_intervals(by_month, keys)


def _doubtful(counted: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of references, with times from ``_from`` to ``_to``, that no one live interval holds wholly: ``keys, _period``."""
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_t_{k}") for k in keys])
    held = same & (F.col("_t_start") <= F.col("_from")) & (F.col("_t_end") > F.col("_to"))
    return counted.join(live, held, "left_anti").select(*keys, "_period")


def _salted_anti(refs: DataFrame, live: DataFrame, keys: Sequence[str], at: str, salts: int) -> DataFrame:
    """Anti-join by time where a few keys have very many rows on both sides: references have salts, over which they are spread, and intervals are repeated for each."""
    t = live.withColumn("_t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_t_{k}") for k in keys])
    covers = same & (F.col("_salt") == F.col("_t_salt")) & (F.col(at) >= F.col("_t_start")) & (F.col(at) < F.col("_t_end"))
    return refs.join(t, covers, "left_anti")


def find_orphans(refs: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, start: str, end: str, period: str = "month", heavy_share: float = 0.005, broadcast_rows: int = 200_000, salts: int = 64) -> DataFrame:
    """The rows of ``refs`` whose key has no live target at their time.

    ``keys`` have the same names on both sides and are compared byte for byte.
    The last key is the reference itself: rows where it is null refer to
    nothing and are left out; a null in another key or a null time matches no
    target, so such a row is an orphan. Equal rows stay equal rows; other
    columns pass through, and may have the names of target columns.

    References are reduced to one row per key and ``period`` first, with their number and span of time. Most
    such groups lie within one live interval; only rows of the others are compared one by one.

    ``heavy_share``: keys with more than this share of the references are
    heavy, at most ``1 / heavy_share`` keys. What is known of them is broadcast if it is
    at most ``broadcast_rows`` rows, and otherwise repeated over ``salts``, over which their references are spread.
    """
    refs = refs.where(F.col(keys[-1]).isNotNull())
    live = live_intervals(targets, keys, start, end).select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("start").alias("_t_start"), F.col("end").alias("_t_end"))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in (*keys, at)])
    lone = refs.where(~whole)
    refs = refs.where(whole).withColumn("_period", F.trunc(at, period))
    counted = cut(refs.groupBy(*keys, "_period").agg(F.count("*").alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    per_key = counted.groupBy(*keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") > max(1.0, heavy_share * total))
    heavy = cut(per_key.select(*keys).withColumn("_heavy", F.lit(True)))
    group = [*keys, "_period"]
    if heavy.isEmpty():
        doubtful = _doubtful(counted, live, keys)
        return _anti(refs.join(doubtful, group, "left_semi").drop("_period"), live, keys, at).unionByName(lone)
    few = F.broadcast(heavy)  # at most 1 / heavy_share rows
    heavy_live = cut(live.join(few.select(*[F.col(k).alias(f"_t_{k}") for k in keys]), [f"_t_{k}" for k in keys], "left_semi"))
    split = lambda df, how: df.join(few, list(keys), how)
    rest = _anti(split(refs, "left_anti").join(_doubtful(split(counted, "left_anti"), live, keys), group, "left_semi"), live, keys, at)
    heavy_doubtful = cut(_doubtful(split(counted, "left_semi"), heavy_live, keys))
    own = split(refs, "left_semi")
    if at_most(heavy_live, broadcast_rows) and at_most(heavy_doubtful, broadcast_rows):
        own = _anti(own.join(F.broadcast(heavy_doubtful), group, "left_semi"), F.broadcast(heavy_live), keys, at)
    else:
        repeated = heavy_doubtful.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = own.withColumn("_salt", F.pmod(F.xxhash64(*refs.columns), F.lit(salts)).cast("int")).join(repeated, [*group, "_salt"], "left_semi")
        own = _salted_anti(own, heavy_live, keys, at, salts)
    return rest.select(*lone.columns).unionByName(own.select(*lone.columns)).unionByName(lone)


def _anti(refs: DataFrame, live: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_t_{k}") for k in keys])
    return refs.join(live, same & (F.col(at) >= F.col("_t_start")) & (F.col(at) < F.col("_t_end")), "left_anti")


def orphan_report(refs: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, start: str, end: str, period: str = "month") -> DataFrame:
    """Orphans per period and reason: ``period, n_missing, n_deleted, n_later, n_orphans``.

    Missing: the key is in no target row. Later: its first target starts after
    the reference. Deleted: all else. A null time gives a null period and, as
    no target can be live then, counts as missing.
    """
    # Equal keys and times, and so equal periods, share their fate: they are counted before the split into heavy keys and the rest.
    counted = refs.select(*keys, at).groupBy(*keys, at).agg(F.count("*").alias("n"))
    found = find_orphans(counted, targets, keys, at, start, end, period)
    first = targets.groupBy(*keys).agg(F.min(start).alias("_first"), F.count("*").alias("_rows"))
    joined = found.join(first, list(keys), "left")
    kind = F.when(F.col("_rows").isNull() | F.col(at).isNull(), "missing").when(F.col("_first") > F.col(at), "later").otherwise("deleted")
    n = lambda k: F.sum(F.when(kind == k, F.col("n")).otherwise(0)).alias(f"n_{k}")
    return joined.groupBy(F.trunc(at, period).alias("period")).agg(n("missing"), n("deleted"), n("later"), F.sum("n").alias("n_orphans"))
