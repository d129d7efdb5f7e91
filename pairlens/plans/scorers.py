"""Scorers from outside: functions of two texts that a library, another program or a model computes."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonscan, text
from ..session import cut
from ..sources.files import require
from . import prompts as P
from .model import ChatClient, ask

RAW_CHARS, ERROR_CHARS = 2000, 500


class Scorer(Protocol):
    """Scores of many pairs of texts; it is sent to the workers by pickling."""

    def score(self, references: Sequence[str], candidates: Sequence[str]) -> list[float | None]: ...


class WordOverlap:
    """An offline scorer: the share of words, of those in either text, that are in both."""

    def score(self, references: Sequence[str], candidates: Sequence[str]) -> list[float | None]:
        bags = [(set(a.split()), set(b.split())) for a, b in zip(references, candidates)]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in bags]


class ProgramScorer:
    """A program, such as one in an environment of its own: it reads JSON lines ``{"reference", "candidate"}`` and writes one number or null per line.

    A program that ends with another code than 0, or with too few lines, fails the batch.
    """

    def __init__(self, command: Sequence[str], timeout: float = 3600.0):
        self.command, self.timeout = list(command), timeout

    def score(self, references: Sequence[str], candidates: Sequence[str]) -> list[float | None]:
        lines = "".join(json.dumps({"reference": a, "candidate": b}) + "\n" for a, b in zip(references, candidates))
        done = subprocess.run(self.command, input=lines, capture_output=True, text=True, timeout=self.timeout)
        if done.returncode:
            raise RuntimeError(f"the scorer ended with {done.returncode}: {done.stderr[-ERROR_CHARS:]}")
        out = [json.loads(x) for x in done.stdout.splitlines() if x.strip()]
        if len(out) != len(references):
            raise RuntimeError(f"the scorer gave {len(out)} scores for {len(references)} pairs")
        return [None if x is None else float(x) for x in out]


def external_scores(pairs: DataFrame, scorer: Scorer, reference: str, candidate: str, name: str, cache: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the column ``name``. Null texts count as empty. Pairs that ``cache`` has a score of, by ``keys``, aren't scored again."""
    require(pairs, reference, candidate, *keys)
    base = pairs.drop(name)
    if cache is not None:
        known = cache.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.first(name).alias(name))
        return base.join(known, list(keys)).unionByName(external_scores(base.join(known, list(keys), "left_anti"), scorer, reference, candidate, name))
    columns = base.columns
    i, j = columns.index(reference), columns.index(candidate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[x or "" for x in batch.column(k).to_pylist()] for k in (i, j)]
            got = scorer.score(*sides) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None or x != x else float(x) for x in got], pa.float64())], names=[*columns, name])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.DoubleType())]))


def judge_scores(pairs: DataFrame, client: ChatClient, reference: str, candidate: str, name: str = "judge", cache: DataFrame | None = None, keys: Sequence[str] = (), max_tokens: int = 256) -> DataFrame:
    """Adds ``name``, a model's score of each pair, and ``eval_result``, its answer (the first 2,000 characters) or what went wrong as JSON.

    A pair with a blank side isn't sent. A pair whose score ``cache`` has, by ``keys``, keeps that with its answer; failed ones are asked again.
    """
    require(pairs, reference, candidate, *keys)
    base = pairs.drop(name, "eval_result")
    if cache is not None:
        best = cache.where(F.col(name).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(name, "eval_result"), F.struct(name, "eval_result")).alias("v"))
        known = best.select(*keys, F.col(f"v.{name}").alias(name), "v.eval_result")
        return base.join(known, list(keys)).unionByName(judge_scores(base.join(known, list(keys), "left_anti"), client, reference, candidate, name, max_tokens=max_tokens))
    some = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    ready = base.withColumn("_a", some(reference)).withColumn("_b", some(candidate)).withColumn("_full", (F.length("_a") > 0) & (F.length("_b") > 0))
    sent = ready.where("_full").withColumn("messages", P.judge(F.col("_a"), F.col("_b")))
    got = cut(ask(sent, client, max_tokens, 0.0)).withColumn(name, jsonscan.score_of("raw"))
    failed = F.to_json(F.struct(F.coalesce("error", F.lit("weighted_final_score not found")).alias("error"), F.substring(F.coalesce("raw", F.lit("N/A")), 1, ERROR_CHARS).alias("raw_output")))
    result = F.when(F.col(name).isNotNull(), F.substring("raw", 1, RAW_CHARS)).otherwise(failed)
    blank = ready.where("not _full").withColumn(name, F.lit(None).cast("double")).withColumn("eval_result", F.lit('{"error":"empty input"}'))
    columns = [*base.columns, name, "eval_result"]
    return got.withColumn("eval_result", result).select(*columns).unionByName(blank.select(*columns))
