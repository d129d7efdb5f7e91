"""External chat models as a stage of a plan: prompt, call, check, repair once.

A model is slow and answers differently each time, so every stage's answers are
written out before anything reads them; a lost task calls again only for its own rows.
"""

from __future__ import annotations

import gc
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import prompts as P


class ChatClient(Protocol):
    """One chat model. It is sent to the workers by pickling and used there by up to ``threads`` threads."""

    threads: int

    def complete(self, messages: list[dict], max_tokens: int, temperature: float) -> str: ...


@lru_cache(maxsize=8)
def read_secret(path: str) -> str:
    """The text of a file without white space around it; an empty one raises."""
    with open(path, encoding="utf-8") as f:
        key = f.read().strip()
    if not key:
        raise RuntimeError(f"empty secret: {path}")
    return key


class HttpClient:
    """A hosted endpoint that takes ``messages`` as JSON; null content becomes an empty answer.

    The key is read on the worker from a file or the environment, never from a column. Answers that
    say "later" (429 and 5xx) and broken connections are tried again after growing pauses.
    """

    def __init__(self, url: str, model: str, key_file: str | None = None, key_variable: str = "CHAT_API_KEY", timeout: float = 120.0, threads: int = 8, tries: int = 4, pause: float = 1.0):
        self.url, self.model, self.key_file, self.key_variable, self.timeout = url, model, key_file, key_variable, timeout
        self.threads, self.tries, self.pause = threads, tries, pause

    def key(self) -> str:
        key = read_secret(self.key_file) if self.key_file else os.environ.get(self.key_variable, "").strip()
        if not key:
            raise RuntimeError("no key for the chat endpoint")
        return key

    def complete(self, messages: list[dict], max_tokens: int = 2000, temperature: float = 0.1) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key()}"})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    content = json.load(r)["choices"][0]["message"]["content"]
                break
            except urllib.error.HTTPError as e:
                if n + 1 == self.tries or e.code != 429 and e.code < 500:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n + 1 == self.tries:
                    raise
            time.sleep(self.pause * 2**n)
        if isinstance(content, list):
            content = "".join(p.get("text", "") for p in content if isinstance(p, dict))
        return (content or "").strip()


_LOADED: dict[str, object] = {}


class LocalClient:
    """A text-generation model loaded in the worker, once per model.

    ``load`` takes the model's name and gives a function of messages, token limit and
    temperature; by default a pipeline of the transformers library, if that is installed.
    """

    threads = 1

    def __init__(self, model: str, load: Callable[[str], Callable[[list[dict], int, float], str]] | None = None):
        self.model, self.load = model, load or load_pipeline

    def complete(self, messages: list[dict], max_tokens: int = 2000, temperature: float = 0.1) -> str:
        if self.model not in _LOADED:
            if len(_LOADED) >= 4:
                unload()
            _LOADED[self.model] = self.load(self.model)
        return _LOADED[self.model](messages, max_tokens, temperature).strip()


def load_pipeline(model: str) -> Callable[[list[dict], int, float], str]:
    try:
        from transformers import pipeline
    except ImportError as e:
        raise RuntimeError("a local model needs the transformers library") from e
    run = pipeline("text-generation", model=model, device_map="auto", torch_dtype="auto")

    def generate(messages: list[dict], max_tokens: int, temperature: float) -> str:
        options = {"do_sample": True, "temperature": temperature} if temperature > 0 else {"do_sample": False}
        return run(messages, max_new_tokens=max_tokens, return_full_text=False, **options)[0]["generated_text"]

    return generate


def unload() -> None:
    """Frees the models loaded in this worker."""
    _LOADED.clear()
    gc.collect()


def client_for(model: str | None, url: str | None = None, hosted: Callable[[str], bool] | None = None, **options: object) -> ChatClient:
    """The client of a model by its name: hosted models at ``url``, others in the worker."""
    name = model or "rule-based"
    if name == "rule-based":
        return RuleBasedClient()
    is_hosted = hosted or (lambda m: "databricks" in m.lower())
    return HttpClient(url or os.environ.get("CHAT_API_URL", ""), name, **options) if is_hosted(name) else LocalClient(name)


class RuleBasedClient:
    """An offline client for tests and trials: it reads the prompts of all stages and answers by the words of the reports."""

    threads = 1

    def complete(self, messages: list[dict], max_tokens: int = 2000, temperature: float = 0.0) -> str:
        system, user = messages[0]["content"], messages[-1]["content"]
        if user.startswith(P.EXTRACT_FROM):
            return "Answer: " + json.dumps(self._extract(re.findall(r"^- (.* :: .*)$", system, re.M), user.removeprefix(P.EXTRACT_FROM)))
        if user.startswith(P.COMPARE_THESE):
            listed = json.JSONDecoder().raw_decode(system, system.rindex("\n[") + 1)[0]
            a, b = user.removeprefix(P.COMPARE_THESE + P.REFERENCE).split("\n\n" + P.CANDIDATE, 1)
            return json.dumps([self._compare(e, a, b) for e in listed])
        if P.ENTITIES_JSON in user:
            rows = json.loads(user.rpartition(P.ENTITIES_JSON)[2])
            return json.dumps({"scored_entities": [self._rate(r) for r in rows]})
        if P.JUDGE_CANDIDATE in user:
            b, a = user.rpartition(P.JUDGE_CANDIDATE)[2].split("\n\n" + P.JUDGE_REFERENCE, 1)
            return "Result: " + json.dumps(self._judge(a, b))
        if "REPORT:\n" in user:
            return json.dumps(self._sections(user.partition("REPORT:\n")[2].rpartition("\n\n")[0]))
        return "no answer"

    @staticmethod
    def _sentence(key: str, report: str) -> str | None:
        words = {w for w in re.findall(r"[a-z]+", key.split("::")[-1].lower()) if len(w) > 3}
        return next((s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", report)) if words & set(re.findall(r"[a-z]+", s.lower()))), None)

    def _extract(self, keys: list[str], report: str) -> list[dict]:
        found = [(k, s) for k in keys if (s := self._sentence(k, report))]
        return [{"entity": k, "presence": "NEGATIVE" if re.search(r"\b(no|without|not)\b", s.lower()) else "POSITIVE", "sentence": s} for k, s in found]

    def _compare(self, key: str, reference: str, candidate: str) -> dict:
        a, b = self._sentence(key, reference) or "", self._sentence(key, candidate) or ""
        same = set(a.lower().split()) == set(b.lower().split())
        negative = [bool(re.search(r"\b(no|without|not)\b", x.lower())) for x in (a, b)]
        sides = [set(re.findall(r"left|right|bilateral|upper|lower|middle", x.lower())) for x in (a, b)]
        place = "concordant" if sides[0] == sides[1] else "candidate-misses" if not sides[1] else "candidate-adds" if not sides[0] else "discordant"
        labels = ("concordant" if same else "partial" if negative[0] == negative[1] else "discordant", place, "concordant" if same else "not mentioned", "not mentioned")
        return {"entity": key, "reference_report_finding": a, "candidate_report_finding": b} | dict(zip(("diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison"), labels))

    @staticmethod
    def _rate(row: dict) -> dict:
        kind, diagnosis = row.get("discrepancy_type"), row["diagnosis_concordance"]
        return {"entity": row["entity"], "significance_score": 3 if kind == "missing_in_candidate" else 2 if kind or diagnosis != "concordant" else 0, "rationale": kind or diagnosis}

    @staticmethod
    def _judge(reference: str, candidate: str) -> dict:
        a, b = set(reference.lower().split()), set(candidate.lower().split())
        share = len(a & b) / len(a | b) if a | b else 0.0
        out: dict = {}
        for part in ("entity_name", "location", "severity", "uncertainty"):
            for kind, n in (("false_prediction", len(b - a)), ("omission", len(a - b))):
                out |= {f"{part} {kind}": n, f"{part} {kind}_explanation": ""}
        return out | {f"{x}_{k}": v for x in ("completeness", "readability", "clinical_utility") for k, v in (("score", share), ("reason", ""))} | {"weighted_final_score": share}

    @staticmethod
    def _sections(report: str) -> dict:
        out, key = dict.fromkeys(("history", "technique", "comparison", "findings", "impression", "others"), ""), "others"
        for line in report.splitlines():
            head, colon, rest = line.partition(":")
            if colon and head.strip().lower() in out:
                key, line = head.strip().lower(), rest
            out[key] = f"{out[key]}\n{line.strip()}".strip()
        return out


def ask(prompts: DataFrame, client: ChatClient, max_tokens: int = 5000, temperature: float = 0.1) -> DataFrame:
    """Adds ``raw`` and ``error`` to rows with ``messages``, written out. A call that fails gives a null answer and its error."""
    kept = [c for c in prompts.columns if c not in ("raw", "error")]
    schema = prompts.select(*kept).schema.add("raw", "string").add("error", "string")

    def one(m: list[dict]) -> tuple[str | None, str | None]:
        try:
            return client.complete(m, max_tokens, temperature), None
        except Exception as e:  # noqa: BLE001 - any failure of one call stays with its row
            return None, f"{type(e).__name__}: {e}"[:500]

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(max(1, client.threads)) as pool:
            for batch in batches:
                rows = batch.column(kept.index("messages")).to_pylist()
                got = list(pool.map(one, rows)) if client.threads > 1 else [one(m) for m in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[i] for g in got], pa.string()) for i in (0, 1)]], names=[*kept, "raw", "error"])

    return cut(prompts.select(*kept).mapInArrow(call, schema))


def stage(prompts: DataFrame, client: ChatClient, valid: Callable[[DataFrame], DataFrame], repair: Column | None, max_tokens: int = 5000, temperature: float = 0.1, repair_temperature: float | None = None) -> DataFrame:
    """Asks, checks and asks once more for what failed: the rows of ``prompts`` with ``answer, status, error, raw``.

    ``valid`` adds ``answer`` (null where ``raw`` breaks the rules) and ``problem`` (what is wrong). ``repair`` makes the
    messages of the second call from these and the row's own columns; null: no second call. Status is ok, repaired or
    failed; nothing is raised.
    """
    columns = [c for c in prompts.columns if c != "messages"]
    out = [*columns, "answer", "status", "error", "raw"]
    first = cut(valid(ask(prompts, client, max_tokens, temperature)))
    problem = F.coalesce("error", "problem")
    if repair is None:
        return first.select(*columns, "answer", F.when(F.col("answer").isNotNull(), "ok").otherwise("failed").alias("status"), problem.alias("error"), "raw")
    good = first.where("answer is not null").withColumn("status", F.lit("ok"))
    again = first.where("answer is null").withColumn("problem", problem).select(*columns, repair.alias("messages"))
    second = valid(ask(again, client, max_tokens, temperature if repair_temperature is None else repair_temperature))
    repaired = second.withColumn("status", F.when(F.col("answer").isNotNull(), "repaired").otherwise("failed")).withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", "problem")))
    return good.select(*out).unionByName(repaired.select(*out))
