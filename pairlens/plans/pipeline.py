"""The evaluation of report pairs, each step one DataFrame over all pairs, and batches of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonscan, text
from ..functions.labels import DETAIL_LABELS, DIAGNOSIS_LABELS, PRESENCE, penalty
from ..operators import entities
from ..operators.findings import PAIR
from ..session import cut
from ..sources.files import append, resume
from . import prompts as P
from .model import ChatClient, stage

LABELS = ["diagnosis_concordance", "location_concordance", "severity_concordance", "temporal_comparison"]
FINDINGS = ["reference_report_finding", "candidate_report_finding"]
_EXTRACTED = ["entity", "presence", "sentence"]
_COMPARED = ["entity", *FINDINGS, *LABELS]
_RATED = {"entity": "string", "significance_score": "int", "rationale": "string"}


@dataclass(frozen=True)
class Prompts:
    """The instructions of all stages; from files by ``read``."""

    extraction: str = P.EXTRACTION
    comparison: str = P.COMPARISON
    significance: str = P.SIGNIFICANCE
    sections: Mapping[str, str] = field(default_factory=lambda: P.SECTIONS)

    @staticmethod
    def read(extraction: str | None = None, comparison: str | None = None, significance: str | None = None, sections: str | None = None) -> Prompts:
        own: dict = {}
        for name, path in (("extraction", extraction), ("significance", significance)):
            if path:
                own[name] = P.read_prompts(path, "prompt")["prompt"]
        if comparison:
            own["comparison"] = P.raw_prompt(comparison)
        if sections:
            own["sections"] = P.read_prompts(sections, *P.SECTIONS, only=False)
        return Prompts(**own)


def _schema(fields: Mapping[str, str]) -> str:
    return "array<struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">>"


def _listed(c: Column) -> Column:
    return F.array_join(c, ", ")


def _parsed(df: DataFrame, body: Column, fields: Mapping[str, str], rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """Adds ``answer``, an array of objects of exactly these fields, and ``problem``. One bad element fails the whole array.

    ``rules`` are conditions on ``_a``, the array, with what to say where they don't hold; null doesn't.
    """
    kinds = _schema(fields)
    loose = F.from_json("_body", "array<string>")
    exact = F.forall(loose, lambda x: F.array_sort(F.json_object_keys(x)) == F.array(*[F.lit(f) for f in sorted(fields)]))
    filled = F.forall("_a", lambda x: F.lit(True) if not fields else _all([x[f].isNotNull() for f in fields]))
    d = df.withColumn("_body", body).withColumn("_a", F.from_json("_body", kinds)).withColumn("_exact", F.coalesce(exact & filled, F.lit(False)))
    problem = F.when(F.col("_body").isNull(), "no JSON found").when(~F.col("_exact"), f"not a JSON array of objects with exactly the keys {', '.join(fields)}")
    for ok, said in rules:
        problem = problem.when(~F.coalesce(ok, F.lit(False)), said)
    d = d.withColumn("problem", F.when(F.col("raw").isNotNull(), problem).otherwise(F.lit("no answer")))
    return d.withColumn("answer", F.when(F.col("problem").isNull(), F.col("_a"))).drop("_a", "_exact", "_body")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _same_entities() -> list[tuple[Column, Column]]:
    """The answer must name the row's ``expected`` entities, no others and none less."""
    got = F.transform("_a", lambda x: x["entity"])
    extra, missing = F.array_except(got, "expected"), F.array_except("expected", got)
    return [(F.size(extra) == 0, F.concat(F.lit("entities not asked for: "), _listed(extra))), (F.size(missing) == 0, F.concat(F.lit("entities left out: "), _listed(missing)))]


def extract(pairs: DataFrame, taxonomy: DataFrame, client: ChatClient, prompts: Prompts | None = None, repair: bool = True) -> DataFrame:
    """Entities of both texts of all pairs in one stage: ``pair, side, status, error, pos, entity, presence, sentence``.

    Blank texts are not sent: their row has the status ``empty``. Unknown entities are dropped; of repeats the first
    stays. A text without entities, or whose answers stayed invalid, keeps one row without entity.
    """
    p = prompts or Prompts()
    both = F.explode(F.array(F.struct(F.lit("ref").alias("side"), F.col("reference_text").alias("report")), F.struct(F.lit("cand").alias("side"), F.col("candidate_text").alias("report"))))
    sides = pairs.select(*PAIR, both.alias("s")).select(*PAIR, "s.*").withColumn("_some", F.coalesce(F.length(text.strip(F.col("report"))) > 0, F.lit(False)))
    keys = [r[0] for r in taxonomy.orderBy("ord").select("entity_key").collect()]  # a reference list, sent whole with each prompt
    listed = F.lit("\n".join(f"- {k}" for k in keys))
    sent = sides.where("_some").select(*PAIR, "side", "report", P.extraction(p.extraction, listed, F.col("report")).alias("messages"))
    body = text.sanitize_json(F.coalesce(jsonscan.first_array("raw"), F.col("raw")))
    rules = [(F.forall("_a", lambda x: x["presence"].isin(*PRESENCE)), f"presence must be one of {', '.join(PRESENCE)}")]
    again = P.extraction_repair(listed, F.col("report"), F.col("problem"), F.col("raw")) if repair else None
    got = cut(stage(sent, client, lambda d: _parsed(d, body, dict.fromkeys(_EXTRACTED, "string"), rules), again))
    rows = got.select(*PAIR, "side", "status", "error", F.posexplode_outer("answer").alias("pos", "e")).select(*PAIR, "side", "status", "error", "pos", "e.*")
    known = rows.where(F.col("entity").isin(*keys)).groupBy(*PAIR, "side", "entity").agg(F.min_by(F.struct("status", "error", "pos", "presence", "sentence"), "pos").alias("v")).select(*PAIR, "side", "v.status", "v.error", "v.pos", "entity", "v.presence", "v.sentence")
    nothing = lambda df, status, error: df.select(*PAIR, "side", status.alias("status"), error.alias("error"), F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast("string").alias(c) for c in _EXTRACTED])
    none = nothing(got.join(known.select(*PAIR, "side").distinct(), [*PAIR, "side"], "left_anti"), F.col("status"), F.col("error"))
    blank = nothing(sides.where("not _some"), F.lit("empty"), F.lit("the text is empty"))
    return cut(known.unionByName(none).unionByName(blank))


def compare_shared(pairs: DataFrame, ref: DataFrame, cand: DataFrame, client: ChatClient, prompts: Prompts | None = None) -> DataFrame:
    """Labels of the entities of both sides, in the reference's order: ``pair, expected, answer, status, error, raw``. Pairs without such entities are not sent."""
    p = prompts or Prompts()
    shared = entities.overlap(ref, cand, "row")
    expected = shared.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("l")).select(*PAIR, F.transform("l", lambda x: x["entity"]).alias("expected"))
    sent = expected.join(pairs.select(*PAIR, "reference_text", "candidate_text"), PAIR)
    sent = sent.select(*PAIR, "expected", P.comparison(p.comparison, F.col("expected"), F.col("reference_text"), F.col("candidate_text")).alias("messages"))
    own = lambda c, labels: (F.forall("_a", lambda x: x[c].isin(*labels)), f"{c} must be one of {', '.join(labels)}")
    rules = [own(LABELS[0], DIAGNOSIS_LABELS), *[own(c, DETAIL_LABELS) for c in LABELS[1:]], *_same_entities()]
    again = P.comparison_repair(F.col("expected"), F.col("problem"), F.col("raw"), ", ".join(_COMPARED))
    valid = lambda d: _parsed(d, text.first_array_by_pattern(F.col("raw")), dict.fromkeys(_COMPARED, "string"), rules)
    return cut(stage(sent, client, valid, again, temperature=0.0, repair_temperature=0.1))


def normalised(raw: Column) -> Column:
    """The array of scored entities in an answer: the answer itself, or what its one key ``scored_entities`` holds."""
    body = text.sanitize_json(F.coalesce(jsonscan.first_value(raw), raw))
    only = F.json_object_keys(body) == F.array(F.lit("scored_entities"))
    return F.when(F.ltrim(body).startswith("["), body).when(only, F.get_json_object(body, "$.scored_entities"))


def rate(pairs: DataFrame, merged: DataFrame, client: ChatClient, prompts: Prompts | None = None) -> DataFrame:
    """Significance of all merged rows: ``pair, expected, answer, status, error, raw``. Pairs without rows are not sent."""
    p = prompts or Prompts()
    fields = ["entity", *FINDINGS, *LABELS, "discrepancy_type"]
    rows = F.array_sort(F.collect_list(F.struct("section", "order", *fields)))
    sent = merged.groupBy(*PAIR).agg(rows.alias("rows")).withColumn("expected", F.transform("rows", lambda x: x["entity"])).join(pairs.select(*PAIR, "reference_text"), PAIR)
    sent = sent.select(*PAIR, "expected", P.significance(p.significance, F.coalesce("reference_text", F.lit("")), F.col("rows"), fields).alias("messages"))
    rules = [(F.forall("_a", lambda x: x["significance_score"].between(0, 4)), "significance_score must be 0 to 4"), *_same_entities()]
    again = P.significance_repair(F.col("expected"), F.col("problem"), F.col("raw"), ", ".join(_RATED))
    return cut(stage(sent, client, lambda d: _parsed(d, normalised(F.col("raw")), _RATED, rules), again))


def first_of_each(answers: DataFrame, *fields: str) -> DataFrame:
    """Elements of ``answer`` as rows ``pair, entity, fields, order``; of an entity given twice the first."""
    rows = answers.select(*PAIR, F.posexplode("answer").alias("order", "e"))
    first = rows.groupBy(*PAIR, F.col("e.entity").alias("entity")).agg(F.min_by(F.struct("order", "e"), "order").alias("v"))
    return first.select(*PAIR, "entity", *[F.col(f"v.e.{f}").alias(f) for f in fields], "v.order")


def evaluate_pairs(pairs: DataFrame, taxonomy: DataFrame, client: ChatClient, prompts: Prompts | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and scores: ``pair, entity, labels, score`` rows and ``pair, pair_score, n_findings, status, error``.

    ``pairs`` has one row per pair. Pairs without shared entities are not sent
    for comparison, those without findings not for rating; they score 0. A pair any of whose answers
    stayed invalid after its repair has the status failed and a score of what is left; one with an
    empty text has the status empty.
    """
    found = extract(pairs, taxonomy, client, prompts)
    real = found.where("entity is not null").withColumn("row", F.col("pos"))
    ref, cand = entities.side(real, "ref"), entities.side(real, "cand")
    compared = compare_shared(pairs, ref, cand, client, prompts)
    rows = first_of_each(compared, *FINDINGS, *LABELS).withColumn("discrepancy_type", F.lit(None).cast("string")).withColumn("section", F.lit(0))
    shared = entities.overlap(ref, cand, "row")
    columns = rows.columns
    lone = lambda here, there, kind, n: entities.one_sided(here, there, shared, kind, "row").withColumn("section", F.lit(n)).withColumn("order", F.lit(0)).select(*columns)
    merged = cut(rows.unionByName(lone(ref, cand, "missing_in_candidate", 1)).unionByName(lone(cand, ref, "extra_in_candidate", 2)))
    rated = rate(pairs, merged, client, prompts)
    final = merged.join(first_of_each(rated, "significance_score", "rationale").drop("order"), [*PAIR, "entity"], "left").drop("section", "order")
    total = final.groupBy(*PAIR).agg(F.sum(penalty()).alias("pair_score"), F.count("*").alias("n_findings"))
    states = found.select(*PAIR, "status", "error").unionByName(compared.select(*PAIR, "status", "error")).unionByName(rated.select(*PAIR, "status", "error"))
    rank = F.when(F.col("status") == "failed", 3).when(F.col("status") == "empty", 2).when(F.col("status") == "repaired", 1).otherwise(0)
    worst = states.groupBy(*PAIR).agg(F.max_by(F.struct("status", "error"), F.struct(rank, F.coalesce("error", F.lit("")))).alias("w"))
    done = pairs.select(*PAIR).join(total, PAIR, "left").join(worst, PAIR, "left").fillna(0, ["n_findings"]).fillna(0.0, ["pair_score"])
    return final, done.select(*PAIR, "pair_score", "n_findings", F.coalesce("w.status", F.lit("ok")).alias("status"), F.when(F.col("w.status").isin("failed", "empty"), F.col("w.error")).alias("error"))


def parse_sections(reports: DataFrame, keys: list[str], report: str, client: ChatClient, prompts: Prompts | None = None, max_tokens: int = 1024) -> DataFrame:
    """Free reports split into six sections: ``keys, history .. others, status, error``.

    Blank and null reports are not sent and have the status ``empty``; those whose repair fails too have null sections and the status ``failed``.
    """
    p = (prompts or Prompts()).sections
    rows = reports.select(*keys, F.col(report).alias("_report")).withColumn("_some", F.coalesce(F.length(text.strip(F.col("_report"))) > 0, F.lit(False)))
    sent = rows.where("_some").select(*keys, "_report", P.sections(p["system_prompt"], p["user_template"], F.col("_report")).alias("messages"))
    valid = lambda d: d.withColumn("answer", jsonscan.sections_json("raw")).withColumn("problem", F.when(F.col("answer").isNull(), "no JSON object"))
    again = P.sections_repair(p["system_prompt"], p["repair_instructions"], F.col("_report"), F.col("raw"))
    got = stage(sent, client, valid, again, max_tokens, 0.0)
    kinds = ", ".join(f"{k} string" for k in jsonscan.SECTION_KEYS)
    out = got.select(*keys, F.from_json("answer", kinds).alias("s"), "status", "error").select(*keys, "s.*", "status", "error")
    blank = rows.where("not _some").select(*keys, *[F.lit(None).cast("string").alias(k) for k in jsonscan.SECTION_KEYS], F.lit("empty").alias("status"), F.lit("the text is empty").alias("error"))
    return out.unionByName(blank)


def run_batches(pairs: DataFrame, taxonomy: DataFrame, models: Mapping[str, Callable[[], ChatClient]], sink: str, slices: int = 16, prompts: Prompts | None = None) -> dict[str, str]:
    """Evaluates all pairs with each model, and goes on where an earlier run stopped: status by model.

    Results go to ``sink/model``, one file group per slice of the pairs (by a hash of their key), with the findings as a nested
    column; a slice that was written isn't asked again, and failed pairs are. A model that fails as a whole leaves the others alone.
    """
    out: dict[str, str] = {}
    for name, client in models.items():
        folder = f"{sink}/{name.replace('-', '_').replace('/', '_')}"
        try:
            chat = client()
            todo = cut(resume(pairs, folder, PAIR))
            for n in range(slices):
                own = todo.where(F.pmod(F.xxhash64(*PAIR), F.lit(slices)) == n)
                if own.isEmpty():
                    continue
                findings, scores = evaluate_pairs(own, taxonomy, chat, prompts)
                nested = findings.groupBy(*PAIR).agg(F.collect_list(F.struct("entity", *FINDINGS, *LABELS, "discrepancy_type", "significance_score", "rationale")).alias("findings"))
                append(scores.join(nested, PAIR, "left").withColumn("model", F.lit(name)), folder)
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001 - the other models go on
            out[name] = f"{type(e).__name__}: {e}"[:500]
    return out
