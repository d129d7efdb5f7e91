"""Prompts: where they come from, and how they are filled in for all rows of a table at once.

A prompt is a column of messages, ``array<struct<role,content>>``.
"""

from __future__ import annotations

import textwrap
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# Own wording of the instructions; every stage takes others, as texts or from files.
EXTRACTION = """Find which of the listed entities the report speaks of.

Answer with a JSON array and nothing else. Each element has exactly the keys "entity" (as listed),
"presence" (POSITIVE, NEGATIVE or UNCERTAIN) and "sentence" (the words of the report). Leave out entities
that the report doesn't mention; give each entity once. If there are none, answer [].

Entities:
{entity_list}
"""
COMPARISON = """Both reports mention each of the entities below. Say how far the candidate report agrees with the reference.

Answer with a JSON array and nothing else: one object per entity, with exactly the keys "entity",
"reference_report_finding", "candidate_report_finding", "diagnosis_concordance" (concordant, partial, discordant),
"location_concordance", "severity_concordance" and "temporal_comparison" (these: concordant, partial, discordant,
not mentioned, candidate-adds, candidate-misses).

Entities:
{ entity_list_json }
"""
SIGNIFICANCE = """Rate how much each difference between a reference report and a candidate report matters to the patient.

Answer with a JSON object and nothing else: {"scored_entities": [{"entity": ..., "significance_score": 0 to 4, "rationale": ...}]}.
Each entity comes once. 0: no difference or none that matters; 4: critical, it changes what is done at once.
"""
SECTIONS = {
    "system_prompt": 'Split a report into its sections. Answer with one JSON object of the keys history, technique, comparison, findings, impression and others; every value is text of the report, or "".',
    "user_template": "Sections of this report, please.\n\nREPORT:\n{report_text}\n\nJSON only:",
    "repair_instructions": "The answer was no JSON object with exactly the keys history, technique, comparison, findings, impression and others, all of them texts. Answer again.",
}
JUDGE = """Compare the candidate report with the reference report. Answer with one JSON object of these keys and nothing else: for each of
entity_name, location, severity and uncertainty the numbers "... false_prediction" and "... omission", each with "..._explanation";
for completeness, readability and clinical_utility "..._score" from 0 to 1 and "..._reason"; and "weighted_final_score" from 0 to 1.
"""
# What stands before a report in a prompt, by stage.
EXTRACT_FROM = "Extract entities for the following report:\n\n"
COMPARE_THESE = "Evaluate the following reports.\n\n"
REFERENCE, CANDIDATE, ENTITIES_JSON = "Ground Truth Report:\n", "Candidate Report:\n", "Entities JSON:\n"
JUDGE_CANDIDATE, JUDGE_REFERENCE = "Candidate radiology report:\n", "Reference radiology report:\n"


def read_prompts(path: str, *keys: str, only: bool = True) -> dict[str, str]:
    """Texts of a YAML file of ``key: |`` blocks (or ``key: text``) under the given keys.

    A missing key or a value that is no text raises; so does another key, if ``only``.
    """
    found: dict[str, str | None] = {}
    key = None
    block: list[str] = []

    def close() -> None:
        if key is not None and found[key] is None:
            body = textwrap.dedent("\n".join(block)).strip("\n")
            found[key] = body + "\n" if body else ""

    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line[:1].isspace() or not line.strip() or key is not None and line.startswith("#") and found[key] is None:
            block.append(line)
            continue
        if line.startswith("#"):
            continue
        close()
        name, colon, rest = line.partition(":")
        if not colon:
            raise ValueError(f"{path}, line {n}: no key")
        key, block, rest = name.strip().strip("\"'"), [], rest.strip()
        if key in found:
            raise ValueError(f"{path}, line {n}: {key} given twice")
        found[key] = None if rest in ("|", "|-", "|+", ">", "") else rest.strip("\"'")
    close()
    missing = [k for k in keys if not found.get(k)]
    extra = [k for k in found if k not in keys]
    if missing or only and extra:
        raise ValueError(f"{path}: missing {missing}, unknown {extra if only else []}")
    return {k: found[k] or "" for k in keys}


def raw_prompt(path: str) -> str:
    """A file as it is, not read as YAML."""
    return Path(path).read_text(encoding="utf-8")


def filled(template: str, name: str, value: Column) -> Column:
    """A template with ``{name}`` replaced; doubled braces outside it stand for single ones."""
    parts = [p.replace("{{", "{").replace("}}", "}") for p in template.split("{" + name + "}")]
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [F.coalesce(value, F.lit("")), F.lit(p)]
    return F.concat(*out)


def messages(system: Column, user: Column) -> Column:
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(part("system", system), part("user", user))


def as_json(c: Column) -> Column:
    """A text or number as JSON; null as null."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _lines(parts: Column, indent: str, brackets: str) -> Column:
    whole = F.concat(F.lit(brackets[0] + "\n" + indent + "  "), F.array_join(parts, f",\n{indent}  "), F.lit("\n" + indent + brackets[1]))
    return F.when(F.size(parts) == 0, F.lit(brackets)).otherwise(whole)


def json_list(c: Column) -> Column:
    """An array of texts as JSON, one text per line."""
    return _lines(F.transform(c, as_json), "", "[]")


def json_objects(c: Column, fields: list[str]) -> Column:
    """An array of structs as JSON, one field per line; null fields of the name ``discrepancy_type`` are left out."""

    def one(x: Column) -> Column:
        shown = [F.when(x[f].isNotNull() | F.lit(f != "discrepancy_type"), F.concat(F.lit(f'"{f}": '), as_json(x[f]))) for f in fields]
        return _lines(F.filter(F.array(*shown), lambda s: s.isNotNull()), "  ", "{}")

    return _lines(F.transform(c, one), "", "[]")


def extraction(template: str, entity_list: Column, report: Column) -> Column:
    return messages(filled(template, "entity_list", entity_list), F.concat(F.lit(EXTRACT_FROM), report))


def comparison(template: str, entities: Column, reference: Column, candidate: Column) -> Column:
    """The list goes where the template has ``{ entity_list_json }``, with its spaces; other braces stay."""
    system = F.replace(F.lit(template), F.lit("{ entity_list_json }"), json_list(entities))
    return messages(system, F.concat(F.lit(COMPARE_THESE + REFERENCE), strip(reference), F.lit("\n\n" + CANDIDATE), strip(candidate)))


def significance(template: str, reference: Column, findings: Column, fields: list[str]) -> Column:
    return messages(F.lit(template), F.concat(F.lit(REFERENCE), reference, F.lit("\n\n" + ENTITIES_JSON), json_objects(findings, fields)))


def sections(system: str, user_template: str, report: Column) -> Column:
    return messages(F.lit(system), filled(user_template, "report_text", strip(report)))


def judge(reference: Column, candidate: Column, template: str = JUDGE) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(template + "\n" + JUDGE_CANDIDATE), candidate, F.lit("\n\n" + JUDGE_REFERENCE), reference, F.lit("\n")).alias("content")))


def _again(rules: str, *parts: tuple[str, Column]) -> Column:
    """A message that asks once more, with what was wrong and what was answered."""
    shown = [x for title, value in parts for x in (F.lit(f"\n\n{title}:\n"), F.coalesce(value, F.lit("")))]
    return messages(F.lit("You answer with valid JSON only."), F.concat(F.lit(rules), *shown))


def extraction_repair(entity_list: Column, report: Column, problem: Column, raw: Column) -> Column:
    rules = 'The answer broke the rules. Answer with a JSON array of {"entity", "presence", "sentence"} objects only; take entities from the list, as they are written there, and leave out those not mentioned.'
    return _again(rules, ("Allowed entities", entity_list), ("Report", strip(report)), ("Validation error", problem), ("Bad output", strip(raw)))


def comparison_repair(entities: Column, problem: Column, raw: Column, schema: str) -> Column:
    rules = "The answer broke the rules. Answer with a JSON array that has exactly the entities of the list, once each and in its order."
    return _again(rules, ("Entity list", json_list(entities)), ("Schema of each element", F.lit(schema)), ("Validation error", problem), ("Original output", raw))


def significance_repair(entities: Column, problem: Column, raw: Column, schema: str) -> Column:
    rules = 'The answer broke the rules. Answer with a JSON object of the key "scored_entities", or its array, that has exactly the required entities, once each.'
    return _again(rules, ("Required entities", json_list(entities)), ("Schema of each element", F.lit(schema)), ("Validation error", problem), ("Original output", raw))


def sections_repair(system: str, instructions: str, report: Column, raw: Column) -> Column:
    return messages(F.lit(system), F.concat(F.lit(instructions + "\n\nREPORT:\n"), strip(report), F.lit("\n\nBAD_OUTPUT:\n"), strip(F.coalesce(raw, F.lit(""))), F.lit("\n\nReturn ONLY valid JSON:")))
