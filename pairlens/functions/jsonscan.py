"""Balanced JSON inside free text: not a regular language, so Arrow functions.

Positions are code points, as Python counts them.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIR = {"{": "}", "[": "]"}
SECTION_KEYS = ("history", "technique", "comparison", "findings", "impression", "others")  # fixed values


def balanced(text: str | None, opening: str, aware: bool = True, at: int | None = None) -> str | None:
    """First balanced run from one of the ``opening`` brackets, counting that bracket only.

    ``aware``: brackets inside strings don't count. None if there is none or it never closes.
    """
    if text is None:
        return None
    if at is None:
        places = [p for c in opening if (p := text.find(c)) >= 0]
        if not places:
            return None
        at = min(places)
    first, last = text[at], _PAIR[text[at]]
    depth, quoted, i = 0, False, at
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"' and aware:
            quoted = True
        elif c == first:
            depth += 1
        elif c == last:
            depth -= 1
            if not depth:
                return text[at : i + 1]
        i += 1
    return None


#: Fixed value: the first key of a rating, by which its object is found.
FIRST_KEY = "entity_name false_prediction"


def enclosing_object(text: str | None, key: str = FIRST_KEY) -> str | None:
    """The object that begins at the last brace before the first mention of a key; braces inside strings count too."""
    if text is None or (k := text.find(f'"{key}"')) < 0 or (start := text.rfind("{", 0, k)) < 0:
        return None
    return balanced(text, "{", aware=False, at=start)


_SCORE = re.compile(r'"weighted_final_score"\s*:\s*([\d.]+)')


def final_score(text: str | None) -> float | None:
    """The rating's final score: from its object if that is JSON, or else by pattern; null if neither gives one."""
    body = enclosing_object(text)
    if body is not None:
        try:
            value = json.loads(body).get("weighted_final_score")
            if value is not None:
                return float(value)
        except (ValueError, TypeError, AttributeError, RecursionError):
            pass
    m = _SCORE.search(text or "")
    try:
        return float(m[1]) if m else None
    except ValueError:
        return None


def literal_findings(cell: str | None) -> str | None:
    """A cell of Python literals as JSON text; a (findings, score) tuple gives its findings. Null, empty and unreadable cells give ``[]``."""
    try:
        value = ast.literal_eval(cell or "[]")
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return "[]"
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], list):
        value = value[0]
    if isinstance(value, dict):
        value = [value]
    return json.dumps(value) if isinstance(value, list) else "[]"


def sections(text: str | None) -> dict[str, str] | None:
    """The first object of a text coerced to the six section keys: absent and null ones are empty, other keys go."""
    body = balanced(text, "{")
    if body is None:
        return None
    body = re.sub(r",\s*([}\]])", r"\1", body.translate(str.maketrans("“”’", "\"\"'")))
    try:
        got = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return {k: "" if got.get(k) is None else str(got[k]) for k in SECTION_KEYS}



def _text_udf(f):
    @F.pandas_udf(T.StringType())
    def udf(s: pd.Series) -> pd.Series:
        return s.map(f)

    return udf


first_array = _text_udf(lambda x: balanced(x, "["))
first_object = _text_udf(lambda x: balanced(x, "{"))
first_value = _text_udf(lambda x: balanced(x, "{["))
score_object = _text_udf(enclosing_object)
findings_json = _text_udf(literal_findings)


@F.pandas_udf(T.DoubleType())
def score_of(s: pd.Series) -> pd.Series:
    return s.map(final_score).astype("Float64")


@F.pandas_udf(T.StringType())
def sections_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if (v := sections(x)) is None else json.dumps(v, ensure_ascii=False))
