"""Column functions for texts: white space, JSON repair by pattern, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split takes it: separators, controls and U+0085.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda x: x != "")


def squish(c: Column) -> Column:
    """Inner runs of white space become one space, outer ones go."""
    return F.array_join(words(c), " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}\z", "")


def sanitize_json(c: Column) -> Column:
    """Straight quotes for curly ones, and no commas before closing brackets; inside strings too."""
    straight = F.translate(strip(c), "“”’", "\"\"'")
    return F.regexp_replace(straight, r",\s*([}\]])", "$1")


def first_array_by_pattern(c: Column) -> Column:
    """Shortest ``[{...}]`` by pattern, which knows nothing of strings; null if there is none."""
    found = F.regexp_extract(c, r"(?s)(\[\s*\{.*?\}\s*\])", 1)
    return F.when(found != "", found)


def pattern_score(c: Column) -> Column:
    """The number after ``"weighted_final_score":``, or null."""
    return F.regexp_extract(c, r'"weighted_final_score"\s*:\s*([\d.]+)', 1).try_cast("double")


def file_safe(c: Column) -> Column:
    return F.translate(c, "-/", "__")


def is_hosted(c: Column) -> Column:
    """Whether a model's name routes to the hosted endpoint; null and empty names don't."""
    # Fixed value: the word by which hosted models are told.
    return F.coalesce(F.lower(c).contains("databricks"), F.lit(False))


def model_name(path: Column, prefix: str, suffix: str = "_processed.csv") -> Column:
    """Model in a file's name, between a prefix and a suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), rf"{suffix.replace('.', '[.]')}$", "")


def entity_lines(keys: Column) -> Column:
    """Allowed keys as a list for a prompt, one line per key."""
    return F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- "), k)), "\n")
