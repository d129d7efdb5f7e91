"""Rows that fail to parse: delimited records and JSON objects inside text.

Records are read permissively under an explicit schema which keeps the corrupt
raw text; rows that this reading can't vouch for are read again by the strict
rules and get a reason by quoting, column count and casts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let

CORRUPT = "_corrupt_record"


def _segments(line: Column) -> Column:
    return F.split(line, '"', -1)


def record_syntax_ok(line: Column) -> Column:
    """Whether quotes open and close fields only at their ends.

    Cut at every quote, parts 1, 3, ... lie inside quotes; part 2, 4, ... is
    empty for a doubled quote, or else lies between two fields.
    """
    s = _segments(line)
    n = F.size(s)

    def outside_ok(x: Column, i: Column) -> Column:
        inner = (i > 0) & (i < n - 1) & (x == "")
        left = (i == 0) | (x == "") & (i == n - 1) | x.startswith(",")
        right = (i == n - 1) | (x == "") & (i == 0) | x.endswith(",")
        return (i % 2 == 1) | inner | (left & right)

    flags = F.transform(s, outside_ok)
    return (n % 2 == 1) & F.forall(flags, lambda x: x)


def outside_quotes(line: Column) -> Column:
    """What stands outside quotes in a record whose quotes are in order."""
    return F.array_join(F.filter(_segments(line), lambda x, i: i % 2 == 0), "")


def record_fields(line: Column) -> Column:
    """The fields of a record whose quotes are in order, unquoted."""
    s = _segments(line)
    n = F.size(s)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        i, t = x["i"], x["t"]
        parts = F.split(t, ",", -1)
        doubled = (i % 2 == 0) & (i > 0) & (i < n - 1) & (t == "")
        more = F.size(parts) > 1
        outside = F.struct(
            F.when(more, F.concat(acc["done"], F.array(F.concat(acc["open"], parts[0])), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(acc["done"]).alias("done"),
            F.when(more, F.element_at(parts, -1)).otherwise(F.concat(acc["open"], t)).alias("open"),
        )
        inside = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.when(doubled, '"').otherwise(t)).alias("open"))
        return F.when((i % 2 == 1) | doubled, inside).otherwise(outside)

    numbered = F.transform(s, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.aggregate(numbered, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def read_records(df: DataFrame, line: str, schema: T.StructType, checks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds ``record`` (typed struct) and ``reason`` (null, syntax, fields or value).

    ``checks`` maps a column to a test of its text (fields are texts, empty
    rather than null, at that point). A row with a reason has a null record and
    keeps its raw text in ``_corrupt_record``. A null line is no record at all: it gets
    the reason ``fields``, as an empty line has (it is one empty field). Other
    columns pass through; equal rows stay.
    """
    width = len(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(CORRUPT, T.StringType())])
    # Within quotes, line ends stay as they are only with ``multiLine``.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "multiLine": "true", "maxColumns": str(max(512, 4 * width)), "emptyValue": "", "inputBufferSize": "4096"}  # the reader's own buffer takes two megabytes a record
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts)
    raw = F.col(line)

    def of_fields(fields: Column, syntax: Column, wide: Column) -> Column:
        # A value that its column can't hold would be lost: it is no good one.
        record = F.struct(*[F.get(fields, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
        checked = [checks[f.name](F.get(fields, F.lit(i))) for i, f in enumerate(schema) if f.name in checks]

        def done(r: Column) -> Column:
            good = reduce(Column.__and__, [*checked, *[r[f.name].isNotNull() for f in schema]])
            reason = F.when(raw.isNull(), "fields").when(~syntax, "syntax").when(~wide, "fields").when(~F.coalesce(good, F.lit(False)), "value")
            return F.struct(reason.alias("reason"), F.when(reason.isNull(), r).alias("record"))

        return let(record, done)

    def of_outside(syntax: Column, outside: Column) -> Column:
        wide = F.coalesce(F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1 == width, F.lit(False))
        # The permissive reader takes a line break outside quotes for the record's end.
        loose = F.when(wide & ~outside.rlike("[\\r\\n]"), F.from_csv(raw, ddl, options))

        def of_loose(x: Column) -> Column:
            own = F.array(*[F.coalesce(x[f.name], F.lit("")) for f in schema])
            fields = F.when(x.isNotNull() & x[CORRUPT].isNull(), own).when(wide, record_fields(raw))
            return let(fields, lambda f: of_fields(f, syntax, wide))

        return let(loose, of_loose)

    def of_line() -> Column:
        quoted = raw.contains('"')
        syntax = raw.isNotNull() & (~quoted | record_syntax_ok(raw))
        seen = F.struct(syntax.alias("ok"), F.when(quoted, outside_quotes(raw)).otherwise(raw).alias("outside"))
        return let(seen, lambda s: of_outside(s["ok"], F.when(s["ok"], s["outside"])))

    # A generator, as no optimiser puts its expression into several places: each record is read once.
    d = df.select("*", F.explode(F.array(of_line())).alias("_read"))
    d = d.withColumn("record", F.col("_read.record")).withColumn("reason", F.col("_read.reason"))
    return d.withColumn(CORRUPT, F.when(F.col("reason").isNotNull(), raw)).drop("_read")


class _Int(str):
    pass


class _Float(str):
    pass


def _no_constant(x: str) -> None:
    raise ValueError(x)


_DECODER = json.JSONDecoder(parse_int=_Int, parse_float=_Float, parse_constant=_no_constant, object_pairs_hook=list)


#: Digits of the greatest count that a column holds.
COUNT_DIGITS = 38


def object_fields(text: str | None, keys: Mapping[str, str]) -> tuple[str | None, list[str] | None]:
    """Why the object at the first ``{`` of a text isn't as it should be, or the texts of its values in the order of ``keys``.

    ``keys`` maps each key to its kind: count (JSON integer of 0 or more),
    score (JSON number from 0 to 1) or text (string). Key given twice: fields.
    Nested deeper than the parser allows (RFC 8259, section 9): syntax. A count of more than
    ``COUNT_DIGITS`` digits: value, as no column holds it. Half a surrogate pair, which no text can hold, becomes U+FFFD.
    """
    if text is None:
        return None, None
    at = text.find("{")
    if at < 0:
        return "syntax", None
    try:
        pairs, _ = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return "syntax", None
    if len(pairs) != len(keys) or {k for k, _ in pairs} != set(keys):
        return "fields", None
    for k, v in pairs:
        kind = keys[k]
        if kind == "text":
            ok = type(v) is str
        elif kind == "count":
            ok = type(v) is _Int and (not v.startswith("-") or not v.strip("-0")) and len(v) <= COUNT_DIGITS
        else:
            ok = type(v) in (_Int, _Float) and 0 <= float(v) <= 1
        if not ok:
            return "value", None
    values = dict(pairs)
    return None, ["".join("\ufffd" if "\ud800" <= c <= "\udfff" else c for c in values[k]) if keys[k] == "text" else values[k] for k in keys]


def object_reason(text: str | None, keys: Mapping[str, str]) -> str | None:
    return object_fields(text, keys)[0]


def _variant_kind(keys: Mapping[str, str]) -> str:
    """Pattern of the type of an object with exactly these keys, each of its kind."""
    kinds = {"count": "BIGINT", "score": r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", "text": "STRING"}
    name = lambda k: k if re.fullmatch(r"\w+", k) else f"`{k}`"
    return r"\AOBJECT<" + ", ".join(f"{re.escape(name(k))}: {kinds[keys[k]]}" for k in sorted(keys)) + r">\z"


def read_objects(df: DataFrame, text: str, keys: Mapping[str, str]) -> DataFrame:
    """Adds ``record`` and ``reason`` (null, syntax, fields or value) for JSON objects inside text.

    Objects are read permissively by the engine, from the first ``{`` on; those whose type is that of ``keys`` and whose
    numbers are in their ranges are loaded. All other texts are kept and read once more by a strict
    parser, which gives the reason, or the values where the first reading was too narrow.
    A null text is no case: both are null. A row with a reason has a null
    record and keeps its raw text in ``_corrupt_record``.
    """
    kinds = {"count": f"decimal({COUNT_DIGITS},0)", "score": "double", "text": "string"}
    ddl = ", ".join(f"`{k}`: {kinds[v]}" for k, v in keys.items())
    fixed = dict(keys)

    @F.pandas_udf("reason string, fields array<string>")
    def strict(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([object_fields(x, fixed) for x in s], columns=["reason", "fields"])

    raw = F.col(text)
    body = F.expr(f"substring(`{text}`, length(substring_index(`{text}`, '{{', 1)) + 1)")
    # Escaped halves of surrogate pairs are left to the strict parser.
    read = let(F.when(~raw.rlike(r"\\u[dD][89a-fA-F]"), F.try_parse_json(body)), lambda v: F.when(F.schema_of_variant(v).rlike(_variant_kind(keys)), F.try_variant_get(v, "$", f"struct<{ddl}>")))
    d = df.select("*", F.explode(F.array(read)).alias("_loose"))  # a generator: each object is read once
    ranges = [(F.col(f"_loose.`{k}`") >= 0) & (F.col(f"_loose.`{k}`") <= 1) if v == "score" else F.col(f"_loose.`{k}`") >= 0 if v == "count" else F.col(f"_loose.`{k}`").isNotNull() for k, v in keys.items()]
    d = d.withColumn("_vouched", F.coalesce(reduce(Column.__and__, ranges), F.lit(False)))
    d = d.withColumn("_strict", strict(F.when(~F.col("_vouched"), raw))).withColumn("reason", F.col("_strict.reason"))
    again = F.struct(*[F.col("_strict.fields")[i].try_cast(kinds[v]).alias(k) for i, (k, v) in enumerate(keys.items())])
    d = d.withColumn("record", F.when(F.col("_vouched"), F.col("_loose")).when(F.col("_strict.fields").isNotNull(), again))
    return d.withColumn(CORRUPT, F.when(F.col("reason").isNotNull(), raw)).drop("_loose", "_vouched", "_strict")
