"""Lenient extraction of typed records from free text, as column expressions only.

Each answer runs through stages until one yields a record: strict JSON, an isolated JSON block, lenient JSON,
repaired JSON, a regular expression per field, defaults. A later stage is evaluated only for rows that every
earlier stage left open, so clean answers pay for one JSON parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.json5 import MARK, to_json
from tallywise.functions.schemas import Field, get_schema, struct_type
from tallywise.functions.text import SPACE, is_blank, strip

STAGES = ("empty", "direct", "isolated", "lenient", "repaired", "field_regex", "default")

_STRICT = {"allowSingleQuotes": "false"}
_END_MARK = "__end__"


def _wrapped(text: Column) -> Column:
    """``text`` in an array in front of an end mark.

    ``from_json`` stops after the first value and ignores what follows. In the array, trailing text is a syntax error and
    a second object changes the size.
    """
    return F.concat(F.lit("["), text, F.lit('\n,{"%s":"1"}]' % _END_MARK))


def _one_object(text: Column, fields) -> Column:
    """The named fields (the last of equal keys) if ``text`` is exactly one JSON object, else null.

    Fields are variants: the parser tells a string from a number or a flag, and an explicit null from an absent field.
    """
    members = ",".join([*(f"`{f.name}`:variant" for f in fields), f"`{_END_MARK}`:string"])
    parsed = F.from_json(_wrapped(text), f"array<struct<{members}>>", _STRICT)
    return F.when((F.size(parsed) == 2) & (F.get(parsed, F.lit(1))[_END_MARK] == "1"), F.get(parsed, F.lit(0)))


def _told(value: Column, kind: str) -> Column:
    """JSON type and text of a variant, or of its items where a list is wanted."""

    def pair(v: Column) -> Column:
        return F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text"))

    if kind.startswith("list"):
        return F.transform(F.try_variant_get(value, "$", "array<variant>"), pair)
    return F.when(value.isNotNull(), pair(value))


def _may_be_strict(text: Column) -> Column:
    """Cheap necessary signs of strict JSON; a failed parse costs many times more than this look."""
    return text.rlike(r'^\s*\{\s*["}]') & text.rlike(r"\}\s*$") & ~text.rlike(r",\s*\}\s*$")


def _has_key(text: Column, name: str) -> Column:
    """Whether the object in ``text`` has the key at all: a value that can't be a variant (an object that names a key twice)
    looks like an absent field."""
    parsed = F.from_json(_wrapped(text), "array<map<string,string>>", _STRICT)
    return F.map_contains_key(F.get(parsed, F.lit(0)), name)


def _to_float(value: Column) -> Column:
    trimmed = strip(value)
    named = {f"{MARK}{name}": number for name, number in (("Infinity", "inf"), ("-Infinity", "-inf"), ("NaN", "nan"), ("-NaN", "nan"))}
    found = F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double"))
    for text, number in named.items():
        found = found.when(trimmed == text, F.lit(float(number)))
    return found


def _whole(number: Column) -> Column:
    """A number in text form as an integer, null if it has a fraction or more than 64 bits."""
    double = number.try_cast("double")
    return F.when((double % 1 == 0) & (F.abs(double) < 2.0**63), F.coalesce(number.try_cast("bigint"), double.try_cast("bigint")))


def _to_int(value: Column) -> Column:
    trimmed = strip(value)
    return (
        F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))
        .when(trimmed.rlike(r"^[+-]?\d+\.0+$"), _whole(trimmed))
    )


def _number(kind: str, told: Column) -> Column:
    """A JSON value as int or float: numbers and flags, and strings that spell a number."""
    json_type, text = told["kind"], told["text"]
    spelled = _to_int(text) if kind == "int" else _to_float(text)
    given = _whole(text) if kind == "int" else F.when(~text.isin("NaN", "Infinity", "-Infinity"), text.try_cast("double"))
    return (
        F.when(json_type == "BOOLEAN", (text == "true").cast("int").cast("bigint" if kind == "int" else "double"))
        .when(json_type.rlike("^(BIGINT|DECIMAL|DOUBLE)"), given)
        .when(json_type == "STRING", spelled)
    )


def _coerce(field: Field, told: Column) -> Column:
    """Typed value of a JSON value, or null where the lax conversion rules refuse it."""
    if field.kind in ("int", "float"):
        return _number(field.kind, told)
    if field.kind == "list[string]":
        only_strings = F.forall(told, lambda item: (item["kind"] == "STRING") & ~item["text"].startswith(MARK))
        return F.when(only_strings, F.transform(told, lambda item: item["text"]))
    if field.kind.startswith("list"):
        items = F.transform(told, lambda item: _number(field.kind[5:-1], item))
        return F.when(F.forall(items, lambda x: x.isNotNull()), items)
    json_type, text = told["kind"], told["text"]
    if field.kind == "string":
        return F.when((json_type == "STRING") & ~text.startswith(MARK), text)
    lowered = F.lower(text)
    numeric = F.when(json_type.rlike("^(BIGINT|DECIMAL|DOUBLE)"), text.try_cast("double"))
    return (
        F.when(json_type == "BOOLEAN", text == "true")
        .when(numeric.isin(0.0, 1.0), numeric == 1.0)
        .when((json_type == "STRING") & lowered.isin("true", "t", "yes", "y", "on", "1"), F.lit(True))
        .when((json_type == "STRING") & lowered.isin("false", "f", "no", "n", "off", "0"), F.lit(False))
    )


def _parse_stage(df: DataFrame, out: str, text: Column, when: Column, fields) -> DataFrame:
    """Add column ``out``: the record parsed from ``text`` for rows with ``when``, null if any field is refused.

    ``{out}_seen`` tells whether the text was one JSON object at all.

    Each intermediate is a column of its own: the optimizer keeps a projection whose results are used several times, so
    nothing is parsed twice.
    """
    source, given, told, typed = (f"{out}_{part}" for part in ("text", "given", "told", "typed"))
    df = df.withColumn(source, F.when(when, text))
    df = df.withColumn(given, _one_object(F.col(source), fields))

    described = F.struct(*[_told(F.col(given)[f.name], f.kind).alias(f.name) for f in fields])
    df = df.withColumn(told, F.when(F.col(given).isNotNull(), described))

    def value_of(field: Field) -> Column:
        value = F.col(told)[field.name]
        return F.when(value.isNotNull(), _coerce(field, value)).alias(field.name)

    df = df.withColumn(typed, F.when(F.col(told).isNotNull(), F.struct(*[value_of(f) for f in fields])))
    accepted, values = F.lit(True), []
    for field in fields:
        value, missing = F.col(typed)[field.name], F.col(given)[field.name].isNull()
        if field.required:
            absent = F.lit(False)
        else:
            absent = F.when(missing, ~_has_key(F.col(source), field.name)).otherwise(False)
        accepted = accepted & F.when(missing, absent).otherwise(field.violation(value).isNull())
        values.append(F.when(missing, field.default_column()).otherwise(value).alias(field.name))
    record = F.struct(*values).cast(struct_type(fields))
    df = df.withColumn(out, F.when(F.col(given).isNotNull() & accepted, record))
    df = df.withColumn(f"{out}_seen", F.col(given).isNotNull())
    return df.drop(source, given, told, typed)


def isolate_block(text: Column) -> Column:
    """The JSON part of an answer: a fenced block, else first opener to last matching closer, else the whole text."""
    fenced = F.regexp_extract(text, rf"(?s)```(?:json)?{SPACE}*(\{{.*\}}|\[.*\]){SPACE}*```", 1)
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    braces_first = (brace > 0) & ((bracket == 0) | (brace < bracket))
    span = (
        F.when(braces_first & text.contains("}"), F.regexp_extract(text, r"(?s)\{.*\}", 0))
        .when(~braces_first & (bracket > 0) & text.contains("]"), F.regexp_extract(text, r"(?s)\[.*\]", 0))
        .otherwise(text)
    )
    return F.when(text.contains("```") & (fenced != ""), fenced).otherwise(span)


def repair_truncated(text: Column) -> Column:
    """Append the closers that are missing at the end of cut-off JSON. Quotes are not looked at."""
    text = strip(text)
    marks = F.filter(F.split(F.regexp_replace(text, r"[^{}\[\]]", ""), ""), lambda c: c != "")

    def step(pending: Column, mark: Column) -> Column:
        return (
            F.when(mark == "{", F.concat(F.lit("}"), pending))
            .when(mark == "[", F.concat(F.lit("]"), pending))
            .when(F.startswith(pending, mark), F.substr(pending, F.lit(2)))
            .otherwise(pending)
        )

    return F.concat(text, F.aggregate(marks, F.lit(""), step))


# Repeated groups are possessive: they are matched without recursion, whatever the length of the answer.
_STRING = r'"[^"]*+(?:(?<=\\)"[^"]*+)*+"'
_BACKTRACKING_STRING = r'"(?:\\"|[^"])*"'
_NUMBER = r"-?\d+(?:\.\d+)?"


def field_from_text(field: Field, text: Column) -> Column:
    """First value of one field found by a type-aware pattern; null when there is none or the field is set to null."""
    key = rf'"{field.name}"{SPACE}*:{SPACE}*'

    def first(pattern: str, group: int = 1) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))

    if field.kind == "string":
        # without a later plain quote, the last escaped one closes the string
        pattern = key + r'"(?:([^"]*+(?:(?<=\\)"[^"]*+)*+)"|((?s:.*))")'
        torn = F.regexp_extract(text, pattern, 2)
        value = F.when(text.rlike(pattern), F.when(torn != "", torn).otherwise(F.regexp_extract(text, pattern, 1)))
        value = F.replace(value, F.lit('\\"'), F.lit('"'))
    elif field.kind == "int":
        digits = first(key + f"({_NUMBER})")
        value = F.when(~digits.contains("."), F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint")))
    elif field.kind == "float":
        value = first(key + f"({_NUMBER})").try_cast("double")
    elif field.kind == "bool":
        value = first(key + "(true|false)") == "true"
    else:
        item_type = field.spark_type[len("array<") : -1]
        quoted = first(key + rf"\[{SPACE}*({_STRING}(?:{SPACE}*,{SPACE}*{_STRING})*+){SPACE}*\]")
        # an escaped quote may still have been meant as a closing one
        second = first(key + rf"\[{SPACE}*({_BACKTRACKING_STRING}(?:{SPACE}*,{SPACE}*{_BACKTRACKING_STRING})*){SPACE}*\]")
        quoted = F.coalesce(quoted, F.when(text.contains('\\"'), second))
        numbers = first(key + rf"\[{SPACE}*({_NUMBER}(?:{SPACE}*,{SPACE}*{_NUMBER})*+){SPACE}*\]")

        def parts(col: Column) -> Column:
            return F.filter(F.transform(F.split(col, ","), strip), lambda x: x != "")

        unquoted = F.transform(parts(quoted), lambda x: F.btrim(x, F.lit('"')))
        if field.kind == "list[string]":
            value = F.coalesce(unquoted, parts(numbers))
        else:
            convert = _to_int if field.kind == "list[int]" else _to_float
            whole = ~numbers.contains(".") if field.kind == "list[int]" else F.lit(True)
            plain = F.when(whole, F.transform(parts(numbers), lambda x: x.try_cast(item_type)))
            value = F.coalesce(F.transform(unquoted, convert), plain)
            value = F.when(F.forall(value, lambda x: x.isNotNull()), value)
    return F.when(~text.rlike(key + "null"), value)


def extract_structured(
    df: DataFrame,
    text_col: str = "output_text",
    schema: str | tuple[Field, ...] = "PatientInfoSchema",
    prefix: str = "",
) -> DataFrame:
    """Add ``record`` (struct), ``status`` (the stage that decided) and ``valid`` to ``df``.

    A record that only the field patterns found is kept even when it breaks a constraint; ``valid`` is false then.
    """
    fields = get_schema(schema) if isinstance(schema, str) else tuple(schema)
    raw, record, status, valid = F.col(text_col), f"{prefix}record", f"{prefix}status", f"{prefix}valid"
    stages = ["_direct", "_isolated", "_lenient", "_repaired"]

    def open_after(*done: str) -> Column:
        return F.coalesce(*[F.col(c) for c in done]).isNull()

    out = df.withColumn("_empty", is_blank(raw))
    stripped = strip(raw)
    direct_when = ~F.col("_empty") & _may_be_strict(stripped)
    out = _parse_stage(out, "_direct", stripped, direct_when, fields)
    out = out.withColumn("_block", F.when(~F.col("_empty") & open_after("_direct"), isolate_block(raw)))
    block = F.col("_block")
    # a block that is the whole answer was parsed already
    isolated_when = _may_be_strict(block) & (block != stripped)
    out = _parse_stage(out, "_isolated", block, isolated_when, fields)
    # a block that is sound JSON but breaks a rule breaks it in every later parse too: on to the field patterns
    sound = F.when(block == stripped, F.col("_direct_seen")).otherwise(F.col("_isolated_seen"))
    is_object = open_after("_direct", "_isolated") & strip(block).startswith("{") & ~sound
    lenient_when = is_object & strip(block).endswith("}")
    out = _parse_stage(out, "_lenient", to_json(block), lenient_when, fields)
    still_open = is_object & open_after("_lenient") & ~F.col("_lenient_seen")
    out = out.withColumn("_closed", F.when(still_open, repair_truncated(block)))
    # with nothing to add, the block would fail as it did before
    closed = F.col("_closed")
    out = _parse_stage(out, "_repaired", closed, (closed != strip(block)) & _may_be_strict(closed), fields)
    unparsed = ~F.col("_empty") & open_after(*stages)
    found = F.struct(*[field_from_text(f, block).alias(f.name) for f in fields])
    out = out.withColumn("_fields", F.when(unparsed, found))
    values = [F.col("_fields")[f.name] for f in fields]
    merged = F.struct(*[F.coalesce(v, f.default_column()).alias(f.name) for f, v in zip(fields, values)])
    any_found = F.coalesce(*[v.cast("string") for v in values]).isNotNull()
    out = out.withColumn(
        status,
        F.when(F.col("_empty"), F.lit("empty"))
        .when(F.col("_direct").isNotNull(), F.lit("direct"))
        .when(F.col("_isolated").isNotNull(), F.lit("isolated"))
        .when(F.col("_lenient").isNotNull(), F.lit("lenient"))
        .when(F.col("_repaired").isNotNull(), F.lit("repaired"))
        .when(any_found, F.lit("field_regex"))
        .otherwise(F.lit("default")),
    )
    out = out.withColumn(record, F.coalesce(*[F.col(s) for s in stages], merged.cast(struct_type(fields))))
    parsed = F.col(status).isin("direct", "isolated", "lenient", "repaired")
    kept_rules = [f.violation(F.col(record)[f.name]) for f in fields]
    regex_valid = (F.col(status) == "field_regex") & F.coalesce(*kept_rules).isNull()
    out = out.withColumn(valid, parsed | regex_valid)
    return out.drop("_empty", "_block", "_closed", "_fields", *stages, *[f"{s}_seen" for s in stages])


def status_counts(extracted: DataFrame, status_col: str = "status") -> DataFrame:
    """How many answers each stage decided."""
    return extracted.groupBy(status_col).agg(F.count("*").alias("n"))


def predictions_wide(extracted: DataFrame, id_cols: list[str], fields: list[str], runs: int) -> DataFrame:
    """One row per document with a column per field and run, ``{field}_{run:03d}``."""
    picks = [
        F.max(F.when(F.col("run_idx") == i, F.col("record")[f])).alias(f"{f}_{i:03d}")
        for i in range(runs)
        for f in fields
    ]
    return extracted.groupBy(*id_cols).agg(*picks)
