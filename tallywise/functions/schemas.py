"""Record schemas: the fields an answer must hold, with defaults and constraints."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUIRED = object()

SPARK_TYPES = {
    "string": "string",
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "list[string]": "array<string>",
    "list[int]": "array<bigint>",
    "list[float]": "array<double>",
}

JSON_TYPES = {"string": "string", "int": "integer", "float": "number", "bool": "boolean"}


@dataclass(frozen=True)
class Field:
    """One field of a record. A field without a default is required."""

    name: str
    kind: str
    default: object = REQUIRED
    ge: float | None = None
    le: float | None = None
    pattern: str | None = None
    choices: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.kind not in SPARK_TYPES:
            raise ValueError(f"Unknown field kind '{self.kind}', expected one of {sorted(SPARK_TYPES)}")

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.kind]

    @property
    def required(self) -> bool:
        return self.default is REQUIRED

    def default_column(self) -> Column:
        """The value a missing field gets; a required list becomes empty, any other required field null."""
        if not self.required:
            value = self.default
            if isinstance(value, (list, tuple)):
                return F.array(*[F.lit(v) for v in value]).cast(self.spark_type)
            return F.lit(value).cast(self.spark_type)
        if self.kind.startswith("list"):
            return F.array().cast(self.spark_type)
        return F.lit(None).cast(self.spark_type)

    def violation(self, value: Column) -> Column:
        """Name of the rule ``value`` breaks, or null."""
        rules = F.when(value.isNull(), F.lit(f"{self.name}:missing"))
        if self.ge is not None:
            rules = rules.when(value < self.ge, F.lit(f"{self.name}:below_minimum"))
        if self.le is not None:
            rules = rules.when(value > self.le, F.lit(f"{self.name}:above_maximum"))
        if self.pattern is not None:
            rules = rules.when(~value.rlike(self.pattern), F.lit(f"{self.name}:pattern"))
        if self.choices is not None:
            rules = rules.when(~value.isin(*self.choices), F.lit(f"{self.name}:not_allowed"))
        return rules


# Schema names, field names, bounds, date pattern and event types that answers are checked against.
ISO_DATE = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])$"
EVENT_TYPES = ("Admission", "Discharge", "Procedure")
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "PatientInfoSchema": (Field("mRS", "int", default=-1, ge=0, le=6),),
    "ClinicalEventDate": (
        Field("event_date", "string", pattern=ISO_DATE),
        Field("event_type", "string", choices=EVENT_TYPES),
    ),
}


def get_schema(name: str) -> tuple[Field, ...]:
    """Look a registered schema up by name."""
    if name not in SCHEMAS:
        raise ValueError(f"no schema is registered as {name!r}, only {', '.join(sorted(SCHEMAS))}")
    return SCHEMAS[name]


def register_schema(name: str, fields: tuple[Field, ...]) -> None:
    SCHEMAS[name] = tuple(fields)


def struct_type(fields: tuple[Field, ...]) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.spark_type}" for f in fields) + ">"


def violations(fields: tuple[Field, ...], record: Column) -> Column:
    """Array of the rules a record struct breaks; empty when it is valid."""
    found = F.array(*[f.violation(record.getField(f.name)) for f in fields])
    return F.array_compact(found)


def json_schema(name: str) -> str:
    """JSON Schema text of a registered record, the hint handed to a generator."""
    properties = {}
    for field in get_schema(name):
        spec: dict = {"title": field.name.replace("_", " ").title()}
        if field.kind.startswith("list["):
            spec |= {"type": "array", "items": {"type": JSON_TYPES[field.kind[5:-1]]}}
        else:
            spec["type"] = JSON_TYPES[field.kind]
        if not field.required:
            spec["default"] = field.default
        if field.ge is not None:
            spec["minimum"] = field.ge
        if field.le is not None:
            spec["maximum"] = field.le
        if field.pattern is not None:
            spec["pattern"] = field.pattern
        if field.choices is not None:
            spec["enum"] = list(field.choices)
        properties[field.name] = spec
    schema: dict = {"title": name, "type": "object", "properties": properties}
    needed = [f.name for f in get_schema(name) if f.required]
    if needed:
        schema["required"] = needed
    return json.dumps(schema, sort_keys=True)
