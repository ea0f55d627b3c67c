"""The JSON Schema of the contract format, built from the model's own lists."""

from __future__ import annotations

from typing import Any

from . import model as m


def _object(properties: dict[str, Any], required: tuple[str, ...] = ()) -> dict[str, Any]:
    out: dict[str, Any] = {"type": "object", "properties": properties, "additionalProperties": False}
    return out | ({"required": list(required)} if required else {})


_TEXT, _BOOL, _COUNT, _RATIO = {"type": "string"}, {"type": "boolean"}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}
_NAMES = {"type": "array", "items": _TEXT}
_DATE = {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"}
_SEVERITY = {"enum": list(m.SEVERITIES)}


def _either(body: dict[str, Any], name: str) -> dict[str, Any]:
    return {"anyOf": [body, _object({name: body, "severity": _SEVERITY}, (name,))]}


_BODIES: dict[str, dict[str, Any]] = {
    "unique": _object({"approx": _BOOL}),
    "not_empty_string": {"type": "object", "maxProperties": 0},
    "min": {"type": "number"},
    "max": {"type": "number"},
    "regex": _TEXT,
    "enum": {"type": "array", "items": {"type": ["string", "number", "boolean"]}, "minItems": 1},
    "length": {"anyOf": [_COUNT, _object({"min": _COUNT, "max": _COUNT})]},
    "format": {"enum": list(m.FORMATS)},
    "null_ratio_max": _RATIO,
    "unique_ratio_min": _RATIO,
    "custom_expr": _either(_TEXT, "expr"),
    "row_count_min": _either(_COUNT, "count"),
    "row_count_max": _either(_COUNT, "count"),
    "freshness": _object({"column": _TEXT, "max_age": _TEXT, "severity": _SEVERITY}, ("column", "max_age")),
    "assert": _either(_TEXT, "expr"),
    "references": _object({"columns": _NAMES, "dataset": _TEXT, "to": _NAMES, "severity": _SEVERITY}, ("columns", "dataset")),
}
_OF_COLUMN = _object({"column": _TEXT, "ratio": _RATIO, "severity": _SEVERITY}, ("column", "ratio"))


def _checks(kinds: tuple[str, ...], dataset: bool) -> dict[str, Any]:
    forms: list[dict[str, Any]] = [] if dataset else [{"enum": list(m.BARE_CHECKS)}]
    for kind in kinds:
        body = _OF_COLUMN if dataset and kind in ("null_ratio_max", "unique_ratio_min") else _BODIES[kind]
        forms.append(_object({kind: body, "severity": _SEVERITY}, (kind,)))
    return {"type": "array", "items": {"oneOf": forms}}


def json_schema() -> dict[str, Any]:
    column = _object(
        {
            "type": {"enum": list(m.TYPES)}, "description": _TEXT, "required": _BOOL, "pii": {"enum": list(m.PII_KINDS)}, "classification": {"enum": list(m.CLASSIFICATIONS)},
            "stability": {"enum": list(m.STABILITIES)}, "sunset": _DATE, "checks": _checks(m.COLUMN_CHECKS, False),
        },
        ("type",),
    )
    fixed = _object({"name": _TEXT, "start": {"type": "integer", "minimum": 1}, "end": {"type": "integer", "minimum": 1}, "width": {"type": "integer", "minimum": 1}}, ("name",))
    read = _object({"format": {"enum": list(m.INPUT_FORMATS)}, "delimiter": _TEXT, "has_header": _BOOL, "skip_rows": _COUNT, "json_path": _TEXT, "sheet": {"type": ["string", "integer"]}, "xml_record": _TEXT, "fixed_width": {"type": "array", "items": fixed}})
    consumer = _object({"name": _TEXT, "contact": _TEXT, "reads": _NAMES, "tier": {"type": "integer", "minimum": 1, "maximum": 3}, "kind": {"enum": list(m.CONSUMER_KINDS)}}, ("name",))
    root = _object(
        {
            "apiVersion": {"const": "v1"}, "dataset": _TEXT, "owner": _TEXT, "description": _TEXT, "version": _TEXT, "consumers": {"type": "array", "items": consumer},
            "columns": {"type": "object", "additionalProperties": column}, "primary_key": _NAMES, "dataset_checks": _checks(m.DATASET_CHECKS, True),
            "migration": _object({"window_ends": _DATE, "note": _TEXT}, ("window_ends",)),
            "settings": _object({"allow_extra_columns": _BOOL, "columns_exact": _BOOL, "on_type_mismatch": _SEVERITY, "input": read}),
        },
        ("apiVersion", "dataset"),
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Data contract v1"} | root
