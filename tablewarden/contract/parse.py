"""YAML to contract and back. Unknown keys, wrong kinds and repeated keys are errors that name the line."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

import yaml

from . import model as m
from .model import Check, Column, Consumer, Contract, ContractError, Field, InputSettings, Migration, Settings, did_you_mean, parse_duration


class _Loader(yaml.SafeLoader):
    """YAML 1.2 scalars (``yes`` and ``2026-01-01`` are text), no repeated keys, and lines by value."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), list(_first))


class Map(dict):
    """A mapping that knows its line and those of its keys."""

    line: int = 0
    lines: dict[Any, int]


def _mapping(loader: _Loader, node: yaml.MappingNode) -> Map:
    out = Map()
    out.line, out.lines = node.start_mark.line + 1, {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        at = key_node.start_mark.line + 1
        if key in out:
            raise ContractError(f"`{key}` stands here a second time (first on line {out.lines[key]})", at)
        out[key] = loader.construct_object(value_node, deep=True)
        out.lines[key] = at
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(v.replace("+", ""), 0) if (v := loader.construct_scalar(node)).lstrip("+-")[:2] in ("0x", "0o") else int(v))
_Loader.add_constructor("tag:yaml.org,2002:float", lambda loader, node: float(loader.construct_scalar(node).replace(".inf", "inf").replace(".nan", "nan").replace(".Inf", "inf").replace(".NaN", "nan")))


def _keys(value: Any, known: tuple[str, ...], what: str, line: int | None = None) -> Map:
    if not isinstance(value, dict):
        raise ContractError(f"{what} must be a mapping", line)
    for key in value:
        if key not in known:
            raise ContractError(f"unknown field `{key}` in {what}{did_you_mean(str(key), known)}", value.lines.get(key))
    return value


def _text(raw: Map, key: str, what: str, need: bool = False) -> str | None:
    value = raw.get(key)
    if value is None:
        if need:
            raise ContractError(f"{what} needs `{key}`", raw.line)
        return None
    if not isinstance(value, str):
        if isinstance(value, int | float) and not isinstance(value, bool) and key in ("version", "sunset", "window_ends"):
            return str(value)
        raise ContractError(f"`{key}` of {what} must be text", raw.lines.get(key))
    return value


def _flag(raw: Map, key: str, default: bool) -> bool:
    value = raw.get(key, default)
    if not isinstance(value, bool):
        raise ContractError(f"`{key}` must be true or false", raw.lines.get(key))
    return value


def _one_of(raw: Map, key: str, known: tuple[str, ...], default: str | None) -> str | None:
    value = raw.get(key, default)
    if value is not None and value not in known:
        raise ContractError(f"`{key}` cannot be `{value}`{did_you_mean(str(value), known)} (one of {', '.join(known)})", raw.lines.get(key))
    return value


def _names(raw: Map, key: str, what: str) -> tuple[str, ...]:
    value = raw.get(key)
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list) or not value or not all(isinstance(x, str) for x in value):
        raise ContractError(f"`{key}` of {what} must list column names", raw.lines.get(key, raw.line))
    return tuple(value)


def _number(value: Any, what: str, line: int | None, kind: type = float) -> Any:
    if isinstance(value, bool) or not isinstance(value, int | float) or kind is int and (not isinstance(value, int) or value < 0):
        raise ContractError(f"`{what}` must be {'a whole number, not negative' if kind is int else 'a number'}", line)
    return value


def _check(raw: Any, known: tuple[str, ...], where: str, line: int | None) -> Check:
    """A bare name, or a map of one check kind and an optional severity."""
    if isinstance(raw, str):
        if raw not in known:
            raise ContractError(f"unknown check `{raw}` in {where}{did_you_mean(raw, known)}", line)
        if raw not in m.BARE_CHECKS:
            raise ContractError(f"check `{raw}` in {where} needs a parameter", line)
        return Check(raw, {"approx": False} if raw == "unique" else {})
    if not isinstance(raw, dict):
        raise ContractError(f"a check in {where} must be a name or a mapping", line)
    kinds = [k for k in raw if k != "severity"]
    for k in kinds:
        if k not in known:
            raise ContractError(f"unknown check `{k}` in {where}{did_you_mean(str(k), known)}", raw.lines[k])
    if len(kinds) != 1:
        raise ContractError(f"a check in {where} must have exactly one kind, not {len(kinds)}", raw.line)
    kind, at = kinds[0], raw.lines[kinds[0]]
    severity = _one_of(raw, "severity", m.SEVERITIES, None)
    body = raw[kind]
    if isinstance(body, dict) and "severity" in body and kind not in m.BARE_CHECKS:
        if severity is not None:
            raise ContractError(f"`severity` of `{kind}` is given twice", body.lines["severity"])
        severity = _one_of(body, "severity", m.SEVERITIES, None)
        inner = Map({k: v for k, v in body.items() if k != "severity"})
        inner.line, inner.lines = body.line, body.lines
        body = inner
    return Check(kind, _params(kind, body, known is m.DATASET_CHECKS, at), severity or "error")


def _params(kind: str, body: Any, dataset: bool, at: int) -> dict[str, Any]:
    if kind == "unique":
        if body is None or body is True:
            return {"approx": False}
        return {"approx": _flag(_keys(body, ("approx",), "`unique`", at), "approx", False)}
    if kind == "not_empty_string":
        if body not in (None, True) and body != {}:
            raise ContractError("`not_empty_string` takes no parameter", at)
        return {}
    if kind in ("min", "max"):
        return {kind: _number(body, kind, at)}
    if kind == "regex":
        if not isinstance(body, str):
            raise ContractError("`regex` must be text", at)
        return {"regex": body}
    if kind == "enum":
        if not isinstance(body, list) or any(isinstance(x, list | dict) or x is None for x in body):
            raise ContractError("`enum` must list values", at)
        return {"enum": list(body)}
    if kind == "length":
        if isinstance(body, dict):
            _keys(body, ("min", "max"), "`length`", at)
            return {"length": {k: _number(v, f"length.{k}", at, int) for k, v in body.items() if v is not None}}
        return {"length": _number(body, "length", at, int)}
    if kind == "format":
        if body not in m.FORMATS:
            raise ContractError(f"unknown format `{body}`{did_you_mean(str(body), m.FORMATS)}", at)
        return {"format": body}
    if kind in ("row_count_min", "row_count_max"):
        if isinstance(body, dict):
            body = _keys(body, ("count",), f"`{kind}`", at).get("count")
        return {"count": _number(body, kind, at, int)}
    if kind in ("null_ratio_max", "unique_ratio_min"):
        if not dataset:
            return {"ratio": float(_number(body, kind, at))}
        _keys(body, ("column", "ratio"), f"`{kind}`", at)
        return {"column": _text(body, "column", f"`{kind}`", True), "ratio": float(_number(body.get("ratio"), "ratio", at))}
    if kind in ("custom_expr", "assert"):
        if isinstance(body, dict):
            body = _text(_keys(body, ("expr",), f"`{kind}`", at), "expr", f"`{kind}`", True)
        if not isinstance(body, str):
            raise ContractError(f"`{kind}` must be an expression", at)
        return {"expr": body}
    if kind == "freshness":
        _keys(body, ("column", "max_age"), "`freshness`", at)
        age = body.get("max_age")
        try:
            return {"column": _text(body, "column", "`freshness`", True), "max_age": parse_duration(age if isinstance(age, str) else str(age))}
        except ValueError as e:
            raise e if isinstance(e, ContractError) else ContractError(str(e), at) from None
    _keys(body, ("columns", "dataset", "to"), "`references`", at)
    columns = _names(body, "columns", "`references`")
    to = _names(body, "to", "`references`") if body.get("to") is not None else columns
    if len(to) != len(columns):
        raise ContractError(f"`references` pairs {len(columns)} columns with {len(to)}", at)
    return {"columns": list(columns), "dataset": _text(body, "dataset", "`references`", True), "to": list(to)}


def _column(name: str, raw: Any, line: int) -> Column:
    what = f"column `{name}`"
    _keys(raw, ("type", "description", "required", "pii", "classification", "stability", "sunset", "checks"), what, line)
    if raw.get("type") is None:
        raise ContractError(f"{what} needs `type`", line)
    checks = raw.get("checks") or []
    if not isinstance(checks, list):
        raise ContractError(f"`checks` of {what} must be a list", raw.lines["checks"])
    return Column(
        name=name,
        type=_one_of(raw, "type", m.TYPES, None),
        description=_text(raw, "description", what),
        required=_flag(raw, "required", False),
        pii=_one_of(raw, "pii", m.PII_KINDS, None),
        classification=_one_of(raw, "classification", m.CLASSIFICATIONS, None),
        stability=_one_of(raw, "stability", m.STABILITIES, "stable"),
        sunset=_text(raw, "sunset", what),
        checks=tuple(_check(c, m.COLUMN_CHECKS, what, getattr(c, "line", line)) for c in checks),
    )


def _consumer(raw: Any, line: int) -> Consumer:
    if isinstance(raw, str):
        return Consumer(raw)
    _keys(raw, ("name", "contact", "reads", "tier", "kind"), "a consumer", line)
    reads = tuple(raw["reads"]) if isinstance(raw.get("reads"), list) else None
    return Consumer(_text(raw, "name", "a consumer", True), _text(raw, "contact", "a consumer"), reads, raw.get("tier"), _one_of(raw, "kind", m.CONSUMER_KINDS, None))


def _input(raw: Any, line: int) -> InputSettings:
    _keys(raw, tuple(InputSettings.__dataclass_fields__), "`input`", line)
    layout = raw.get("fixed_width")
    if layout is not None:
        if not isinstance(layout, list):
            raise ContractError("`fixed_width` must list fields", raw.lines["fixed_width"])
        layout = tuple(Field(**{"name": "", **_keys(f, ("name", "start", "end", "width"), "a fixed-width field", raw.lines["fixed_width"])}) for f in layout)
    skip = raw.get("skip_rows")
    return InputSettings(
        format=_one_of(raw, "format", m.INPUT_FORMATS, None),
        delimiter=_text(raw, "delimiter", "`input`"),
        has_header=raw.get("has_header"),
        skip_rows=None if skip is None else _number(skip, "skip_rows", raw.lines["skip_rows"], int),
        json_path=_text(raw, "json_path", "`input`"),
        sheet=raw.get("sheet"),
        xml_record=_text(raw, "xml_record", "`input`"),
        fixed_width=layout,
    )


def parse_contract(text: str) -> Contract:
    """A contract from its YAML text."""
    try:
        raw = yaml.load(text, Loader=_Loader)  # noqa: S506  a SafeLoader
    except yaml.MarkedYAMLError as e:
        raise ContractError(f"not valid YAML: {e.problem}", e.problem_mark.line + 1 if e.problem_mark else None) from None
    if raw is None:
        raise ContractError("the contract is empty")
    known = ("apiVersion", "dataset", "owner", "description", "version", "consumers", "columns", "primary_key", "dataset_checks", "migration", "settings")
    _keys(raw, known, "the contract", 1)
    version = raw.get("apiVersion")
    if version != "v1":
        raise ContractError(f"`apiVersion` must be v1, not `{version}`", raw.lines.get("apiVersion", 1))
    columns = raw.get("columns") or Map()
    if not isinstance(columns, dict):
        raise ContractError("`columns` must map names to definitions", raw.lines["columns"])
    checks = raw.get("dataset_checks") or []
    if not isinstance(checks, list):
        raise ContractError("`dataset_checks` must be a list", raw.lines["dataset_checks"])
    settings, migration = raw.get("settings"), raw.get("migration")
    if settings is not None:
        _keys(settings, ("allow_extra_columns", "columns_exact", "on_type_mismatch", "input"), "`settings`", raw.lines["settings"])
        given = settings.get("input")
        settings = Settings(
            _flag(settings, "allow_extra_columns", True), _flag(settings, "columns_exact", False), _one_of(settings, "on_type_mismatch", m.SEVERITIES, "error"), _input(given, settings.lines["input"]) if given is not None else InputSettings()
        )
    if migration is not None:
        _keys(migration, ("window_ends", "note"), "`migration`", raw.lines["migration"])
        migration = Migration(_text(migration, "window_ends", "`migration`", True), _text(migration, "note", "`migration`"))
    return Contract(
        dataset=_text(raw, "dataset", "the contract", True),
        columns={str(k): _column(str(k), v, columns.lines[k]) for k, v in columns.items()},
        owner=_text(raw, "owner", "the contract"),
        description=_text(raw, "description", "the contract"),
        version=_text(raw, "version", "the contract"),
        consumers=tuple(_consumer(c, raw.lines["consumers"]) for c in raw.get("consumers") or []),
        primary_key=_names(raw, "primary_key", "the contract") if raw.get("primary_key") is not None else (),
        dataset_checks=tuple(_check(c, m.DATASET_CHECKS, "`dataset_checks`", getattr(c, "line", None)) for c in checks),
        migration=migration,
        settings=settings or Settings(),
    )


def load_contract(path: str | Path) -> Contract:
    return parse_contract(Path(path).read_text(encoding="utf-8"))


def check_form(check: Check) -> Any:
    """The YAML form of a check."""
    p = check.params
    if check.kind == "unique":
        body: Any = {"approx": True} if p["approx"] else None
    elif check.kind == "not_empty_string":
        body = None
    elif check.kind == "freshness":
        body = {"column": p["column"], "max_age": m.format_duration(p["max_age"])}
    elif check.kind == "references":
        body = {"columns": p["columns"], "dataset": p["dataset"], **({"to": p["to"]} if p["to"] != p["columns"] else {})}
    else:
        body = p if len(p) > 1 else next(iter(p.values()))
    if body is None and check.severity == "error":
        return check.kind
    form = {check.kind: {} if body is None else body}
    if check.severity != "error":
        form["severity"] = check.severity
    return form


def contract_form(c: Contract) -> dict[str, Any]:
    """The contract as plain data in YAML's order, defaults left out."""
    columns = {}
    for name, col in c.columns.items():
        d: dict[str, Any] = {"type": col.type}
        d |= {k: v for k in ("description", "pii", "classification", "sunset") if (v := getattr(col, k)) is not None}
        d |= {"required": True} if col.required else {}
        d |= {"stability": col.stability} if col.stability != "stable" else {}
        d |= {"checks": [check_form(x) for x in col.checks]} if col.checks else {}
        columns[name] = d
    s, i = c.settings, c.settings.input
    given = {k: v for k in InputSettings.__dataclass_fields__ if (v := getattr(i, k)) is not None}
    if "fixed_width" in given:
        given["fixed_width"] = [{k: v for k, v in vars(f).items() if v is not None} for f in given["fixed_width"]]
    settings = {"allow_extra_columns": s.allow_extra_columns, "columns_exact": s.columns_exact, "on_type_mismatch": s.on_type_mismatch} | ({"input": given} if given else {})
    out: dict[str, Any] = {"apiVersion": "v1", "dataset": c.dataset}
    out |= {k: v for k in ("owner", "description", "version") if (v := getattr(c, k)) is not None}
    if c.consumers:
        out["consumers"] = [{k: list(v) if isinstance(v, tuple) else v for k, v in vars(x).items() if v is not None} for x in c.consumers]
    out["columns"] = columns
    out |= {"primary_key": list(c.primary_key)} if c.primary_key else {}
    out |= {"dataset_checks": [check_form(x) for x in c.dataset_checks]} if c.dataset_checks else {}
    if c.migration:
        out["migration"] = {k: v for k, v in vars(c.migration).items() if v is not None}
    if s != Settings():
        out["settings"] = settings
    return out


class _Dumper(yaml.SafeDumper):
    """Quotes whatever a reader could take for something other than text."""


_Dumper.add_representer(str, lambda d, v: d.represent_scalar("tag:yaml.org,2002:str", v, style="'" if re.match(r"^[-+.0-9]|^(?:true|false|null|yes|no|on|off|~)$", v, re.I) else None))


def dump_contract(c: Contract) -> str:
    return yaml.dump(contract_form(c), Dumper=_Dumper, sort_keys=False, allow_unicode=True, width=1000)
