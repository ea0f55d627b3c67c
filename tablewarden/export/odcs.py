"""Open Data Contract Standard v3, both ways. What the standard has no word for travels as custom entries."""

from __future__ import annotations

from typing import Any

import yaml

from ..contract import model as m
from ..contract.model import Contract, ContractError
from ..contract.parse import check_form, contract_form, parse_contract

ENGINE = "tablewarden"
_LOGICAL = {"string": "string", "int": "integer", "float": "number", "bool": "boolean", "date": "date", "datetime": "timestamp"}
_BACK = {"string": "string", "integer": "int", "number": "float", "boolean": "bool", "date": "date", "timestamp": "datetime", "datetime": "datetime", "time": "string"}


def is_odcs(text: str) -> bool:
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError:
        return False
    return isinstance(raw, dict) and raw.get("kind") == "DataContract" and str(raw.get("apiVersion", "")).lstrip("v").startswith("3")


def _custom(form: Any) -> dict[str, Any]:
    return {"type": "custom", "engine": ENGINE, "implementation": form}


def _extra(values: dict[str, Any]) -> list[dict[str, Any]]:
    return [{"property": k, "value": v} for k, v in values.items() if v is not None]


def export_odcs(c: Contract) -> str:
    properties = []
    for name, col in c.columns.items():
        d: dict[str, Any] = {"name": name, "logicalType": _LOGICAL[col.type]}
        d |= {"description": col.description} if col.description is not None else {}
        d |= {"required": True} if col.required else {}
        d |= {"unique": True} if any(k.kind == "unique" and not k["approx"] and k.severity == "error" for k in col.checks) else {}
        if name in c.primary_key:
            d |= {"primaryKey": True, "primaryKeyPosition": c.primary_key.index(name) + 1}
        d |= {"classification": col.classification} if col.classification else {}
        if extra := _extra({"pii": col.pii, "stability": col.stability if col.stability != "stable" else None, "sunset": col.sunset}):
            d["customProperties"] = extra
        if col.checks:
            d["quality"] = [_custom(check_form(k)) for k in col.checks]
        properties.append(d)
    form = contract_form(c)
    table: dict[str, Any] = {"name": c.dataset, "logicalType": "object", "properties": properties}
    if c.dataset_checks:
        table["quality"] = [_custom(check_form(k)) for k in c.dataset_checks]
    out: dict[str, Any] = {"apiVersion": "v3.0.2", "kind": "DataContract", "id": c.dataset, "name": c.dataset, "version": c.version or "1.0.0", "status": "active"}
    if c.description is not None:
        out["description"] = {"purpose": c.description}
    out["schema"] = [table]
    if c.owner:
        out["team"] = [{"username": c.owner, "role": "owner"}]
    extra = _extra({"consumers": form.get("consumers"), "migration": form.get("migration"), "settings": form.get("settings"), "declaredVersion": c.version is not None})
    return yaml.safe_dump(out | {"customProperties": extra}, sort_keys=False, allow_unicode=True, width=1000)


def _values(items: Any) -> dict[str, Any]:
    return {x["property"]: x.get("value") for x in items or [] if isinstance(x, dict) and "property" in x}


def _known_check(form: Any, kinds: tuple[str, ...]) -> bool:
    return form in m.BARE_CHECKS if isinstance(form, str) else isinstance(form, dict) and len([k for k in form if k in kinds]) == 1


def _quality(entry: dict[str, Any], column: str | None, notes: list[str]) -> Any:
    """A check form for one quality entry, or a note that it has none."""
    where = f"`{column}`" if column else "the table"
    kinds = m.COLUMN_CHECKS if column else m.DATASET_CHECKS
    if entry.get("type") == "custom" and _known_check(entry.get("implementation"), kinds):
        return entry["implementation"]
    rule = entry.get("rule") or entry.get("metric")
    limit = next((entry[k] for k in ("mustBe", "mustBeLessOrEqualTo", "mustBeLessThan", "mustBeGreaterOrEqualTo", "mustBeGreaterThan") if k in entry), None)
    severity = {"severity": "warn"} if str(entry.get("severity", "")).lower() in ("warning", "warn", "info") else {}
    if rule in ("duplicateCount", "duplicateValues") and column and limit == 0:
        return {"unique": {}} | severity
    if rule in ("nullCount", "nullValues") and column and limit == 0:
        return {"null_ratio_max": 0.0} | severity
    if rule == "rowCount" and not column:
        if "mustBeGreaterOrEqualTo" in entry or "mustBeGreaterThan" in entry:
            return {"row_count_min": int(limit) + ("mustBeGreaterThan" in entry)} | severity
        if "mustBeLessOrEqualTo" in entry or "mustBeLessThan" in entry:
            return {"row_count_max": int(limit) - ("mustBeLessThan" in entry)} | severity
    if rule in ("invalidValues", "validValues") and column and entry.get("validValues"):
        return {"enum": entry["validValues"]} | severity
    notes.append(f"the quality entry `{rule or entry.get('type') or 'text'}` of {where} has no counterpart and is left out")
    return None


def import_odcs(text: str, table: str | None = None) -> tuple[Contract, list[str]]:
    """A contract from the standard's document, and notes on what could not be carried over."""
    raw, notes = yaml.safe_load(text), []
    if not is_odcs(text):
        raise ContractError("not an Open Data Contract Standard v3 document")
    tables = raw.get("schema") or []
    if not tables:
        raise ContractError("the document describes no table")
    found = next((t for t in tables if t.get("name") == table), None) if table else tables[0]
    if found is None:
        raise ContractError(f"no table `{table}`; the document has {', '.join(str(t.get('name')) for t in tables)}")
    if len(tables) > 1 and not table:
        notes.append(f"only the first of {len(tables)} tables is read: {found.get('name')}")
    extra = _values(raw.get("customProperties"))
    columns, keys = {}, {}
    for p in found.get("properties") or []:
        name = p["name"]
        logical = str(p.get("logicalType", "string"))
        if logical not in _BACK:
            notes.append(f"the type `{logical}` of `{name}` is read as string")
        own = _values(p.get("customProperties"))
        d: dict[str, Any] = {"type": _BACK.get(logical, "string")}
        d |= {k: v for k, v in (("description", p.get("description")), ("pii", own.get("pii")), ("stability", own.get("stability")), ("sunset", own.get("sunset"))) if v is not None}
        if p.get("classification") in m.CLASSIFICATIONS:
            d["classification"] = p["classification"]
        elif p.get("classification"):
            notes.append(f"the classification `{p['classification']}` of `{name}` is left out")
        if p.get("required"):
            d["required"] = True
        checks = [f for q in p.get("quality") or [] if (f := _quality(q, name, notes)) is not None]
        if p.get("unique") and not any(f == "unique" or isinstance(f, dict) and "unique" in f for f in checks):
            checks.insert(0, "unique")
        options = p.get("logicalTypeOptions") or {}
        have = {k for f in checks if isinstance(f, dict) for k in f}
        for option, kind in (("pattern", "regex"), ("minimum", "min"), ("maximum", "max")):
            if option in options and kind not in have:
                checks.append({kind: options[option]})
        if ("minLength" in options or "maxLength" in options) and "length" not in have:
            checks.append({"length": {k: options[o] for k, o in (("min", "minLength"), ("max", "maxLength")) if o in options}})
        if checks:
            d["checks"] = checks
        if p.get("primaryKey"):
            keys[name] = p.get("primaryKeyPosition", len(keys) + 1)
        columns[name] = d
    description = raw.get("description")
    out: dict[str, Any] = {"apiVersion": "v1", "dataset": str(found.get("name") or raw.get("name") or raw.get("id")), "columns": columns}
    team = raw.get("team")
    members = team.get("members", []) if isinstance(team, dict) else team or []
    owner = next((t for t in members if str(t.get("role", "")).lower() == "owner"), members[0] if members else None)
    out |= {"owner": owner["username"]} if owner and owner.get("username") else {}
    if description:
        out["description"] = description.get("purpose", "") if isinstance(description, dict) else str(description)
    if raw.get("version") and extra.get("declaredVersion", True):
        out["version"] = str(raw["version"])
    if keys:
        out["primary_key"] = sorted(keys, key=keys.get)
    if checks := [f for q in found.get("quality") or [] if (f := _quality(q, None, notes)) is not None]:
        out["dataset_checks"] = checks
    out |= {k: extra[k] for k in ("consumers", "migration", "settings") if extra.get(k) is not None}
    for part in ("servers", "slaProperties", "support", "price", "roles"):
        if raw.get(part):
            notes.append(f"`{part}` has no counterpart and is left out")
    return parse_contract(yaml.safe_dump(out, sort_keys=False, allow_unicode=True)), notes


