"""A contract as a model's schema file, and the generic tests that it uses."""

from __future__ import annotations

from typing import Any

import yaml

from ..contract.model import Check, Contract, format_duration
from .expectations import FORMAT_PATTERNS

_TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp"}


def _with_severity(test: Any, check: Check, extra: dict[str, Any] | None = None) -> Any:
    config = {"config": {"severity": "warn"}} if check.severity == "warn" else {}
    if isinstance(test, str) and not extra and not config:
        return test
    return {test: (extra or {}) | config}


def _column_test(check: Check) -> Any:
    p = check.params
    if check.kind == "unique":
        return _with_severity("unique", check)
    if check.kind == "enum":
        quote = all(isinstance(v, str) for v in p["enum"])
        return _with_severity("accepted_values", check, {"values": p["enum"]} | ({} if quote else {"quote": False}))
    if check.kind == "format":
        return _with_severity("tablewarden.matches", check, {"pattern": FORMAT_PATTERNS[p["format"]]})
    if check.kind == "regex":
        return _with_severity("tablewarden.matches", check, {"pattern": p["regex"]})
    if check.kind == "length":
        least, most = check.length_bounds()
        return _with_severity("tablewarden.length_between", check, {"least": least} | ({"most": most} if most is not None else {}))
    if check.kind == "custom_expr":
        return _with_severity("tablewarden.row_expression", check, {"expression": p["expr"]})
    return _with_severity(f"tablewarden.{check.kind}", check, {{"min": "bound", "max": "bound"}.get(k, k): v for k, v in p.items()})


def _dataset_test(check: Check, key_of: dict[str, list[str]]) -> Any:
    p = check.params
    if check.kind == "references" and len(p["columns"]) == 1:
        return None  # a relationships test of its column
    if check.kind == "references":
        return _with_severity("tablewarden.references", check, {"columns": p["columns"], "to": f"ref('{p['dataset']}')", "to_columns": p["to"]})
    if check.kind == "freshness":
        return _with_severity("tablewarden.freshness", check, {"column": p["column"], "max_age_seconds": int(p["max_age"]), "shown_as": format_duration(p["max_age"])})
    if check.kind in ("assert", "custom_expr"):
        return _with_severity("tablewarden." + {"assert": "assert_expression", "custom_expr": "row_expression"}[check.kind], check, {"expression": p["expr"]})
    return _with_severity(f"tablewarden.{check.kind}", check, dict(p))


def schema_yml(contract: Contract) -> str:
    columns = []
    for name, col in contract.columns.items():
        tests: list[Any] = (["not_null"] if col.required else []) + [_column_test(c) for c in col.checks]
        for c in contract.dataset_checks:
            if c.kind == "references" and c["columns"] == [name]:
                tests.append(_with_severity("relationships", c, {"to": f"ref('{c['dataset']}')", "field": c["to"][0]}))
        meta = {k: v for k in ("pii", "classification", "sunset") if (v := getattr(col, k)) is not None} | ({"stability": col.stability} if col.stability != "stable" else {})
        d = {"name": name, "data_type": _TYPES[col.type]} | ({"description": col.description} if col.description else {}) | ({"meta": meta} if meta else {})
        columns.append(d | ({"data_tests": tests} if tests else {}))
    tests = [t for c in contract.dataset_checks if (t := _dataset_test(c, {})) is not None]
    if contract.primary_key:
        tests.insert(0, {"tablewarden.primary_key": {"columns": list(contract.primary_key)}})
    model: dict[str, Any] = {"name": contract.dataset} | ({"description": contract.description} if contract.description else {})
    model |= {"meta": {"owner": contract.owner}} if contract.owner else {}
    model |= ({"data_tests": tests} if tests else {}) | {"columns": columns}
    return yaml.safe_dump({"version": 2, "models": [model]}, sort_keys=False, allow_unicode=True, width=1000)


_ROW_TESTS = {
    "min": ("bound", "{{ column_name }} < {{ bound }}"),
    "max": ("bound", "{{ column_name }} > {{ bound }}"),
    "matches": ("pattern", "not ({{ column_name }} rlike '{{ pattern }}')"),
    "not_empty_string": ("", "{{ column_name }} = ''"),
    "length_between": ("least=0, most=none", "char_length({{ column_name }}) < {{ least }}{% if most is not none %} or char_length({{ column_name }}) > {{ most }}{% endif %}"),
    "row_expression": ("expression", "not coalesce(({{ expression }}), true)"),
}
_GROUP_TESTS = {
    "null_ratio_max": ("ratio, column=none", "select 1 from (select count(*) as n, count({{ column or column_name }}) as k from {{ model }}) where n > 0 and (n - k) > {{ ratio }} * n"),
    "unique_ratio_min": ("ratio, column=none", "select 1 from (select count({{ column or column_name }}) as n, count(distinct {{ column or column_name }}) as k from {{ model }}) where n > 0 and k < {{ ratio }} * n"),
    "row_count_min": ("count", "select 1 from (select count(*) as n from {{ model }}) where n < {{ count }}"),
    "row_count_max": ("count", "select 1 from (select count(*) as n from {{ model }}) where n > {{ count }}"),
    "freshness": ("column, max_age_seconds, shown_as=''", "select 1 from (select max({{ column }}) as newest from {{ model }}) where newest is null or unix_timestamp(current_timestamp()) - unix_timestamp(newest) > {{ max_age_seconds }}"),
    "assert_expression": ("expression", "select 1 from (select ({{ expression }}) as held from {{ model }}) where not coalesce(held, false)"),
    "primary_key": ("columns", "select {{ columns | join(', ') }} from {{ model }} group by {{ columns | join(', ') }} having count(*) > 1 or {{ columns | join(' is null or ') }} is null"),
    "references": ("columns, to, to_columns", "select 1 from {{ model }} a where {{ 'a.' ~ columns | join(' is not null and a.') }} is not null and not exists (select 1 from {{ to }} b where {% for c in columns %}{{ 'and ' if not loop.first }}a.{{ c }} = b.{{ to_columns[loop.index0] }} {% endfor %})"),
}


def generic_tests() -> dict[str, str]:
    """The macro files of the generic tests, by file name."""
    out = {}
    for name, (args, bad) in _ROW_TESTS.items():
        column = "column_name=none" if name == "row_expression" else "column_name"
        signature = ", ".join(x for x in ("model", column, args) if x) if name != "row_expression" else "model, expression, column_name=none"
        guard = "" if name == "row_expression" else "{{ column_name }} is not null and "
        out[f"{name}.sql"] = f"{{% test {name}({signature}) %}}\nselect * from {{{{ model }}}} where {guard}({bad})\n{{% endtest %}}\n"
    for name, (args, sql) in _GROUP_TESTS.items():
        extra = ", column_name=none" if "column=none" in args else ""
        out[f"{name}.sql"] = f"{{% test {name}(model, {args}{extra}) %}}\n{sql}\n{{% endtest %}}\n"
    return out
