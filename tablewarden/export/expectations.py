"""Row-level checks as pipeline expectations (SQL constraints, or Python dictionaries)."""

from __future__ import annotations

import re

from ..contract.model import Check, Contract, render

# Weaker shapes than the validators, for tools that only take a pattern: fixed values.
FORMAT_PATTERNS = {
    "email": "^[^@ ]+@[^@ ]+[.][^@ ]+$",
    "uuid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "iso_date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "iso_datetime": "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}",
    "url": "^https?://",
    "country_code_iso2": "^[A-Z]{2}$",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: object) -> str:
    return text_literal(value) if isinstance(value, str) else render(value)


def row_predicate(column: str, check: Check) -> str | None:
    """SQL that is true for rows that keep the check (nulls do); none if it is not about single rows."""
    c, p = quoted(column), check.params
    if check.kind in ("min", "max"):
        rule = f"{c} {'>=' if check.kind == 'min' else '<='} {render(p[check.kind])}"
    elif check.kind == "regex":
        rule = f"{c} RLIKE {text_literal(p['regex'])}"
    elif check.kind == "format":
        rule = f"{c} RLIKE {text_literal(FORMAT_PATTERNS[p['format']])}"
    elif check.kind == "enum":
        rule = f"{c} IN ({', '.join(map(literal, p['enum']))})" if p["enum"] else "FALSE"
    elif check.kind == "length":
        least, most = check.length_bounds()
        n = f"char_length({c})"
        rule = f"{n} = {least}" if least == most else f"{n} >= {least}" + (f" AND {n} <= {most}" if most is not None else "")
    elif check.kind == "not_empty_string":
        rule = f"{c} <> ''"
    else:
        return None
    return f"{c} IS NULL OR {rule}" if " AND " not in rule else f"{c} IS NULL OR ({rule})"


def expectations(contract: Contract) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """``(name, predicate, fails)`` of every row-level check, and what cannot be one."""
    found, left, used = [], [], set()

    def add(raw: str, predicate: str, fails: bool) -> None:
        base = re.sub(r"[^a-z0-9]", "_", raw.lower())
        base = base if base[:1].isalpha() or base[:1] == "_" else "c" + base
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        found.append((name, predicate, fails))

    for name, col in contract.columns.items():
        if col.required:
            add(f"{name}_not_null", f"{quoted(name)} IS NOT NULL", True)
        for check in col.checks:
            predicate = row_predicate(name, check)
            if predicate is None:
                left.append(f"{name}.{check.kind}")
            else:
                add(f"{name}_{check.kind}", predicate, check.severity == "error")
    if contract.primary_key:
        left.append("dataset.primary_key")
    return found, left + [f"dataset.{c.kind}" for c in contract.dataset_checks]


def _rest(left: list[str], mark: str) -> list[str]:
    return ["", f"{mark} Not about single rows; keep running these as checks:", *(f"{mark}   {x}" for x in left)] if left else []


def dlt_sql(contract: Contract) -> str:
    found, left = expectations(contract)
    lines = [f"-- Expectations of the contract {contract.dataset}. Errors stop the update, warnings are recorded."]
    lines += [f"CONSTRAINT {n} EXPECT ({p}){' ON VIOLATION FAIL UPDATE' if fails else ''}," for n, p, fails in found] or ["-- no row-level checks"]
    return "\n".join(lines + _rest(left, "--")) + "\n"


def dlt_python(contract: Contract) -> str:
    found, left = expectations(contract)
    lines = [f"# Expectations of the contract {contract.dataset}.", "import dlt", ""]
    for var, kind in (("expect_or_fail", True), ("expect", False)):
        lines += [f"{var} = {{", *(f"    {n!r}: {p!r}," for n, p, fails in found if fails == kind), "}", ""]
    function = re.sub(r"\W", "_", contract.dataset)
    lines += [f"@dlt.table(name={contract.dataset!r})", "@dlt.expect_all_or_fail(expect_or_fail)", "@dlt.expect_all(expect)", f"def {function}():", '    raise NotImplementedError("return the source frame here")']
    return "\n".join(lines + _rest(left, "#")) + "\n"
