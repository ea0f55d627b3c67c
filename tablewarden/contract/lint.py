"""Findings about a contract that reads well but cannot mean what it says. All are reported together."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..functions.patterns import RegexError, java_pattern
from . import model as m
from .model import Check, Column, Contract, did_you_mean


@dataclass(frozen=True)
class Finding:
    severity: str
    path: str
    message: str


class _Findings(list):
    def error(self, path: str, message: str) -> None:
        self.append(Finding("error", path, message))

    def warn(self, path: str, message: str) -> None:
        self.append(Finding("warning", path, message))


#: Input options and the formats they apply to.
APPLIES = {
    "delimiter": ("csv", "tsv"),
    "json_path": ("json",),
    "sheet": ("excel",),
    "xml_record": ("xml",),
    "has_header": ("csv", "tsv", "excel", "fixed_width"),
    "skip_rows": ("csv", "tsv", "excel", "fixed_width"),
    "fixed_width": ("fixed_width",),
}


def lint(contract: Contract) -> list[Finding]:
    out = _Findings()
    _top(contract, out)
    _input(contract, out)
    _consumers(contract, out)
    for column in contract.columns.values():
        _column(column, out)
    for i, check in enumerate(contract.dataset_checks):
        _dataset_check(contract, check, f"dataset_checks[{i}]", out)
    _primary_key(contract, out)
    return list(out)


def errors(findings: list[Finding]) -> list[Finding]:
    return [f for f in findings if f.severity == "error"]


def _top(c: Contract, out: _Findings) -> None:
    if not c.columns:
        out.error("columns", "the contract declares no columns")
    if c.migration:
        if not m.is_date(c.migration.window_ends):
            out.error("migration.window_ends", f"`{c.migration.window_ends}` is not a date (YYYY-MM-DD)")
        if not (c.migration.note or "").strip():
            out.warn("migration.note", "the window says until when, but not what readers should do")
    if c.settings.columns_exact and c.settings.allow_extra_columns:
        out.warn("settings.columns_exact", "`columns_exact` already forbids what `allow_extra_columns` allows")


def _input(c: Contract, out: _Findings) -> None:
    i = c.settings.input
    if i.delimiter is not None and len(i.delimiter) != 1:
        out.error("settings.input.delimiter", "the delimiter must be one character")
    for name, formats in APPLIES.items():
        if i.format and getattr(i, name) not in (None, (), []) and i.format not in formats:
            out.error(f"settings.input.{name}", f"`{name}` does not apply to the format `{i.format}`")
    if i.format == "fixed_width" and not i.fixed_width:
        out.error("settings.input.fixed_width", "the format fixed_width needs a layout")
    if i.fixed_width:
        _layout(c, out)


def _layout(c: Contract, out: _Findings) -> None:
    """Fields stand on the line in the order of the layout. Each is judged on all counts; where the next may begin
    follows from the end that a field gives, or stays where it is if none is given."""
    named: dict[str, int] = {}
    free = 1
    for k, f in enumerate(c.settings.input.fixed_width):
        path = f"settings.input.fixed_width[{k}]"
        if not f.name.strip():
            out.error(f"{path}.name", "a field needs a name")
        if f.name in named:
            out.error(f"{path}.name", f"the field `{f.name}` stands here a second time, first as field [{named[f.name]}]")
        named[f.name] = k
        start = free if f.start is None else f.start
        if start == 0:
            out.error(f"{path}.start", "places count from 1")
        if start < free:
            out.error(f"{path}.start", f"the field `{f.name}` overlaps what stands before it, or is out of order (next free place: {free})")
        if f.end is None and f.width is None:
            out.error(path, f"the field `{f.name}` needs either `end` or `width`")
            continue
        if f.end is not None and f.width is not None:
            out.error(f"{path}.width", f"the field `{f.name}` needs either `end` or `width`, not both")
        elif f.end is not None and f.end < start:
            out.error(f"{path}.end", f"the field `{f.name}` ends before it starts")
        elif f.width == 0:
            out.error(f"{path}.width", "a width of 0 reads nothing")
        end = f.end if f.end is not None else start + max(f.width - 1, 0)
        free = max(end, start) + 1
    for name in c.columns:
        if name not in named:
            out.warn(f"columns.{name}", f"the layout has no field for the column `{name}`")


def _consumers(c: Contract, out: _Findings) -> None:
    for i, consumer in enumerate(c.consumers):
        path = f"consumers[{i}]"
        if not consumer.name.strip():
            out.error(f"{path}.name", "a consumer needs a name")
        if consumer.tier is not None and consumer.tier not in (1, 2, 3):
            out.error(f"{path}.tier", "a tier is 1, 2 or 3")
        first: dict[str, int] = {}
        for j, name in enumerate(consumer.reads or ()):
            if first.setdefault(name, j) < j:
                out.warn(f"{path}.reads[{j}]", f"`{name}` is listed twice (first at reads[{first[name]}])")
            elif name not in c.columns:
                out.error(f"{path}.reads[{j}]", f"`{name}` is not a declared column{did_you_mean(name, tuple(c.columns))}")


def _column(col: Column, out: _Findings) -> None:
    path = f"columns.{col.name}"
    if col.sunset is not None and not m.is_date(col.sunset):
        out.error(f"{path}.sunset", f"`{col.sunset}` is not a date (YYYY-MM-DD)")
    if col.sunset is not None and col.stability != "deprecated":
        out.warn(f"{path}.stability", "a sunset on a column that is not deprecated")
    if col.stability == "deprecated":
        if col.sunset is None:
            out.warn(f"{path}.sunset", "deprecated, but no sunset says until when")
        if col.required:
            out.warn(f"{path}.required", "deprecated, but still required")
    first: dict[str, int] = {}
    bounds: dict[str, tuple[str, float]] = {}
    for k, check in enumerate(col.checks):
        where = f"{path}.checks[{k}]"
        if first.setdefault(check.kind, k) < k and check.kind not in ("regex", "custom_expr"):
            out.error(where, f"`{check.kind}` can stand only once in a column (first at checks[{first[check.kind]}])")
        if check.kind in ("min", "max"):
            bound = float(check[check.kind])
            if not math.isfinite(bound):
                out.error(where, "a bound must be finite")
            if col.type not in m.ORDERED_TYPES:
                out.error(where, f"`{check.kind}` has no meaning for the type {col.type}")
            bounds.setdefault(check.kind, (where, bound))
        elif check.kind == "regex":
            try:
                java_pattern(check["regex"])
            except RegexError as e:
                out.error(where, str(e))
        elif check.kind == "enum" and not check["enum"]:
            out.error(where, "an empty list lets no value pass")
        elif check.kind == "length":
            if check["length"] == {}:
                out.error(where, "`length` needs a bound")
            least, most = check.length_bounds()
            if most is not None and least > most:
                out.error(where, f"min {least} is above max {most}")
        elif check.kind == "format" and col.type != "string":
            out.error(where, f"`format` applies to text, not to the type {col.type}")
        elif check.kind in ("null_ratio_max", "unique_ratio_min"):
            _ratio(check, where, out)
    if len(bounds) == 2 and bounds["min"][1] > bounds["max"][1]:
        out.error(bounds["max"][0], f"min {m.render(bounds['min'][1])} is above max {m.render(bounds['max'][1])}")


def _ratio(check: Check, path: str, out: _Findings) -> None:
    if not 0 <= check["ratio"] <= 1:
        out.error(path, "a ratio lies between 0 and 1")


def _dataset_check(c: Contract, check: Check, path: str, out: _Findings) -> None:
    known = tuple(c.columns)
    if check.kind in ("freshness", "null_ratio_max", "unique_ratio_min"):
        name = check["column"]
        if name not in c.columns:
            out.error(path, f"`{name}` is not a declared column{did_you_mean(name, known)}")
        elif check.kind == "freshness" and c.columns[name].type not in m.TEMPORAL_TYPES:
            out.error(path, f"freshness needs a date or datetime; `{name}` is {c.columns[name].type}")
        if check.kind != "freshness":
            _ratio(check, path, out)
    elif check.kind == "references":
        for name in check["columns"]:
            if name not in c.columns:
                out.error(path, f"`{name}` is not a declared column{did_you_mean(name, known)}")
        for name in _again(check["columns"]):
            out.error(path, f"`{name}` stands twice in the key")
        if check["dataset"] == c.dataset and check["to"] == check["columns"]:
            out.warn(path, "this references the key by itself, which always holds")


def _again(names) -> list[str]:
    """Every name that has stood before, once for each time."""
    return [n for k, n in enumerate(names) if n in names[:k]]


def _primary_key(c: Contract, out: _Findings) -> None:
    for name in c.primary_key:
        if name not in c.columns:
            out.error("primary_key", f"`{name}` is not a declared column{did_you_mean(name, tuple(c.columns))}")
    for name in _again(c.primary_key):
        out.error("primary_key", f"`{name}` stands twice in the key")
