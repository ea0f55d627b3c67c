"""The planner: every check becomes aggregate slots and a way to read its outcome from them.

All slots are evaluated by one aggregation without distinct terms, so the data are read once and hardly
shuffled. Exact distinct counts, key checks and lookups get grouped jobs of their own (see
``operators.execute``); what can be decided from the schema is decided here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract.model import Check, Contract, number, render
from ..functions.formats import bad_format
from ..functions.patterns import java_pattern
from ..functions.typed import accepts, as_text, native, nested_kind, parse_text, sketched


class NestedColumnError(ValueError):
    """A declared column holds lists or records, which contracts do not describe."""

    def __init__(self, column: str, kind: str) -> None:
        self.column, self.kind = column, kind
        super().__init__(f"the column `{column}` holds {kind} values; flatten it before checking")


def name_of(column: str) -> Expr:
    return F.col("`" + column.replace("`", "``") + "`")


@dataclass
class Cells:
    """One declared column as expressions: its text, its typed value, and whether its type fits at all."""

    raw: Expr
    typed: Expr
    structural: bool
    dtype: str


@dataclass
class Outcome:
    failed: bool
    rows_evaluated: int | None = None
    rows_failed: int | None = None
    observed: dict[str, Any] = field(default_factory=dict)
    message: str | None = None


Values = dict[str, Any]


@dataclass
class Planned:
    """A check with its place in the report. One of: decided already, read from slots, or a job kind."""

    id: str
    column: str | None
    kind: str
    params: dict[str, Any]
    severity: str
    fixed: Outcome | None = None
    read: Callable[[Values], Outcome] | None = None
    bad: Expr | None = None  # rows to sample when the check fails
    value: Expr | None = None  # what a sample shows
    job: tuple[str, Any] | None = None
    user_slots: tuple[str, ...] = ()


class Slots:
    """Aggregate expressions by what they say, each computed once."""

    def __init__(self) -> None:
        self.by_text: dict[str, str] = {}
        self.expressions: dict[str, Expr] = {}
        self.sketches: set[str] = set()

    def add(self, expression: Expr, sketch: bool = False) -> str:
        text = str(expression)
        if text not in self.by_text:
            self.by_text[text] = f"s{len(self.by_text)}"
            self.expressions[self.by_text[text]] = expression
            if sketch:
                self.sketches.add(self.by_text[text])
        return self.by_text[text]

    def rows(self) -> str:
        return self.add(F.count(F.lit(1)))

    def count(self, c: Expr) -> str:
        return self.add(F.count(c))

    def count_if(self, condition: Expr) -> str:
        return self.add(F.count(F.when(condition, F.lit(1))))


def cannot_run(why: str) -> Outcome:
    return Outcome(True, message=f"the check could not run: {why}")


def humanised(seconds: float) -> str:
    hours, days = seconds / 3600, seconds / 86400
    if seconds and hours == int(hours) and (hours <= 72 or days != int(days)):
        return f"{int(hours)}h"
    return f"{int(days)}d" if seconds and days == int(days) else f"{int(seconds)}s"


class Planner:
    def __init__(self, contract: Contract, frame: DataFrame, typed: bool, now_micros: int, references: dict[str, Any] | None = None, fail_on_unknown_freshness: bool = False, ahead: bool = False) -> None:
        """``ahead``: the caller adds ``parsed`` to the frame, so that a cell which many checks use is parsed once."""
        self.parsed: dict[str, Expr] = {}
        self.ahead = ahead
        self.contract, self.frame, self.typed, self.now = contract, frame, typed, now_micros
        self.references, self.strict_freshness = references or {}, fail_on_unknown_freshness
        self.slots, self.checks = Slots(), []
        self.types = {f.name: f.dataType for f in frame.schema.fields}
        for name in contract.columns:
            if name in self.types and (kind := nested_kind(self.types[name])):
                raise NestedColumnError(name, kind)
        self.cells = {name: self._cells(name) for name in contract.columns if name in self.types}

    def _cells(self, name: str) -> Cells:
        kind, given, c = self.contract.columns[name].type, self.types[name], name_of(name)
        if not self.typed:
            text = as_text(c, given)
            value = parse_text(text, kind)
            if self.ahead and kind != "string":
                place = f"__parsed{len(self.parsed)}"
                self.parsed[place], value = value, F.col(place)
            return Cells(text, value, False, "string")
        fits = accepts(kind, given)
        return Cells(as_text(c, given), native(c, kind, given) if fits else F.lit(None), not fits, given.simpleString())

    def plan(self) -> list[Planned]:
        self.slots.rows()
        self._columns()
        for name, col in self.contract.columns.items():
            if name not in self.cells:
                self.checks.append(Planned(f"{name}.present", name, "column_present", {}, "error", fixed=Outcome(True, message=f"the column `{name}` is declared but absent")))
                continue
            self._type(name)
            if col.required:
                self._required(name)
            for check in col.checks:
                self._column_check(name, check)
        if self.contract.primary_key:
            self._primary_key()
        for check in self.contract.dataset_checks:
            self._dataset_check(check)
        return self.checks

    # schema

    def _columns(self) -> None:
        s, declared = self.contract.settings, list(self.contract.columns)
        extra = sorted(set(self.types) - set(declared))
        missing = [c for c in declared if c not in self.types]
        failed = bool(extra) and (s.columns_exact or not s.allow_extra_columns) or bool(missing) and s.columns_exact
        observed: dict[str, Any] = {"declared_columns": len(declared)}
        observed |= {"extra_columns": extra} if extra else {}
        observed |= {"missing_columns": missing} if missing else {}
        words = [f"{what}: {', '.join(names)}" for what, names in (("not declared", extra), ("missing", missing)) if names]
        params = {"allow_extra_columns": s.allow_extra_columns, "columns_exact": s.columns_exact}
        self.checks.append(Planned("dataset.columns", None, "columns", params, "error", fixed=Outcome(failed, observed=observed, message="; ".join(words) if failed else None)))

    def _type(self, name: str) -> None:
        kind, cells, severity = self.contract.columns[name].type, self.cells[name], self.contract.settings.on_type_mismatch
        base = (f"{name}.type", name, "type", {"type": kind}, severity)
        if cells.structural:
            self.checks.append(Planned(*base, fixed=Outcome(True, observed={"observed_type": cells.dtype}, message=f"the column holds {cells.dtype}, not {kind}")))
        elif self.typed or kind == "string":
            self._counted(base, cells.raw, F.lit(False), cells.raw)
        else:
            self._counted(base, cells.raw, cells.typed.isNull(), cells.raw)

    def _required(self, name: str) -> None:
        c = name_of(name)
        rows, full = self.slots.rows(), self.slots.count(c)
        read = lambda v: _ratio_outcome(v[rows], v[rows] - v[full], "null values")
        self.checks.append(Planned(f"{name}.required", name, "required", {"required": True}, "error", read=read, bad=c.isNull(), value=F.lit("(null)")))

    # values

    def _counted(self, base: tuple, subject: Expr, bad: Expr, value: Expr, extra: Callable[[Values], tuple[dict, str | None]] | None = None) -> None:
        """Count the bad ones among rows whose subject is not null."""
        condition = subject.isNotNull() & bad
        evaluated, failed = self.slots.count(subject), self.slots.count_if(condition)

        def read(v: Values) -> Outcome:
            out = _ratio_outcome(v[evaluated], v[failed], f"values fail `{base[2]}`")
            if extra:
                more, message = extra(v)
                out.observed |= more
                out.message = message if out.failed and message else out.message
            return out

        self.checks.append(Planned(*base, read=read, bad=condition, value=value))

    def _column_check(self, name: str, check: Check) -> None:
        cells, kind = self.cells[name], check.kind
        base = (f"{name}.{kind}", name, kind, dict(check.params), check.severity)
        if kind == "unique":
            self._unique(base, cells, check["approx"])
        elif kind in ("min", "max"):
            self._bound(base, cells, check)
        elif kind == "regex":
            try:
                pattern = java_pattern(check["regex"])
            except ValueError as e:
                self.checks.append(Planned(*base, fixed=cannot_run(str(e))))
                return
            self._counted(base, cells.raw, ~cells.raw.rlike(pattern), cells.raw)
        elif kind == "enum":
            texts = [render(x) for x in check["enum"]]
            self._counted((*base[:3], {"enum": texts}, base[4]), cells.raw, ~cells.raw.isin(*texts) if texts else F.lit(True), cells.raw)
        elif kind == "length":
            least, most = check.length_bounds()
            n = F.char_length(cells.raw)
            params = check.params if isinstance(check["length"], int) else {"min": check["length"].get("min"), "max": check["length"].get("max")}
            self._counted((*base[:3], params, base[4]), cells.raw, (n < least) | (n > most) if most is not None else n < least, cells.raw)
        elif kind == "not_empty_string":
            self._counted(base, cells.raw, cells.raw == "", cells.raw)
        elif kind == "format":
            self._counted((f"{name}.format.{check['format']}", *base[1:]), cells.raw, bad_format(cells.raw, check["format"]), cells.raw)
        elif kind == "null_ratio_max":
            self._null_ratio(base, name, check["ratio"])
        elif kind == "unique_ratio_min":
            self._unique_ratio(base, name, check["ratio"])
        else:
            self._custom(base, check["expr"])

    def _unique(self, base: tuple, cells: Cells, approx: bool) -> None:
        full = self.slots.count(cells.raw)
        if not approx:
            self.checks.append(Planned(*base, job=("distinct", cells.raw), bad=cells.raw.isNotNull(), value=cells.raw, read=lambda v: _unique_outcome(v[full], v["distinct"])))
            return
        sketch = self.slots.add(sketched(cells.raw), sketch=True)

        def read(v: Values) -> Outcome:
            estimate, n = min(v[sketch], v[full]), v[full]
            failed = estimate < int(n * 0.98)
            return Outcome(failed, n, None, {"distinct_estimate": estimate, "approx": True}, f"about {estimate} different values in {n}" if failed else None)

        self.checks.append(Planned(*base, read=read))

    def _bound(self, base: tuple, cells: Cells, check: Check) -> None:
        kind = self.contract.columns[base[1]].type
        if kind == "date":
            subject = F.unix_date(cells.typed.cast("date")).cast("double")
        elif kind == "datetime":
            subject = F.unix_micros(cells.typed.cast("timestamp")).cast("double")
        else:
            subject = cells.typed.cast("double")
        limit = F.lit(float(check[check.kind]))
        bad, edge = (subject < limit, F.min) if check.kind == "min" else (subject > limit, F.max)
        slot = self.slots.add(edge(subject))

        def extra(v: Values) -> tuple[dict, str | None]:
            if v[slot] is None:
                return {}, None
            return {f"{check.kind}_observed": number(v[slot])}, f"{check.kind} observed: {render(v[slot])}"

        self._counted(base, subject, bad, cells.raw, extra)

    def _null_ratio(self, base: tuple, name: str, most: float) -> None:
        c = name_of(name)
        rows, full = self.slots.rows(), self.slots.count(c)

        def read(v: Values) -> Outcome:
            nulls = v[rows] - v[full]
            ratio = nulls / v[rows] if v[rows] else 0.0
            return Outcome(ratio > most, v[rows], nulls, {"null_ratio": number(ratio)}, f"null ratio {ratio:.4f} is above {most}" if ratio > most else None)

        self.checks.append(Planned(*base, read=read))

    def _unique_ratio(self, base: tuple, name: str, least: float) -> None:
        raw = self.cells[name].raw
        full = self.slots.count(raw)

        def read(v: Values) -> Outcome:
            ratio = v["distinct"] / v[full] if v[full] else 1.0
            return Outcome(ratio < least, v[full], None, {"unique_ratio": number(ratio), "distinct_count": v["distinct"]}, f"unique ratio {ratio:.4f} is below {least}" if ratio < least else None)

        self.checks.append(Planned(*base, job=("distinct", raw), read=read))

    def _custom(self, base: tuple, text: str) -> None:
        """A user's row expression: false fails, null passes; one that does not analyse fails alone."""
        try:
            kind = self.frame.select(F.expr(text).alias("v")).schema["v"].dataType.simpleString()
            if kind != "boolean":
                raise ValueError(f"the expression gives {kind}, not true or false")
        except Exception as e:  # noqa: BLE001  the analyser's own words go into the report
            self.checks.append(Planned(*base, fixed=cannot_run(_first_line(e))))
            return
        bad = ~F.coalesce(F.expr(text), F.lit(True))
        rows, failed = self.slots.rows(), self.slots.count_if(bad)
        read = lambda v: _ratio_outcome(v[rows], v[failed], "rows fail the expression")
        self.checks.append(Planned(*base, read=read, bad=bad, value=F.lit(""), user_slots=(failed,)))

    # dataset

    def _primary_key(self) -> None:
        key = self.contract.primary_key
        base = ("dataset.primary_key", None, "primary_key", {"columns": list(key)}, "error")
        if absent := [c for c in key if c not in self.cells]:
            self.checks.append(Planned(*base, fixed=cannot_run(f"key column missing: {', '.join(absent)}")))
            return
        self.checks.append(Planned(*base, job=("primary_key", list(key))))

    def _dataset_check(self, check: Check) -> None:
        kind, p = check.kind, check.params
        if kind in ("row_count_min", "row_count_max"):
            rows = self.slots.rows()

            def read(v: Values) -> Outcome:
                failed = v[rows] < p["count"] if kind == "row_count_min" else v[rows] > p["count"]
                return Outcome(failed, observed={"row_count": v[rows]}, message=f"{v[rows]} rows, the bound is {p['count']}" if failed else None)

            self.checks.append(Planned(f"dataset.{kind}", None, kind, {"count": p["count"]}, check.severity, read=read))
        elif kind == "custom_expr":
            self._custom(("dataset.custom_expr", None, kind, {"expr": p["expr"]}, check.severity), p["expr"])
        elif kind == "assert":
            self.checks.append(Planned("dataset.assert", None, kind, {"expr": p["expr"]}, check.severity, job=("assert", p["expr"])))
        elif kind == "references":
            self._references(check)
        else:
            name = p["column"]
            base = (f"dataset.{kind}.{name}", None, kind, dict(p), check.severity)
            if kind == "freshness":
                base = (*base[:3], {"column": name, "max_age": humanised(p["max_age"]), "max_age_secs": int(p["max_age"])}, base[4])
            if name not in self.cells:
                self.checks.append(Planned(*base, fixed=cannot_run(f"the column `{name}` is absent")))
            elif kind == "null_ratio_max":
                self._null_ratio(base, name, p["ratio"])
            elif kind == "unique_ratio_min":
                self._unique_ratio(base, name, p["ratio"])
            else:
                self._freshness(base, name, p["max_age"])

    def _freshness(self, base: tuple, name: str, max_age: float) -> None:
        typed = self.cells[name].typed
        micros = F.unix_date(typed.cast("date")).cast("long") * 86_400_000_000 if self.contract.columns[name].type == "date" else F.unix_micros(typed.cast("timestamp"))
        newest = self.slots.add(F.max(micros))

        def read(v: Values) -> Outcome:
            if v[newest] is None:
                return Outcome(self.strict_freshness, message="no readable value to judge freshness by" if self.strict_freshness else None)
            age = (self.now - v[newest]) / 1_000_000
            failed = age > max_age
            return Outcome(failed, observed={"age_hours": number(round(age / 3600, 6))}, message=f"the newest value is {age / 3600:.1f} h old; at most {humanised(max_age)} is allowed" if failed else None)

        self.checks.append(Planned(*base, read=read))

    def _references(self, check: Check) -> None:
        p = check.params
        base = (f"dataset.references.{p['dataset']}", None, "references", dict(p), check.severity)
        keys = self.references.get(p["dataset"])
        if absent := [c for c in p["columns"] if c not in self.cells]:
            self.checks.append(Planned(*base, fixed=cannot_run(f"the column `{absent[0]}` is absent")))
        elif keys is None:
            self.checks.append(Planned(*base, fixed=cannot_run(f"no keys of `{p['dataset']}` were given")))
        elif list(keys.columns) != list(p["to"]):
            self.checks.append(Planned(*base, fixed=cannot_run(f"keys of `{p['dataset']}` are by {', '.join(keys.columns)}, not {', '.join(p['to'])}")))
        else:
            self.checks.append(Planned(*base, job=("references", (list(p["columns"]), keys))))


def _ratio_outcome(evaluated: int, failed: int, what: str) -> Outcome:
    observed = {"fail_ratio": number(failed / evaluated)} if evaluated else {"fail_ratio": 0}
    return Outcome(failed > 0, evaluated, failed, observed, f"{failed} of {evaluated} {what}" if failed else None)


def _unique_outcome(full: int, distinct: int) -> Outcome:
    repeats = full - distinct
    observed: dict[str, Any] = {"fail_ratio": number(repeats / full) if full else 0, "distinct_count": distinct}
    if distinct >= 10_000_000:
        observed["hint"] = "consider `unique: {approx: true}` for a column of this size"
    return Outcome(repeats > 0, full, repeats, observed, f"{repeats} repeated values" if repeats else None)


def _first_line(e: Exception) -> str:
    return str(e).strip().split("\n")[0]
