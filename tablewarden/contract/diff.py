"""Differences between two versions of a contract, by what they mean for readers downstream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .model import Check, Column, Contract, format_duration, render

BREAKING, SEMANTIC, NON_BREAKING, COSMETIC = "breaking", "semantic", "non_breaking", "cosmetic"
IMPACTS = (BREAKING, SEMANTIC, NON_BREAKING, COSMETIC)

TIGHTER, LOOSER, OTHER, SAME = "tightened", "loosened", "changed", "same"


@dataclass(frozen=True)
class Change:
    impact: str
    path: str
    description: str


def diff(old: Contract, new: Contract) -> list[Change]:
    """All changes, top level first, then columns in the old order, key, dataset checks and settings."""
    out: list[Change] = []
    say = lambda impact, path, text: out.append(Change(impact, path, text))
    if old.dataset != new.dataset:
        say(BREAKING, "dataset", f"dataset renamed from {old.dataset} to {new.dataset}")
    _edited(say, "owner", old.owner, new.owner, COSMETIC)
    _definition(say, "description", old.description, new.description)
    _edited(say, "version", old.version, new.version, COSMETIC)
    if old.consumers != new.consumers:
        say(COSMETIC, "consumers", "the list of consumers was edited")
    _migration(say, old, new)
    for name, col in old.columns.items():
        if name not in new.columns:
            told = f" (announced for {col.sunset})" if col.sunset else ""
            say(BREAKING, f"columns.{name}", f"column removed{told}")
        else:
            _column(say, col, new.columns[name])
    for name, col in new.columns.items():
        if name not in old.columns:
            say(BREAKING if col.required else NON_BREAKING, f"columns.{name}", f"{'required' if col.required else 'optional'} column added")
    if old.primary_key != new.primary_key:
        if not new.primary_key:
            say(NON_BREAKING, "primary_key", "primary key removed")
        else:
            what = f"changed from [{', '.join(old.primary_key)}] to" if old.primary_key else "declared:"
            say(BREAKING, "primary_key", f"primary key {what} [{', '.join(new.primary_key)}]")
    _checks(say, "dataset_checks", old.dataset_checks, new.dataset_checks, _dataset_key)
    _settings(say, old, new)
    return out


def worst(changes: list[Change]) -> str | None:
    return min((c.impact for c in changes), key=IMPACTS.index, default=None)


def _edited(say, path: str, a: Any, b: Any, impact: str) -> None:
    if a != b:
        say(impact, path, f"{path.rpartition('.')[2]} set to {b}" if a is None else f"{path.rpartition('.')[2]} {a} removed" if b is None else f"{path.rpartition('.')[2]} changed from {a} to {b}")


def _definition(say, path: str, a: str | None, b: str | None) -> None:
    if a != b:
        say(COSMETIC if a is None else SEMANTIC, path, "definition written" if a is None else "definition removed" if b is None else "definition changed")


def _deadline(say, path: str, what: str, a: str, b: str) -> None:
    """ISO dates order as text."""
    if a != b:
        say(BREAKING if b < a else NON_BREAKING, path, f"{what} moved {'forward' if b < a else 'back'} from {a} to {b}")


def _migration(say, old: Contract, new: Contract) -> None:
    a, b = old.migration, new.migration
    if a is None and b is not None:
        say(NON_BREAKING, "migration", f"migration window until {b.window_ends} added")
    elif a is not None and b is None:
        say(COSMETIC, "migration", "migration window removed")
    elif a is not None:
        _deadline(say, "migration.window_ends", "end of the migration window", a.window_ends, b.window_ends)
        if a.note != b.note:
            say(COSMETIC, "migration.note", "migration note edited")


def _column(say, a: Column, b: Column) -> None:
    path = f"columns.{a.name}"
    if a.type != b.type:
        say(BREAKING, f"{path}.type", f"type changed from {a.type} to {b.type}")
    if a.required != b.required:
        say(BREAKING if b.required else NON_BREAKING, f"{path}.required", "required added" if b.required else "required dropped")
    _definition(say, f"{path}.description", a.description, b.description)
    if a.pii != b.pii:
        # that nothing personal is held is first said; taking it back leaves readers without the assurance
        said = a.pii is None and b.pii == "none"
        say(COSMETIC if said else SEMANTIC, f"{path}.pii", f"pii changed from {a.pii or 'undeclared'} to {b.pii or 'undeclared'}")
    if a.classification != b.classification:
        say(COSMETIC if a.classification is None else SEMANTIC, f"{path}.classification", f"classification changed from {a.classification or 'undeclared'} to {b.classification or 'undeclared'}")
    if a.stability != b.stability:
        order = ("stable", "beta", "deprecated")
        say(SEMANTIC if order.index(b.stability) > order.index(a.stability) else NON_BREAKING, f"{path}.stability", f"stability changed from {a.stability} to {b.stability}")
    if a.sunset is None and b.sunset is not None:
        say(SEMANTIC, f"{path}.sunset", f"sunset announced for {b.sunset}")
    elif a.sunset is not None and b.sunset is None:
        say(NON_BREAKING, f"{path}.sunset", f"sunset {a.sunset} withdrawn")
    elif a.sunset is not None:
        _deadline(say, f"{path}.sunset", "sunset", a.sunset, b.sunset)
    _checks(say, f"{path}.checks", a.checks, b.checks, lambda c: c.kind)


def _dataset_key(check: Check) -> str:
    p = check.params
    target = {"freshness": "column", "null_ratio_max": "column", "unique_ratio_min": "column", "custom_expr": "expr", "assert": "expr"}.get(check.kind)
    if check.kind == "references":
        return f"references.{p['dataset']}.{','.join(p['columns'])}"
    return f"{check.kind}.{p[target]}" if target else check.kind


def _checks(say, path: str, old: tuple[Check, ...], new: tuple[Check, ...], key: Callable[[Check], str]) -> None:
    """Checks that stand once on each side are compared; others are removals and additions."""
    groups: dict[str, tuple[list[Check], list[Check]]] = {}
    for side, checks in enumerate((old, new)):
        for c in checks:
            groups.setdefault(key(c), ([], []))[side].append(c)
    for name, (a, b) in groups.items():
        if len(a) == len(b) == 1:
            _compared(say, f"{path}[{name}]", a[0], b[0])
            continue
        for c in a:
            if c not in b:
                say(NON_BREAKING, f"{path}[{name}]", "check removed")
        for c in b:
            if c not in a:
                say(BREAKING if c.severity == "error" else NON_BREAKING, f"{path}[{name}]", f"check added at severity {c.severity}")


def _compared(say, path: str, a: Check, b: Check) -> None:
    relation, text = relate(a, b)
    if a.severity != b.severity:
        to_error = b.severity == "error"
        moved = f"severity {'raised to error' if to_error else 'lowered to warn'}"
        say(BREAKING if to_error else NON_BREAKING, path, moved if relation == SAME else f"{text}; {moved}")
    elif relation != SAME:
        say(BREAKING if relation in (TIGHTER, OTHER) and b.severity == "error" else NON_BREAKING, path, text)


def _ordered(up_is_tighter: bool, a: float, b: float, what: str, show: Callable[[Any], str] = render) -> tuple[str, str]:
    if a == b:
        return SAME, ""
    return (TIGHTER if (b > a) == up_is_tighter else LOOSER), f"{what} {'raised' if b > a else 'lowered'} from {show(a)} to {show(b)}"


def _length(a: Check, b: Check) -> tuple[str, str]:
    (a_least, a_most), (b_least, b_most) = a.length_bounds(), b.length_bounds()
    top = lambda x: float("inf") if x is None else x
    tighter, looser = b_least > a_least or top(b_most) < top(a_most), b_least < a_least or top(b_most) > top(a_most)
    if not tighter and not looser:
        return SAME, ""
    return (OTHER if tighter and looser else TIGHTER if tighter else LOOSER), f"length bounds {'moved' if tighter and looser else 'narrowed' if tighter else 'widened'}"


def _enum(a: Check, b: Check) -> tuple[str, str]:
    before, after = Counter(map(repr, a["enum"])), Counter(map(repr, b["enum"]))
    lost, gained = before.keys() - after.keys(), after.keys() - before.keys()
    if not lost and not gained:
        return SAME, ""
    return (OTHER if lost and gained else TIGHTER if lost else LOOSER), f"allowed values: {len(lost)} removed, {len(gained)} added"


def relate(a: Check, b: Check) -> tuple[str, str]:
    """How the parameters of a check moved."""
    p, q, kind = a.params, b.params, a.kind
    if kind in ("min", "row_count_min", "unique_ratio_min"):
        name = {"min": "min", "row_count_min": "count", "unique_ratio_min": "ratio"}[kind]
        return _ordered(True, p[name], q[name], kind)
    if kind in ("max", "row_count_max", "null_ratio_max"):
        name = {"max": "max", "row_count_max": "count", "null_ratio_max": "ratio"}[kind]
        return _ordered(False, p[name], q[name], kind)
    if kind == "freshness":
        return _ordered(False, p["max_age"], q["max_age"], "max_age", format_duration)
    if kind == "length":
        return _length(a, b)
    if kind == "enum":
        return _enum(a, b)
    if kind == "unique":
        return (SAME, "") if p == q else (TIGHTER, "unique became exact") if p["approx"] else (LOOSER, "unique became approximate")
    if p == q:
        return SAME, ""
    return OTHER, f"{kind} changed from {next(iter(p.values()))} to {next(iter(q.values()))}" if kind != "references" else f"the referenced key changed from [{', '.join(p['to'])}] to [{', '.join(q['to'])}]"


def _settings(say, old: Contract, new: Contract) -> None:
    a, b = old.settings, new.settings
    if a.allow_extra_columns != b.allow_extra_columns:
        say(NON_BREAKING if b.allow_extra_columns else BREAKING, "settings.allow_extra_columns", f"extra columns {'allowed' if b.allow_extra_columns else 'disallowed'}")
    if a.columns_exact != b.columns_exact:
        say(BREAKING if b.columns_exact else NON_BREAKING, "settings.columns_exact", f"exact columns {'demanded' if b.columns_exact else 'no longer demanded'}")
    if a.on_type_mismatch != b.on_type_mismatch:
        say(BREAKING if b.on_type_mismatch == "error" else NON_BREAKING, "settings.on_type_mismatch", f"type mismatches are now {b.on_type_mismatch}s")
    if a.input != b.input:
        say(NON_BREAKING, "settings.input", "reading instructions changed")
