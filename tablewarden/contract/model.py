"""The contract model: plain frozen dataclasses in declaration order."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date
from typing import Any

# Fixed values of the contract format.
TYPES = ("string", "int", "float", "bool", "date", "datetime")
ORDERED_TYPES = ("int", "float", "date", "datetime")
TEMPORAL_TYPES = ("date", "datetime")
SEVERITIES = ("error", "warn")
PII_KINDS = ("none", "email", "phone", "name", "address", "national_id", "financial", "health", "other")
CLASSIFICATIONS = ("public", "internal", "confidential", "restricted")
STABILITIES = ("stable", "beta", "deprecated")
FORMATS = ("email", "uuid", "iso_date", "iso_datetime", "url", "country_code_iso2")
INPUT_FORMATS = ("csv", "tsv", "parquet", "ndjson", "json", "excel", "xml", "fixed_width")
COLUMN_CHECKS = ("unique", "not_empty_string", "min", "max", "regex", "enum", "length", "format", "null_ratio_max", "unique_ratio_min", "custom_expr")
DATASET_CHECKS = ("row_count_min", "row_count_max", "freshness", "null_ratio_max", "unique_ratio_min", "custom_expr", "assert", "references")
BARE_CHECKS = ("unique", "not_empty_string")


class ContractError(ValueError):
    """A contract that cannot be read; ``line`` is 1-based where it is known."""

    def __init__(self, message: str, line: int | None = None) -> None:
        self.line = line
        super().__init__(message if line is None else f"line {line}: {message}")


@dataclass(frozen=True)
class Check:
    """One check of a column or of the dataset; ``params`` hold what the contract states."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"

    def __getitem__(self, name: str) -> Any:
        return self.params[name]

    def length_bounds(self) -> tuple[int, int | None]:
        spec = self.params["length"]
        if isinstance(spec, int):
            return spec, spec
        return spec.get("min") or 0, spec.get("max")


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    description: str | None = None
    required: bool = False
    pii: str | None = None
    classification: str | None = None
    stability: str = "stable"
    sunset: str | None = None
    checks: tuple[Check, ...] = ()


#: What a consumer can be: fixed values.
CONSUMER_KINDS = ("dashboard", "model", "api", "pipeline", "ai_agent", "report")


@dataclass(frozen=True)
class Consumer:
    name: str
    contact: str | None = None
    reads: tuple[str, ...] | None = None
    tier: int | None = None
    kind: str | None = None

    @property
    def reads_whole_dataset(self) -> bool:
        """Whoever named no columns may break on any of them."""
        return not self.reads


@dataclass(frozen=True)
class Field:
    """One field of a fixed-width line: by place, or by width after the field before it."""

    name: str
    start: int | None = None
    end: int | None = None
    width: int | None = None


@dataclass(frozen=True)
class InputSettings:
    format: str | None = None
    delimiter: str | None = None
    has_header: bool | None = None
    skip_rows: int | None = None
    json_path: str | None = None
    sheet: str | int | None = None
    xml_record: str | None = None
    fixed_width: tuple[Field, ...] | None = None


@dataclass(frozen=True)
class Settings:
    allow_extra_columns: bool = True
    columns_exact: bool = False
    on_type_mismatch: str = "error"
    input: InputSettings = InputSettings()


@dataclass(frozen=True)
class Migration:
    window_ends: str
    note: str | None = None


@dataclass(frozen=True)
class Contract:
    dataset: str
    columns: dict[str, Column] = field(default_factory=dict)
    owner: str | None = None
    description: str | None = None
    version: str | None = None
    consumers: tuple[Consumer, ...] = ()
    primary_key: tuple[str, ...] = ()
    dataset_checks: tuple[Check, ...] = ()
    migration: Migration | None = None
    settings: Settings = Settings()
    api_version: str = "v1"

    def consumers_of(self, column: str) -> list[Consumer]:
        """Who a change of this column reaches: those that read it, and those that never said what they read."""
        return [c for c in self.consumers if c.reads_whole_dataset or column in c.reads]


def render(value: Any) -> str:
    """The text of a parameter value, as data cells spell it: whole floats without a fraction."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isfinite(value) and value == int(value) and abs(value) < 1e16:
            return str(int(value))
        return repr(value)
    return str(value)


def number(value: float | int | None) -> float | int | None:
    """Whole floats below 9e15 become integers in results."""
    if isinstance(value, float) and math.isfinite(value) and value == int(value) and abs(value) < 9e15:
        return int(value)
    return value


_UNITS = {
    **dict.fromkeys(("ns", "nsec", "nanos"), 1e-9),
    **dict.fromkeys(("us", "usec", "micros"), 1e-6),
    **dict.fromkeys(("ms", "msec", "millis"), 1e-3),
    **dict.fromkeys(("s", "sec", "secs", "second", "seconds"), 1),
    **dict.fromkeys(("m", "min", "mins", "minute", "minutes"), 60),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), 3600),
    **dict.fromkeys(("d", "day", "days"), 86400),
    **dict.fromkeys(("w", "wk", "wks", "week", "weeks"), 604800),
    **dict.fromkeys(("M", "month", "months"), 2630016),
    **dict.fromkeys(("y", "yr", "yrs", "year", "years"), 31557600),
}


def parse_duration(text: str) -> float:
    """Seconds of a duration such as ``48h`` or ``1d 12h``."""
    parts = re.findall(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not parts or "".join(re.findall(r"[^\s]", text)) != "".join(n + u for n, u in parts):
        raise ValueError(f"`{text}` is not a duration (write e.g. 30m, 48h or 7d)")
    total = 0.0
    for n, unit in parts:
        if unit not in _UNITS:
            raise ValueError(f"`{unit}` is not a unit of time")
        total += int(n) * _UNITS[unit]
    return int(total) if total == int(total) else total


def format_duration(seconds: float) -> str:
    """The duration in its largest units, e.g. ``1day 12h``."""
    left, out = int(seconds), []
    for unit, size in (("year", 31557600), ("month", 2630016), ("day", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n:
            out.append(f"{n}{unit}" + ("s" if n > 1 and len(unit) > 1 else ""))
    return " ".join(out) or "0s"


def is_date(text: Any) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(date.fromisoformat(text))
    except (TypeError, ValueError):
        return False


def suggestion(name: str, known: list[str] | tuple[str, ...]) -> str | None:
    """The nearest known name, if it is near enough to be meant."""
    best, least = None, max(len(name), 3) // 3 + 2
    for other in known:
        row = list(range(len(other) + 1))
        for i, a in enumerate(name, 1):
            above, row = row, [i]
            for j, b in enumerate(other, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        if row[-1] < least:
            best, least = other, row[-1]
    return best


def did_you_mean(name: str, known: list[str] | tuple[str, ...]) -> str:
    near = suggestion(name, known)
    return f", did you mean `{near}`?" if near else ""
