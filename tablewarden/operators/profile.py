"""Column profiles: one aggregation for all columns, and a second only for small value sets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract.model import number, render
from ..functions.typed import DATE_SHAPE, DATETIME_SHAPE, FLOAT_SHAPE, as_text, cast_shaped, nested_kind, shaped, sketched, trimmed
from ..plans.planner import NestedColumnError, name_of

MOST_VALUES, LONGEST_VALUE = 25, 64
_INIT_FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s.]+\z",
    "url": r"^https?://[^/?#\s]+",
    "iso_datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}",
    "iso_date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
}


@dataclass
class ColumnProfile:
    name: str
    null_count: int
    null_ratio: float
    distinct: int
    min: str | None = None
    max: str | None = None
    mean: float | None = None
    std: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    values: list[str] = field(default_factory=list)
    values_complete: bool = False
    inferred_type: str | None = None
    inferred_format: str | None = None

    def to_dict(self, redacted: bool = False) -> dict[str, Any]:
        drop = {"inferred_type", "inferred_format"} | ({"min", "max", "values"} if redacted else set())
        return {k: number(v) if isinstance(v, float) else v for k, v in vars(self).items() if k not in drop and v is not None and v != []}


def text_of(frame: DataFrame, name: str, typed: bool) -> Column:
    given = frame.schema[name].dataType
    text = as_text(name_of(name), given)
    return text if typed else F.nullif(text, F.lit(""))


def _number_of(frame: DataFrame, name: str, text: Column) -> Column:
    given = frame.schema[name].dataType
    if isinstance(given, T.NumericType):
        value = name_of(name).cast("double")
    elif isinstance(given, T.StringType):
        value = cast_shaped(text, FLOAT_SHAPE, "double")
    else:
        value = F.lit(None).cast("double")
    return value


def profiled_columns(frame: DataFrame, strict: bool = False) -> list[str]:
    names = []
    for f in frame.schema.fields:
        kind = nested_kind(f.dataType)
        if kind and strict:
            raise NestedColumnError(f.name, kind)
        if not kind:
            names.append(f.name)
    return names


def prepared(frame: DataFrame, names: list[str], typed: bool) -> DataFrame:
    """The frame with each profiled column's text, number and length beside it: they are used by many
    aggregates, and parsing a cell once is what a profile costs."""
    texts = {f"__t{i}": text_of(frame, n, typed) for i, n in enumerate(names)}
    numbers = {f"__v{i}": _number_of(frame, n, texts[f"__t{i}"]) for i, n in enumerate(names)}
    finite = {v: F.when(F.abs(v) < float("inf"), F.col(v)) for v in numbers}
    return frame.withColumns(texts | numbers).withColumns(finite)


def profile_slots(names: list[str], exact: bool = False) -> dict[str, Column]:
    """Aggregates over a prepared frame by slot name; exact distinct counts are left to grouped jobs."""
    out: dict[str, Column] = {"p_rows": F.count(F.lit(1))}
    for i in range(len(names)):
        text, value = F.col(f"__t{i}"), F.col(f"__v{i}")
        length = F.char_length(text)
        out |= {f"p{i}_full": F.count(text), f"p{i}_numbers": F.count(value), f"p{i}_least": F.min(value), f"p{i}_most": F.max(value), f"p{i}_mean": F.avg(value), f"p{i}_std": F.stddev_samp(value)}
        out |= {f"p{i}_first": F.min(text), f"p{i}_last": F.max(text), f"p{i}_short": F.min(length), f"p{i}_long": F.max(length)}
        if not exact:
            out[f"p{i}_distinct"] = sketched(text)
    return out


def detectors(text: Column) -> dict[str, Column]:
    """Whether a cell could be of each type a draft may infer, in the order in which they are tried."""
    t = trimmed(text)
    return {
        "bool": shaped(text, "(?i:true|false)"),
        "int": shaped(text, r"^[+-]?[0-9]+\z") & t.try_cast("bigint").isNotNull(),
        "float": shaped(text, FLOAT_SHAPE),
        "datetime": shaped(text, DATETIME_SHAPE) & ~shaped(text, DATE_SHAPE) & t.try_cast("timestamp").isNotNull(),
        "date": shaped(text, DATE_SHAPE) & t.try_cast("date").isNotNull(),
    }


def read_profile(row: dict[str, Any], names: list[str], distinct: dict[str, int] | None = None) -> list[ColumnProfile]:
    rows, out = row["p_rows"], []
    for i, name in enumerate(names):
        g = {k: row[f"p{i}_{k}"] for k in ("full", "numbers", "least", "most", "mean", "std", "first", "last", "short", "long")}
        numeric = g["full"] > 0 and g["numbers"] == g["full"]
        p = ColumnProfile(name, rows - g["full"], (rows - g["full"]) / rows if rows else 0.0, distinct[name] if distinct else min(row[f"p{i}_distinct"], g["full"]))
        p.min, p.max = (render(g["least"]), render(g["most"])) if numeric else (g["first"], g["last"])
        if numeric:
            p.mean, p.std = g["mean"], g["std"]
        p.min_length, p.max_length = g["short"], g["long"]
        out.append(p)
    return out


def fill_values(frame: DataFrame, profiles: list[ColumnProfile], typed: bool) -> None:
    """Value sets of the columns that can have a small one, in one aggregation."""
    small = [p for p in profiles if 0 < p.distinct <= MOST_VALUES * 1.1 and (p.max_length or 0) <= LONGEST_VALUE]
    if not small:
        return
    row = frame.agg(*(F.array_sort(F.collect_set(text_of(frame, p.name, typed))).alias(f"v{i}") for i, p in enumerate(small))).first()
    for i, p in enumerate(small):
        if len(row[f"v{i}"]) <= MOST_VALUES:
            p.values, p.values_complete, p.distinct = row[f"v{i}"], True, len(row[f"v{i}"])


def profile_frame(frame: DataFrame, typed: bool = False) -> list[ColumnProfile]:
    """The profile that drafts are made from: exact distinct counts, inferred types and formats. Nested
    columns are refused."""
    names = profiled_columns(frame, strict=True)
    wide = prepared(frame, names, typed)
    slots = profile_slots(names, exact=True)
    for i in range(len(names)):
        text = F.col(f"__t{i}")
        slots |= {f"d{i}_{k}": F.count(F.when(c, 1)) for k, c in detectors(text).items()}
        slots |= {f"f{i}_{k}": F.count(F.when(text.rlike(p), 1)) for k, p in _INIT_FORMATS.items()}
    count = lambda n: frame.select(text_of(frame, n, typed).alias("v")).dropna().distinct().count()
    with ThreadPoolExecutor(max_workers=8) as pool:  # submitted together: they share the cluster
        counts = {n: pool.submit(count, n) for n in names}
        row = wide.agg(*(e.alias(k) for k, e in slots.items())).first().asDict()
        distinct = {n: c.result() for n, c in counts.items()}
    out = read_profile(row, names, distinct)
    for i, p in enumerate(out):
        full = row[f"p{i}_full"]
        p.inferred_type = next((k for k in ("bool", "int", "float", "datetime", "date") if full and row[f"d{i}_{k}"] == full), "string")
        if p.inferred_type == "string" and full:
            p.inferred_format = next((k for k in _INIT_FORMATS if row[f"f{i}_{k}"] == full), None)
    fill_values(frame, out, typed)
    return out
