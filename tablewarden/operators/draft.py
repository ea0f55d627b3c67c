"""A starter contract from a profile: facts as rules, guesses as comments."""

from __future__ import annotations

import re

import yaml

from ..contract.model import Contract, InputSettings, Settings
from ..contract.parse import contract_form
from .profile import ColumnProfile

_ENUM_AT_MOST = 12


def _scalar(value: str) -> str:
    plain = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_. -]*[A-Za-z0-9_]|[A-Za-z_]", value) and value.lower() not in ("true", "false", "null", "yes", "no", "on", "off")
    return value if plain else "'" + value.replace("'", "''") + "'"


def _guesses(p: ColumnProfile) -> list[str]:
    out = []
    if p.inferred_type in ("int", "float") and p.min is not None:
        out += [f"- {{ min: {p.min} }}", f"- {{ max: {p.max} }}"]
    if p.inferred_format:
        out.append(f"- {{ format: {p.inferred_format} }}")
    if p.inferred_type == "string" and p.values_complete and 1 < len(p.values) <= _ENUM_AT_MOST:
        out.append(f"- {{ enum: [{', '.join(map(_scalar, p.values))}] }}")
    if p.inferred_type == "string" and p.min_length and p.min_length == p.max_length:
        out.append(f"- {{ length: {p.min_length} }}")
    return out


def draft_contract(profiles: list[ColumnProfile], dataset: str, given: InputSettings | None = None) -> str:
    """YAML text that the data it was made from passes; suggested checks are commented out."""
    lines = ["apiVersion: v1", f"dataset: {_scalar(dataset)}", "# owner: team@example.com", "# description: What one row of this dataset is.", "", "columns:"]
    for p in profiles:
        lines.append(f"  {_scalar(p.name)}:")
        lines.append(f"    type: {p.inferred_type}")
        lines.append(f"    required: {'true' if p.null_count == 0 else 'false'}")
        if guesses := _guesses(p):
            lines += ["    # checks:", *(f"    #   {g}" for g in guesses)]
    lines += ["", "dataset_checks:", "  - row_count_min: 1"]
    if newest := next((p for p in profiles if p.inferred_type == "datetime"), None):
        lines.append(f"  # - freshness: {{ column: {_scalar(newest.name)}, max_age: 48h, severity: warn }}")
    lines += ["", "settings:", "  allow_extra_columns: true", "  on_type_mismatch: error"]
    if given and given != InputSettings():
        form = contract_form(Contract("x", settings=Settings(input=given)))["settings"]["input"]
        text = yaml.safe_dump({"input": form}, sort_keys=False, allow_unicode=True)
        lines += ["  " + x for x in text.rstrip("\n").split("\n")]
    return "\n".join(lines) + "\n"
