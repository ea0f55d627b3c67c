"""Command line: init, check, diff, validate-contract, export, import, mcp.

Exit codes: 0 passed, 1 checks failed or a breaking difference, 2 usage or contract error, 3 internal.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .contract.diff import BREAKING, diff
from .contract.json_schema import json_schema
from .contract.lint import errors, lint
from .contract.model import Contract, ContractError, Field, InputSettings
from .contract.parse import dump_contract, parse_contract
from .export.dbt import generic_tests, schema_yml
from .export.expectations import dlt_python, dlt_sql
from .export.odcs import export_odcs, import_odcs, is_odcs

PASSED, FAILED, USAGE, INTERNAL = 0, 1, 2, 3


def _contract(path: str) -> tuple[Contract, str]:
    """A contract file, in its own form or the open standard's."""
    text = Path(path).read_text(encoding="utf-8")
    if is_odcs(text):
        contract, notes = import_odcs(text)
        for n in notes:
            print(f"note: {n}", file=sys.stderr)
        return contract, text
    return parse_contract(text), text


def _layout(text: str) -> tuple[Field, ...]:
    """``name:1-4,other:8``: places, or a width after the field before."""
    out = []
    for part in text.split(","):
        name, _, place = part.strip().rpartition(":")
        first, dash, last = place.partition("-")
        out.append(Field(name, int(first), int(last)) if dash else Field(name, width=int(first)))
    return tuple(out)


def _read_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input-format")
    p.add_argument("--delimiter")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--skip-rows", type=int)
    p.add_argument("--json-path")
    p.add_argument("--sheet")
    p.add_argument("--xml-record")
    p.add_argument("--fixed-width", type=_layout)


def _flags(a: argparse.Namespace) -> dict:
    given = {"format": a.input_format, "delimiter": a.delimiter, "has_header": False if a.no_header else None, "skip_rows": a.skip_rows, "json_path": a.json_path, "sheet": a.sheet, "xml_record": a.xml_record, "fixed_width": a.fixed_width}
    return {k: v for k, v in given.items() if v is not None}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablewarden", description="Data contracts on Spark")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("init", help="draft a contract from data")
    p.add_argument("data")
    p.add_argument("--dataset")
    p.add_argument("--output", "-o")
    _read_flags(p)
    p = sub.add_parser("check", help="check data against a contract")
    p.add_argument("data")
    p.add_argument("--contract", "-c", required=True)
    p.add_argument("--format", choices=("human", "json", "junit"), default="human")
    p.add_argument("--strict", action="store_true", help="warnings fail the run")
    p.add_argument("--now", help="the clock for freshness, RFC 3339")
    p.add_argument("--reference", action="append", default=[], metavar="DATASET=PATH")
    p.add_argument("--sample-failures", type=int, default=5)
    p.add_argument("--redact-samples", action="store_true")
    p.add_argument("--no-profile", action="store_true")
    p.add_argument("--fail-on-unknown-freshness", action="store_true")
    p.add_argument("--html")
    p.add_argument("--openlineage")
    p.add_argument("--verbose", "-v", action="store_true")
    _read_flags(p)
    p = sub.add_parser("diff", help="classify the changes between two versions")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--format", choices=("human", "json"), default="human")
    p = sub.add_parser("validate-contract", help="lint a contract")
    p.add_argument("contract")
    p.add_argument("--format", choices=("human", "json"), default="human")
    p = sub.add_parser("export", help="a contract in another tool's format")
    p.add_argument("contract")
    p.add_argument("--to", choices=("dlt-sql", "dlt-python", "dbt", "dbt-tests", "odcs", "json-schema"), required=True)
    p.add_argument("--output", "-o")
    p = sub.add_parser("import", help="a contract from the open standard's format")
    p.add_argument("document")
    p.add_argument("--table")
    p.add_argument("--output", "-o")
    sub.add_parser("mcp", help="serve explain, check and diff as tools over standard input and output")
    return top


def _emit(text: str, path: str | None) -> None:
    Path(path).write_text(text, encoding="utf-8") if path else print(text, end="" if text.endswith("\n") else "\n")


def _session():
    from .session import local_session

    return local_session()


def _check(a: argparse.Namespace) -> int:
    from .operators.execute import run_check
    from .operators.keys import references_of
    from .report import html, human, json_text, junit, openlineage
    from .sources import ReadOptions, open_source

    contract, text = _contract(a.contract)
    if bad := errors(lint(contract)):
        for f in bad:
            print(f"error: {f.path}: {f.message}", file=sys.stderr)
        return USAGE
    spark = _session()
    datasets = {}
    for item in a.reference:
        name, eq, path = item.partition("=")
        if not eq:
            raise ContractError("--reference takes DATASET=PATH")
        datasets[name] = open_source(spark, path).frame
    source = open_source(spark, a.data, ReadOptions.layered(contract.settings.input, **_flags(a)))
    result = run_check(
        contract, source.frame, typed=source.typed, now=a.now, references=references_of(contract, datasets), sample_failures=a.sample_failures, profile=not a.no_profile, redact=a.redact_samples,
        fail_on_unknown_freshness=a.fail_on_unknown_freshness, source=source.describe(), contract_text=text, contract_path=a.contract,
    )
    document = result.to_dict()
    shown = {"human": lambda: human(document, sys.stdout.isatty(), a.verbose), "json": lambda: json_text(document) + "\n", "junit": lambda: junit(document)}[a.format]()
    print(shown, end="")
    if a.html:
        Path(a.html).write_text(html(document), encoding="utf-8")
    if a.openlineage:
        Path(a.openlineage).write_text(json.dumps(openlineage(document), indent=2), encoding="utf-8")
    return FAILED if result.is_failure(a.strict) else PASSED


def _init(a: argparse.Namespace) -> int:
    from .operators.draft import draft_contract
    from .operators.profile import profile_frame
    from .operators.samples import ROW
    from .sources import ReadOptions, open_source

    flags = _flags(a)
    source = open_source(_session(), a.data, ReadOptions(**flags))
    frame = source.frame.drop(ROW)
    name = a.dataset or Path(a.data).name.partition(".")[0] or "dataset"
    profiles = profile_frame(frame, typed=source.typed)
    _emit(draft_contract(profiles, name, InputSettings(**flags)), a.output)
    return PASSED


def _diff(a: argparse.Namespace) -> int:
    changes = diff(_contract(a.old)[0], _contract(a.new)[0])
    if a.format == "json":
        print(json.dumps([vars(c) for c in changes], indent=2))
    else:
        for c in changes:
            print(f"{c.impact:<12} {c.path}: {c.description}")
        print(f"{len(changes)} changes" if changes else "no changes")
    return FAILED if any(c.impact == BREAKING for c in changes) else PASSED


def _validate(a: argparse.Namespace) -> int:
    findings = lint(_contract(a.contract)[0])
    if a.format == "json":
        print(json.dumps([vars(f) for f in findings], indent=2))
    else:
        for f in findings:
            print(f"{f.severity}: {f.path}: {f.message}")
        print("valid" if not errors(findings) else "not valid")
    return USAGE if errors(findings) else PASSED


def _export(a: argparse.Namespace) -> int:
    contract = _contract(a.contract)[0]
    forms = {"dlt-sql": dlt_sql, "dlt-python": dlt_python, "dbt": schema_yml, "odcs": export_odcs, "json-schema": lambda c: json.dumps(json_schema(), indent=2) + "\n", "dbt-tests": lambda c: "\n".join(generic_tests().values())}
    _emit(forms[a.to](contract), a.output)
    return PASSED


def _import(a: argparse.Namespace) -> int:
    contract, notes = import_odcs(Path(a.document).read_text(encoding="utf-8"), a.table)
    for n in notes:
        print(f"note: {n}", file=sys.stderr)
    _emit(dump_contract(contract), a.output)
    return PASSED


def _mcp(a: argparse.Namespace) -> int:
    from .server import serve

    serve()
    return PASSED


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else PASSED
    commands = {"init": _init, "check": _check, "diff": _diff, "validate-contract": _validate, "export": _export, "import": _import, "mcp": _mcp}
    try:
        return commands[a.command](a)
    except (ValueError, OSError) as e:  # contracts, options and sources that cannot be used
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exception as e:  # noqa: BLE001
        print(f"internal error: {type(e).__name__}: {e}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
