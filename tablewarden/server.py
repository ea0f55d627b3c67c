"""A tool server over standard input and output (JSON-RPC lines): explain, check and diff, all read-only."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any, TextIO

from . import __version__
from .contract.diff import diff, worst
from .contract.lint import errors, lint
from .contract.model import Contract
from .contract.parse import check_form, contract_form, parse_contract
from .export.odcs import import_odcs, is_odcs

PROTOCOL = "2024-11-05"


def _read(path: str) -> tuple[Contract, str]:
    text = Path(path).read_text(encoding="utf-8")
    return (import_odcs(text)[0] if is_odcs(text) else parse_contract(text)), text


def explain_contract(contract: str) -> dict[str, Any]:
    c, _ = _read(contract)
    columns = [{"name": n, "type": x.type, "required": x.required, "checks": [check_form(k) for k in x.checks], "consumers": [r.name for r in c.consumers_of(n)]} for n, x in c.columns.items()]
    findings = lint(c)
    return {"dataset": c.dataset, "owner": c.owner, "columns": columns, "dataset_checks": [check_form(k) for k in c.dataset_checks], "valid": not errors(findings), "findings": [vars(f) for f in findings], "contract": contract_form(c)}


def check_data(contract: str, data: str, now: str | None = None, samples: bool = False) -> dict[str, Any]:
    """Sample values are real data: they are masked unless asked for."""
    from .operators.execute import run_check
    from .session import local_session
    from .sources import ReadOptions, open_source

    c, text = _read(contract)
    if bad := errors(lint(c)):
        raise ValueError("; ".join(f"{f.path}: {f.message}" for f in bad))
    source = open_source(local_session(), data, ReadOptions.layered(c.settings.input))
    result = run_check(c, source.frame, typed=source.typed, now=now, redact=not samples, source=source.describe(), contract_text=text, contract_path=contract)
    return result.to_dict()


def diff_contracts(old: str, new: str) -> dict[str, Any]:
    changes = diff(_read(old)[0], _read(new)[0])
    return {"worst": worst(changes), "changes": [vars(c) for c in changes]}


_PATH = {"type": "string", "description": "path of a file"}
TOOLS: dict[str, tuple[Callable[..., dict], str, dict[str, Any], list[str]]] = {
    "explain_contract": (explain_contract, "What a contract demands, who reads which column, and what is wrong with it", {"contract": _PATH}, ["contract"]),
    "check_data": (check_data, "Check a data file against a contract", {"contract": _PATH, "data": _PATH, "now": {"type": "string"}, "samples": {"type": "boolean"}}, ["contract", "data"]),
    "diff_contracts": (diff_contracts, "Classify the changes between two versions of a contract", {"old": _PATH, "new": _PATH}, ["old", "new"]),
}


def answer(request: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one message; none for a notification."""
    method, number = request.get("method"), request.get("id")
    if number is None:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tablewarden", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        tools = [{"name": n, "description": text, "inputSchema": {"type": "object", "properties": p, "required": need}, "annotations": {"readOnlyHint": True}} for n, (_, text, p, need) in TOOLS.items()]
        return reply | {"result": {"tools": tools}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method `{method}`"}}
    params = request.get("params", {})
    if params.get("name") not in TOOLS:
        return reply | {"error": {"code": -32602, "message": f"no tool `{params.get('name')}`"}}
    try:
        text, failed = json.dumps(TOOLS[params["name"]][0](**params.get("arguments", {})), ensure_ascii=False), False
    except Exception as e:  # noqa: BLE001  the caller gets the words, the server lives on
        text, failed = f"{type(e).__name__}: {e}", True
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def serve(source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
