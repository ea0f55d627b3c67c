"""JSON, terminal text, JUnit, HTML and OpenLineage. Nothing is computed that the result does not hold."""

from __future__ import annotations

import html as escaping
import json
import uuid
from typing import Any
from xml.sax.saxutils import escape, quoteattr

_PRODUCER = "tablewarden"


def json_text(result: dict[str, Any], indent: int | None = 2) -> str:
    return json.dumps(result, ensure_ascii=False, indent=indent)


def _thousands(n: Any) -> str:
    return f"{n:,}" if isinstance(n, int) else str(n)


def _bytes(n: float) -> str:
    for unit in ("B", "kB", "MB", "GB", "TB"):
        if n < 1000 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000
    return ""


def _seconds(ms: int) -> str:
    return f"{ms} ms" if ms < 1000 else f"{ms / 1000:.1f} s"


def _marks(colour: bool) -> dict[str, str]:
    if not colour:
        return {"ok": "ok  ", "bad": "FAIL", "warn": "warn"}
    return {"ok": "\033[32mok  \033[0m", "bad": "\033[31mFAIL\033[0m", "warn": "\033[33mwarn\033[0m"}


def human(result: dict[str, Any], colour: bool = False, verbose: bool = False) -> str:
    """The verdict for a terminal: failures with samples, and all passed checks if verbose."""
    marks, s, src = _marks(colour), result["summary"], result["source"]
    size = f", {_bytes(src['bytes'])}" if src.get("bytes") else ""
    lines = [f"{result['contract']['dataset']}: {src['path']} ({src['format']}{size})", f"{_thousands(src['rows'])} rows x {src['columns']} columns, {s['checks_total']} checks in {_seconds(result['duration_ms'])}", ""]
    for c in result["checks"]:
        if c["status"] == "passed":
            if verbose:
                lines.append(f"  {marks['ok']} {c['id']}")
            continue
        lines.append(f"  {marks['warn' if c['severity'] == 'warn' else 'bad']} {c['id']}" + (f": {c['message']}" if c.get("message") else ""))
        for x in c["samples"]:
            lines.append(f"         row {_thousands(x['row'])}: {x['value']}" if x["row"] else f"         {x['value']}")
    if len(lines) > 3:
        lines.append("")
    lines.append(f"{s['passed']} passed, {s['failed_error']} failed, {s['failed_warn']} warnings: {result['status']}")
    return "\n".join(lines) + "\n"


def junit(result: dict[str, Any]) -> str:
    """One test case per check; a failed warning is a skipped case, so that it does not break a build."""
    s, name = result["summary"], result["contract"]["dataset"]
    seconds = result["duration_ms"] / 1000
    head = f'tests="{s["checks_total"]}" failures="{s["failed_error"]}" skipped="{s["failed_warn"]}" time="{seconds:.3f}"'
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f"<testsuites {head}>", f"  <testsuite name={quoteattr(name)} errors=\"0\" {head} timestamp={quoteattr(result['started_at'])}>"]
    for c in result["checks"]:
        case = f"    <testcase name={quoteattr(c['id'])} classname={quoteattr(name + '.' + (c.get('column') or 'dataset'))}"
        if c["status"] == "passed":
            out.append(case + "/>")
            continue
        message = c.get("message") or "failed"
        body = "\n".join([message, *(f"row {x['row']}: {x['value']}" for x in c["samples"])])
        tag = f"<skipped message={quoteattr('warning: ' + message)}/>" if c["severity"] == "warn" else f"<failure message={quoteattr(message)} type={quoteattr(c['kind'])}>{escape(body)}</failure>"
        out += [case + ">", f"      {tag}", "    </testcase>"]
    return "\n".join([*out, "  </testsuite>", "</testsuites>"]) + "\n"


_STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#222}table{border-collapse:collapse;width:100%;margin:1rem 0}th,td{text-align:left;padding:.35rem .6rem;border-bottom:1px solid #ddd;vertical-align:top}.passed{color:#176b2c}.failed{color:#a11}.warn{color:#8a5a00}code{font-size:.95em}"


def html(result: dict[str, Any], title: str | None = None) -> str:
    """One page without outside resources."""
    e = lambda x: escaping.escape(str(x))
    s, src, con = result["summary"], result["source"], result["contract"]
    rows = []
    for c in result["checks"]:
        kind = "passed" if c["status"] == "passed" else "warn" if c["severity"] == "warn" else "failed"
        m = c["metrics"]
        counts = f"{_thousands(m['rows_failed'])} of {_thousands(m['rows_evaluated'])}" if m.get("rows_failed") is not None and m.get("rows_evaluated") is not None else ""
        shown = "<br>".join(f"<code>{e(x['row'])}: {e(x['value'])}</code>" for x in c["samples"])
        rows.append(f'<tr><td class="{kind}">{"warning" if kind == "warn" else kind}</td><td><code>{e(c["id"])}</code></td><td>{counts}</td><td>{e(c.get("message") or "")}{"<br>" if shown and c.get("message") else ""}{shown}</td></tr>')
    columns = ""
    if p := result.get("profile"):
        body = "".join(
            f"<tr><td><code>{e(x['name'])}</code></td><td>{x['null_ratio']:.2%}</td><td>{_thousands(x['distinct'])}</td><td>{e(x.get('min', ''))}</td><td>{e(x.get('max', ''))}</td><td>{e(x.get('mean', ''))}</td><td>{e(', '.join(x.get('values', [])))}</td></tr>" for x in p["columns"]
        )
        columns = f"<h2>Columns</h2><table><tr><th>column</th><th>null</th><th>distinct</th><th>min</th><th>max</th><th>mean</th><th>values</th></tr>{body}</table>"
    who = "".join(f"<li>{e(c['name'])}{' (' + e(c['contact']) + ')' if c.get('contact') else ''}</li>" for c in con.get("consumers", []))
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{e(title or con["dataset"])}</title><style>{_STYLE}</style></head><body>'
        f'<h1>{e(con["dataset"])}: <span class="{result["status"]}">{result["status"]}</span></h1>'
        f"<p>{e(src['path'])}: {_thousands(src['rows'])} rows, {src['columns']} columns. {s['passed']} of {s['checks_total']} checks passed, {s['failed_error']} failed, {s['failed_warn']} warnings. {e(result['started_at'])}, {_seconds(result['duration_ms'])}.</p>"
        f"<table><tr><th>status</th><th>check</th><th>rows failed</th><th></th></tr>{''.join(rows)}</table>{columns}{'<h2>Consumers</h2><ul>' + who + '</ul>' if who else ''}</body></html>\n"
    )


def openlineage(result: dict[str, Any], namespace: str = "default", job: str | None = None, run_id: str | None = None) -> dict[str, Any]:
    """A run event with data quality assertions and metrics of the checked dataset."""
    con, src = result["contract"], result["source"]
    run_id = run_id or str(uuid.uuid5(uuid.NAMESPACE_URL, f"{con['dataset']}/{con['content_sha256']}/{result['started_at']}"))
    schema = "https://openlineage.io/spec"
    base = {"_producer": _PRODUCER, "_schemaURL": f"{schema}/2-0-2/OpenLineage.json"}
    assertions = [{"assertion": c["id"], "success": c["status"] == "passed", **({"column": c["column"]} if c.get("column") else {})} for c in result["checks"]]
    metrics: dict[str, Any] = {"rowCount": src["rows"]} | ({"bytes": src["bytes"]} if src.get("bytes") else {})
    columns = {}
    for p in result.get("profile", {}).get("columns", []):
        numbers = {k: float(p[n]) for k, n in (("min", "min"), ("max", "max")) if "mean" in p and n in p}
        columns[p["name"]] = {"nullCount": p["null_count"], "distinctCount": p["distinct"]} | numbers
    facets: dict[str, Any] = {"dataQualityAssertions": base | {"assertions": assertions}, "schema": base | {"fields": [{"name": c["name"], **({"type": c["dtype"]} if "dtype" in c else {})} for c in result["observed_schema"]["columns"]]}}
    return {
        "eventType": "COMPLETE" if result["status"] == "passed" else "FAIL", "eventTime": result["started_at"], "producer": _PRODUCER, "schemaURL": f"{schema}/2-0-2/OpenLineage.json#/$defs/RunEvent",
        "run": {"runId": run_id, "facets": {}}, "job": {"namespace": namespace, "name": job or f"check.{con['dataset']}"},
        "inputs": [{"namespace": namespace, "name": con["dataset"], "facets": facets, "inputFacets": {"dataQualityMetrics": base | metrics | {"columnMetrics": columns}}}], "outputs": [],
    }
