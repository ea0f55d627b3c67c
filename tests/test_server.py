"""The tool server's messages."""

from __future__ import annotations

import io
import json

from tablewarden.server import serve

CONTRACT = "apiVersion: v1\ndataset: d\nconsumers: [{ name: x, reads: [a] }]\ncolumns:\n  a: { type: int, checks: [{ min: %d }] }\n"


def ask(*messages):
    out = io.StringIO()
    serve(io.StringIO("\n".join(m if isinstance(m, str) else json.dumps(m) for m in messages) + "\n"), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def call(number, name, **arguments):
    return {"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_messages(tmp_path):
    a, b = tmp_path / "a.yaml", tmp_path / "b.yaml"
    a.write_text(CONTRACT % 1)
    b.write_text(CONTRACT % 2)
    replies = ask(
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        call(3, "explain_contract", contract=str(a)), call(4, "diff_contracts", old=str(a), new=str(b)), call(5, "explain_contract", contract=str(tmp_path / "none")), call(6, "nothing"), "{", {"id": 7, "method": "x"},
    )
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, None, 7]
    assert {t["name"] for t in replies[1]["result"]["tools"]} == {"explain_contract", "check_data", "diff_contracts"}
    explained = json.loads(replies[2]["result"]["content"][0]["text"])
    assert explained["valid"] and explained["columns"][0]["consumers"] == ["x"]
    assert json.loads(replies[3]["result"]["content"][0]["text"])["worst"] == "breaking"
    assert replies[4]["result"]["isError"] and "error" in replies[5] and replies[6]["error"]["code"] == -32700


def test_check_data(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tablewarden.session.local_session", lambda: spark)
    (tmp_path / "a.yaml").write_text(CONTRACT % 2)
    (tmp_path / "a.csv").write_text("a\n1\n2\n")
    reply = ask(call(1, "check_data", contract=str(tmp_path / "a.yaml"), data=str(tmp_path / "a.csv")))[0]
    result = json.loads(reply["result"]["content"][0]["text"])
    assert result["status"] == "failed" and result["checks"][2]["samples"] == [{"row": 1, "value": "<redacted>"}]
