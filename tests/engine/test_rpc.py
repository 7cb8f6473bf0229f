"""The tool server, over a small tree; and the formatters."""

import io
import json

import pytest
from test_documents import DOCS, SCHEMA, USERS

from inkwell.operators import render
from inkwell.rpc import NAMES, serve


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("rpc")
    for path, text in DOCS.items():
        (at / "docs" / path).parent.mkdir(parents=True, exist_ok=True)
        (at / "docs" / path).write_text(text)
    (at / "s.kdl").write_text(SCHEMA)
    (at / "u.yaml").write_text(USERS)
    return at


def test_protocol_and_tools(spark, root):
    d, s = str(root / "docs"), str(root / "s.kdl")
    call = lambda i, name, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}})
    asks = [
        "{", "[]", json.dumps({"id": 1, "method": "none"}), json.dumps({"method": "notifications/initialized"}), json.dumps({"id": 2, "method": "initialize"}), json.dumps({"id": 3, "method": "tools/list"}), json.dumps({"id": 4, "method": "ping"}),
        call(5, "validate", dir=d, schema=s, users=str(root / "u.yaml")), call(6, "get", dir=d, path="adr-001.md", field="title"), call(7, "list", dir=d, filter=["type=adr"], sort="-title"),
        call(8, "describe", schema=s), call(9, "refs", dir=d, schema=s, id="adr_001", depth=2), call(10, "set", dir=d, path="gov-001.md", fields={"title": "New"}, write=True), call(11, "get", dir=d, path="gov-001.md", field="title"),
        call(12, "new", dir=d, schema=s, type="adr"), call(13, "graph", dir=d, schema=s, check=True), call(14, "deprecate", dir=d, schema=s, path="adr-001.md"), call(15, "inspect", dir=d, path="adr-001.md", schema=s), call(16, "nothing"), call(17, "get"),
    ]
    out = io.StringIO()
    serve(spark, asks, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["error"]["code"] for g in got[:3]] == [-32700, -32600, -32601]
    by = {g["id"]: g["result"] for g in got[3:]}
    assert [t["name"] for t in by[3]["tools"]] == list(NAMES) and by[4] == {}
    text = lambda i: json.loads(by[i]["content"][0]["text"])
    assert (text(5)["errors"], text(5)["warnings"], text(5)["ok"]) == (0, 1, True)
    assert text(6) == [{"value": "First"}] and [r["path"] for r in text(7)] == ["adr-003.md", "adr-002.md", "adr-001.md"]
    assert len(text(8)) == 4 and len(text(9)) == 14 and text(11) == [{"value": "New"}]
    assert text(12)[0]["path"] == "decisions/adr-004.md" and [r["code"] for r in text(13)] == ["G030"]
    assert len(text(14)["backlinks"]) == 6 and "status: deprecated" in text(14)["changed"][0]["raw"] and len(text(15)) == 1
    assert by[16]["isError"] and by[17]["isError"]


def test_formats(spark):
    d = spark.createDataFrame([("a", None), ("é", "x")], "k string, v string")
    assert render.rows(d, "text") == "k  | v\n---+--\na  |  \né  | x\n"
    assert render.rows(d, "json") == '[{"k": "a", "v": null}, {"k": "é", "v": "x"}]' and render.rows(d, "compact") == "k\tv\na\t\né\tx"
    assert render.table(["a|b"], [["1", "2"]], "markdown") == "| a\\|b |\n| --- |\n| 1 |"
    assert render.section("H", 2, "a *b*\n", "text") == "a b" and render.section("H", 2, "x", "markdown") == "## H\nx"
    assert render.choose("auto", True) == "text" and render.choose(None, False) == "json"
    with pytest.raises(ValueError):
        render.choose("xml", True)
