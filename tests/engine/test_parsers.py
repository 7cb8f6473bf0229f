"""Markdown, frontmatter, KDL and users, without Spark."""

import random

import pytest
import yaml

from inkwell.functions import frontmatter as fm
from inkwell.functions.markdown import blocks, parse_body, plain, split_lines, split_row
from inkwell.functions.scalar import dialect, normal_id
from inkwell.operators.export import to_html
from inkwell.plans.kdl import SchemaError, parse
from inkwell.plans.schema import Schema
from inkwell.plans.users import Users


def heads(text):
    return [(s["level"], s["heading"]) for s in parse_body(text)["sections"]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("# A\n## B ##\n###C\n", [(1, "A"), (2, "B")]),
        ("```\n# no\n```\n~~~ x\n# no\n~~~\n# yes\n", [(1, "yes")]),
        ("    # code\n\n   # three\n", [(1, "three")]),
        ("A\n===\nB\nC\n---\n", [(1, "A"), (2, "B C")]),
        ("> # quoted\n\n- # item\n", [(1, "quoted"), (1, "item")]),
        ("# `a` *b* [c](d) \\*\n", [(1, "a b c *")]),
        ("", []),
        ("# \n#\n", [(1, ""), (1, "")]),
        ("# ÄÖ ß\r\n\r\ntext\r\n", [(1, "ÄÖ ß")]),
    ],
)
def test_headings(text, want):
    assert heads(text) == want


def test_sections_are_slices():
    r = random.Random(4)
    for _ in range(200):
        lines = [r.choice(["# a", "## b", "### c", "text", "", "- x", "| a | b |", "|---|---|"]) for _ in range(r.randint(0, 25))]
        body = "\n".join(lines) + ("\n" if r.random() < 0.7 and lines else "")
        for s in parse_body(body)["sections"]:
            assert s["raw"] in body and s["raw"].endswith(s["content"])
            after = [x["line"] for x in parse_body(body)["sections"] if x["line"] > s["line"] and x["level"] <= s["level"]]
            assert s["line"] - 1 + len(split_lines(s["raw"])) == (min(after) - 1 if after else len(split_lines(body)))


def test_children_are_one_level_down():
    s = parse_body("# A\n### deep\n## B\n### C\n# A\n## B\n")["sections"]
    assert [(x["parent"], x["path"]) for x in s] == [(None, ["A"]), (None, ["deep"]), (0, ["A", "B"]), (2, ["A", "B", "C"]), (None, ["A"]), (4, ["A", "B"])]


def test_counts_tables_code_and_links():
    s = parse_body("# A\np [x](u.md) ![i](no.png) [r][q] <http://a.b/c>\n\n| h | k \\| l |\n|---|:-:|\n| 1 |\n| `c` | 3 | 4 |\n\n- a\n  - b\n\n  c\n1. d\n\n```Mermaid x\n```\n\n[q]: ADR-7\n")
    a = s["sections"][0]
    assert (a["n_lists"], a["n_items"], a["code_infos"]) == (3, 3, ["mermaid x"])
    assert a["n_paragraphs"] == 6  # the table, and those of items, are some
    assert a["tables"] == [{"headers": ["h", "k | l"], "rows": [["1", ""], ["c", "3"]]}]
    assert s["links"] == ["u.md", "ADR-7", "http://a.b/c"]
    assert split_row("a | b") == ["a", "b"] and split_row("||") == [""]


def test_plain():
    assert plain("**b** _i_ ~~d~~ snake_case_name 2 * 3 * 4 ``a`b``") == "b i d snake_case_name 2 * 3 * 4 a`b"


def test_blocks_end():
    assert [b.kind for b in blocks(["<div>", "# x", "", "***", "> a", "b", "", "1. x"])] == ["html", "rule", "quote", "list"]


def test_frontmatter():
    state, f, _, body, offset = fm.parse("---\na: 2025-01-10\nb: yes\nc: 12:30\nd: 010\ne: 0x1F\nf: 1.50\ng:\nh: [1, x]\ni: {k: 2}\nj: !t v\n---\nbody\n")
    assert state == "ok" and offset == 12 and body == "body\n"
    assert [fm.kind(f[k]) for k in "abcdefghij"] == ["string", "string", "string", "string", "number", "number", "null", "array", "mapping", "string"]
    assert [fm.display(f[k]) for k in "aefghi"] == ["2025-01-10", "31", "1.5", "null", "[1, x]", "k: 2\n"]
    assert fm.parse("text")[0] == "absent" and fm.parse("---\n---\nx")[:2] == ("ok", {}) and fm.parse("---\n- a\n---\n")[0] == "error"
    assert fm.parse("---\na: [\n---\n")[0] == "error" and fm.parse("---\na: 1\n")[0] == "absent" and fm.parse("---\r\na: 1\r\n---\r\nb")[3] == "b"


def test_render_round_trip():
    r = random.Random(9)
    word = lambda: r.choice(["x", "a: b", "@u", "true", "12", "2025-01-10", "- y", "null", "é", "", "#h", "1e3", "0x10", "'q\"", "yes"])
    for _ in range(300):
        f = {f"k{i}": r.choice([word(), r.randint(-9, 9), r.random(), None, True, [word(), 1], {"z": word(), "a": [word()]}]) for i in range(r.randint(1, 6))}
        text = fm.render(f, "body\n---\nmore")
        state, got, _, body, _ = fm.parse(text)
        assert (state, got, body) == ("ok", f, "body\n---\nmore")


def test_coerce():
    assert [fm.coerce(x) for x in ("true", "False", "-7", "1.5", "1e3", "[1, b]", "[", " x ", "null", "99999999999999999999")] == [True, "False", -7, 1.5, "1e3", [1, "b"], "[", " x ", "null", "99999999999999999999"]


def test_kdl():
    n = parse('a "x\\n" k=#true j=2.5 { b 1; c r=#"raw "q""# } // c\n/* d */ /- gone { e }\n"f" \\\n  -3 /-skip null')
    assert (n[0].name, n[0].args, n[0].props) == ("a", ["x\n"], {"k": True, "j": 2.5})
    assert [(c.name, c.args, c.props) for c in n[0].children] == [("b", [1], {}), ("c", [], {"r": 'raw "q"'})]
    assert (n[1].name, n[1].args, len(n)) == ("f", [-3, None], 2)
    for bad in ("a {", "}", "a k=", "{}"):
        with pytest.raises(SchemaError):
            parse(bad)


@pytest.mark.parametrize(
    "text",
    ['thing "x"', 'type "a"', 'type "a" { what }', 'type "a" singleton=#true { section "S" }', 'type "a" { field "f" type="enum" }', 'type "a" { field "f" type="date" }', 'relation "r" cardinality="two"', 'type "a" { rule "r" { when "f" } }', 'type "a" { section "s" { table { column "c" type="bool" } } }', 'ref-format { x }'],
)
def test_schemas_that_make_no_sense(text):
    with pytest.raises(SchemaError):
        Schema.parse(text)


def test_schema_lookups():
    s = Schema.parse('relation "a" inverse="b" cardinality="one"\nrelation "c"\ntype "t" { field "r" type="ref[]"; field "n" type="number" }')
    assert s.relation_names() == ["a", "b", "c"] and s.relation("b") == (s.relations[0], True) and s.relation("x") is None
    assert s.ref_fields("t") == ["a", "b", "c", "r"] and s.type("u") is None


def test_users():
    u = Users.parse("users:\n  a: {teams: [x], role: r}\n  b: {teams: [y]}\n  c:\nteams:\n  x: {teams: [y, z]}\n  y: {}\n  z: {teams: [x]}\n")
    assert u.members("x") == {"a", "b"} and u.members("y") == {"b"} and u.members("none") == set()
    assert [u.valid(r) for r in ("@a", "@team/x", "@team/a", "a", "@q")] == [True, True, False, False, False]
    assert not u.valid("@team/x", users_only=True) and u.refs()[0] == "@a"
    with pytest.raises(SchemaError):
        Users.parse("[1]")


def test_ids_and_dialect():
    assert [normal_id(x) for x in ("adr_001", "d/adr-001-some-slug.md", "read me.md", "ADR-1")] == ["ADR-001", "ADR-001", "READ ME", "ADR-1"]
    assert dialect(r"^\d$") == r"(?U)^\d\z" and dialect("[$]a") == "(?U)[$]a"
    for bad in ("(?=a)", r"(a)\1", "(?<!x)y"):
        with pytest.raises(ValueError):
            dialect(bad)


def test_html():
    out = to_html("# T\n\na <b>x</b> **s** `<c>` [l](javascript:x) [m](n.md) https://e.org\n\n| h |\n|---|\n| 1 |\n\n<script>no</script>\n")
    assert "<h1>T</h1>" in out and "<strong>s</strong>" in out and "<code>&lt;c&gt;</code>" in out and "<td>1</td>" in out
    assert "script" not in out.replace("javascript", "") and 'href="javascript' not in out and '<a href="n.md">m</a>' in out


def test_core_loader_is_the_only_one_changed():
    assert yaml.safe_load("a: yes") == {"a": True}
