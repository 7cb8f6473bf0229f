"""Work and memory that must not grow faster than what comes in, or out."""

import random
import time

import pyarrow as pa
import yaml
from pyspark.sql import functions as F

from inkwell.functions import frontmatter as fm
from inkwell import queries
from inkwell.functions.parse import CHARS, ROWS, parse_documents, parse_graph, slices
from inkwell.operators import graph, validate
from inkwell.operators.mutate import set_fields
from inkwell.plans.schema import Schema
from inkwell.plans.users import expand_teams


def test_team_chain_takes_the_work_of_its_pairs(spark):
    n = 1500
    teams = spark.range(n).select(F.concat(F.lit("t"), "id").alias("team"), F.concat(F.lit("u"), "id").alias("handle"))
    inside = spark.range(1, n).select(F.concat(F.lit("t"), F.col("id") - 1).alias("team"), F.concat(F.lit("t"), "id").alias("sub_team"))
    began = time.time()
    got = expand_teams(teams, inside).groupBy("team").count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert tuple(got) == (n, n * (n + 1) // 2, n)
    assert time.time() - began < 90, "all paths were joined, not the pairs"


def test_teams_in_cycles_diamonds_and_with_users_of_several(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("b", "e"), ("e", "f"), ("f", "f"), ("x", "y"), ("y", "z"), ("x", "z")]
    members = [("a", "1"), ("c", "1"), ("f", "2"), ("z", "3"), ("z", "3"), ("y", "3"), ("lone", "4"), ("z", None), ("y", None)]
    got = sorted(map(tuple, expand_teams(spark.createDataFrame(members, "team string, handle string"), spark.createDataFrame(edges, "team string, sub_team string")).collect()), key=str)
    reach = {t: {t} for t in {x for e in edges for x in e} | {m[0] for m in members}}
    while True:
        new = {t: r | {b for a, b in edges if a in r} for t, r in reach.items()}
        if new == reach:
            break
        reach = new
    assert got == sorted({(t, h) for t, r in reach.items() for m, h in members if m in r}, key=str)


def test_parsing_and_rewriting_hold_few_documents_at_once(spark):
    """Arrow batches of any size are parsed piece by piece."""
    one = "---\ntype: t\n---\n# A\n\n" + "word " * 60 + "\n"
    rows = [(f"a/t-{i}.md", one if i else one + "x" * (3 * CHARS)) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in (0, 1)], ["path", "raw"])
    pieces = list(slices(batch, "raw"))
    assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist()
    assert max(len(p) for p in pieces) <= ROWS
    assert all(len(p) == 1 or sum(map(len, p.column(1).to_pylist())) <= CHARS for p in pieces)
    assert list(slices(batch.slice(0, 0), "raw")) == [] and [len(p) for p in slices(pa.RecordBatch.from_arrays([pa.nulls(300, pa.string())], ["raw"]), "raw")] == [ROWS, 300 - ROWS]
    sent = spark.createDataFrame(rows, "path string, raw string").coalesce(1)
    count = lambda d: d.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").agg(F.sum("n")).first()[0]
    assert count(parse_documents(sent)) == count(set_fields(sent, {"status": "x"})) == len(rows)


def test_plain_frontmatter_is_read_and_rendered_as_by_the_library():
    words = ["a", "null", "TRUE", "yes", "~", "0", "07", "12", "1.5", "1e5", "0x1f", "0o17", "2024-01-01", "12:30", "a  b", "a #b", "a#b", "-x", "@u1", "a: b", "a,b", "[x]", "*a", "!t", "é", "\x85", "...", "<<", "NaN", "1-2", "+1", "9" * 400, "# c", " a", "a ", "?", "", "'q'", '"q"', "x\\n"]
    draw, read, put = random.Random(5), 0, 0
    one = lambda: draw.choice(["{}", "{}", '"{}"', "'{}'"]).format(draw.choice(words))
    many = lambda mark, end: mark + ", ".join(one() for _ in range(draw.randint(0, 3))) + end
    nested = lambda: "\n" + "\n".join(draw.choice(["  - ", "  - ", "  k: ", "  j: ", " - "]) + one() for _ in range(draw.randint(0, 3)))
    for _ in range(20000):
        block = "\n".join(f"{draw.choice(['a', 'b', 'c_d', 'true', '1', 'yes'])}:{draw.choice([lambda: ' ' + one(), lambda: ' ' + one(), lambda: many(' [', ']'), nested])()}" for _ in range(draw.randint(1, 3))) + "\n"
        got = fm.plain_fields(block)
        if got is not None:
            read += 1
            assert repr(got) == repr({fm.display(k): v for k, v in yaml.load(block, Loader=fm.CoreLoader).items()}), block
        value = {k: draw.choice([lambda: draw.choice(words), lambda: draw.choice([1, -5, True, None, 1.5]), lambda: draw.choices(words, k=2), lambda: {"k": draw.choice(words)}])() for k in draw.sample(["a", "no", "null", "x1", "y"], 2)}
        assert fm.to_yaml(value) == fm.slow_yaml(value)
        put += fm._put_plain(value, "", [], set())
    assert read > 1000 and put > 1000, "most of these are to be plain"


def test_columns_asked_for_are_those_that_come(spark):
    files = spark.createDataFrame([("a/t-1.md", "---\ntype: t\nsee: T-2\n---\n# A\n\n[x](t-2.md)\n"), ("a/t-2.md", "[y](t-1.md)\n"), ("b/t-2.md", "---\ntype: t\n---\n"), ("a/t-3.md", "[z](t-1.md)\n")], "path string, raw string")
    all_, some = parse_documents(files), parse_documents(files, ["fm_state", "links"])
    assert set(some.columns) == {"path", "fields", "fm_state", "links", "file_name", "id", "type", "title", "status"}
    assert sorted(map(str, all_.select(some.columns).collect())) == sorted(map(str, some.collect()))
    schema = Schema.parse('type "t" { field "see" type="ref" }\nrelation "see"')
    # a/t-2 is no node itself, but its id is one; t-3 is none
    assert sorted((r["from"], r["to"], r.relation) for r in graph.edges(some, schema).collect()) == [("T-1", "T-2", "see"), ("T-2", "T-1", "inline_ref")]


_ODD = [
    ("a/t-1.md", "---\ntype: t\nstatus: null\nsee: [t-2, 3, null, T-2]\nback: T-9\n---\n# A\n\n[x](t-2.md) [x](t-3.md) <a@b.cd>\n\n[r]: t-4.md\n"),
    ("a/t-2.md", "[y](t-1.md) and [r]\n\n| a |\n| - |\n| [z](t-3.md) |\n\n[r]: t-1.md\n"),
    ("b/t-2.md", "---\ntype: t\ntitle: 007\nback: 4\nsee: {a: b}\n---\n## [h](t-1.md)\n\n`[c](t-9.md)`\n"),
    ("a/t-3.md", "---\ntype: [x\n---\n[z](t-1.md)\n"),
    ("a/t-4.md", None),
    ("a/t-5.md", "---\nsee: ''\nback: [[T-1], T-1]\n---\nno links\n"),
]


def test_the_graph_pass_gives_the_nodes_and_edges_of_the_whole_parse(spark):
    files = spark.createDataFrame(_ODD, "path string, raw string")
    schema = Schema.parse('type "t" { field "see" type="ref" }\nrelation "see" inverse="back" cardinality="many"')
    whole, few = parse_documents(files), parse_graph(files, schema.relation_names())
    assert "fields" not in few.columns and "sections" not in few.columns
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(graph.nodes(whole)) == rows(graph.nodes(few))
    assert rows(graph.edges(whole, schema)) == rows(graph.edges(few, schema)) and graph.edges(few, schema).count() > 6
    assert rows(whole.select("path", "links")) == rows(few.select("path", "links"))


def test_a_walk_writes_nothing_after_its_last_step(spark, monkeypatch):
    tags = []
    put = graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: tags.append(tag) or put(df, tag))
    e = spark.createDataFrame([("A", "B", "r"), ("B", "C", "r"), ("C", "D", "r"), ("A", "B", "r")], "from string, to string, relation string")
    got = graph.walk(e, spark.createDataFrame([("A",)], "id string"), 2)
    assert sorted(map(tuple, got.collect())) == [("A", 1, "A", "B", "r"), ("A", 2, "B", "C", "r")]
    assert tags.count("walk-step") == tags.count("walk-frontier") == 1


def test_sections_of_some_fields_are_those_of_the_whole_parse(spark):
    files = spark.createDataFrame(_ODD, "path string, raw string")
    whole, some = parse_documents(files), parse_documents(files, validate.COLUMNS, validate.SECTION)
    assert {"raw", "body", "links"}.isdisjoint(some.columns)
    cut = whole.select(*[c for c in some.columns if c != "sections"], F.transform("sections", lambda x: F.struct(*[x[k].alias(k) for k in some.schema["sections"].dataType.elementType.names])).alias("sections"))
    assert sorted(map(str, cut.select(some.columns).collect())) == sorted(map(str, some.collect()))


def test_fixes_parse_only_what_they_mended_again(spark, monkeypatch):
    parsed = []
    parse = queries.parse_documents
    monkeypatch.setattr(queries, "parse_documents", lambda files, *a: parsed.append(files.count()) or parse(files, *a))
    sf = "/root/testdata/sf0.001"
    queries.QUERIES["fix_apply"](spark, sf).collect()
    assert sum(parsed) < spark.read.parquet(f"{sf}/part.parquet").count()
