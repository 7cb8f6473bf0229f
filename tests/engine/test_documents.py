"""Operators end to end over a set of seven documents, against answers worked out by hand."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.functions.parse import frontmatter_json, parse_documents
from inkwell.operators import diff, export, filters, graph, migrate, mutate, query, search, stats, sync, validate
from inkwell.plans.schema import Schema
from inkwell.plans.users import Users, expand_teams
from inkwell.sources import files
from inkwell.streaming.watch import Watch

SCHEMA = r"""
relation "supersedes" inverse="superseded_by" cardinality="one"
relation "enables" inverse="enabled_by"
relation "triggers" inverse="caused_by"
relation "blocks" inverse="blocked_by"
relation "related"
type "adr" folder="decisions" {
    field "title" type="string" required=#true
    field "status" type="enum" required=#true default="proposed" { values "proposed" "accepted" "superseded" }
    field "author" type="user" required=#true
    field "date" type="string" pattern="^\\d{4}-\\d{2}-\\d{2}$" default="$TODAY"
    field "tags" type="string[]"
    section "Decision" required=#true { content min-paragraphs=1 }
    section "Options" { table { column "Option" required=#true; column "Owner" type="user" } }
}
type "opp" { field "title" type="string" required=#true; field "owner" type="user" }
type "gov" { field "title" type="string" required=#true }
type "inc" { field "title" type="string" required=#true; field "minutes" type="number" }
ref-format { id pattern="^(ADR|OPP|GOV|INC)-\\d+$"; path pattern="\\.md$" }
"""
USERS = "users:\n  ann: {teams: [core]}\n  ben: {teams: [ops]}\nteams:\n  core: {}\n  ops: {}\n  all: {teams: [core, ops]}\n"
BODY = "# Decision\n\nWe keep it.\n\n# Options\n\n| Option | Owner |\n|---|---|\n| one | @ann |\n| two | @team/all |\n"


def doc(**fields):
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items()) + "---\n"


DOCS = {
    "adr-001.md": doc(type="adr", title="First", status="accepted", author='"@ann"', date='"2024-01-02"', enables="[OPP-001]", triggers="[GOV-001]", related="[ADR-002]") + BODY,
    "adr-002.md": doc(type="adr", title="Second", status="proposed", author='"@ben"', enabled_by="[ADR-001]", related="[ADR-001, OPP-001]") + "# Decision\n\nLater.\n",
    "adr-003.md": doc(type="adr", title="Third", status="superseded", author='"@ann"', superseded_by="ADR-005", caused_by="INC-001") + "# Decision\n\nSee [one](adr-001.md) and [two](./adr-002.md).\n",
    "gov-001.md": doc(type="gov", title="Rules", status="active", caused_by="[ADR-001]", blocks="[OPP-001]", enables="[ADR-002]"),
    "inc-001.md": doc(type="inc", title="Outage", status="postmortem", minutes="47", caused_by="[ADR-001]", triggers="[ADR-003]", enables="[OPP-001]", related="[GOV-001]"),
    "opp-001.md": doc(type="opp", title="Chance", status="exploring", owner='"@team/core"', enabled_by="[ADR-001, ADR-002]", triggers="[ADR-003]", blocked_by="[GOV-001]", related="[INC-001]"),
    "singleton/README.md": "# Widget\n\n## Install\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree of docs")
    for path, text in {**DOCS, ".gitignore": "drafts/\n*.tmp.md\n!keep.tmp.md\n", "drafts/adr-009.md": "x", "a.tmp.md": "x", "keep.tmp.md": "x", "note.txt": "x"}.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def docs(spark):
    return parse_documents(spark.createDataFrame(list(DOCS.items()), "path string, raw string")).cache()


@pytest.fixture(scope="module")
def net(docs):
    s = Schema.parse(SCHEMA)
    return graph.edges(docs, s).cache(), graph.nodes(docs, s).cache(), s


def col(df, name="path"):
    return sorted(r[name] for r in df.collect())


def test_scan(spark, tree):
    got = files.scan(spark, tree)
    assert col(got) == sorted([*DOCS, "keep.tmp.md"])
    assert {r.path: r.raw for r in got.collect()}["adr-001.md"] == DOCS["adr-001.md"]
    assert len(col(files.scan(spark, tree, no_ignore=True))) == 10
    assert col(files.scan(spark, tree, "adr-*")) == ["adr-001.md", "adr-002.md", "adr-003.md"]
    assert col(files.scan_names(spark, tree, ["README.md"])) == ["singleton/README.md"]
    assert col(files.scan_paths(spark, tree, ["adr-001.md", "none.md", "note.txt"])) == ["adr-001.md"]
    first = files.snapshot(got)
    changed = first.filter("path <> 'adr-001.md'").withColumn("size", F.when(F.col("path") == "adr-002.md", 1).otherwise(F.col("size")))
    assert sorted(files.stale(first, changed).collect()) == [("adr-001.md", "removed"), ("adr-002.md", "changed")]


def test_filters(docs):
    at = lambda *p: col(filters.where(docs, *map(filters.parse, p)))
    assert at("status=accepted") == ["adr-001.md"]
    assert at("type=adr,gov", "related~=ADR-001") == ["adr-002.md"]
    assert len(at("owner!=x")) == 6  # the document without frontmatter is left out
    assert col(filters.where(docs, filters.has("minutes"))) == ["inc-001.md"]
    assert len(col(filters.where(docs, ~filters.has("minutes")))) == 5
    with pytest.raises(ValueError):
        filters.parse("status")


def test_null_values_are_present(spark):
    d = parse_documents(spark.createDataFrame([("a.md", "---\nx:\ny: {z: null, w: 1.5}\n---\n"), ("b.md", "---\nbad: [\n---\nx: 1\n"), ("c.md", None)], "path string, raw string"))
    assert col(filters.where(d, filters.has("x"))) == ["a.md"] and col(filters.where(d, filters.equals("x", "null"))) == ["a.md"]
    assert col(filters.where(d, filters.equals("y.z", "null"))) == ["a.md"] and col(filters.where(d, filters.equals("y.w", "1.5"))) == ["a.md"]
    assert col(filters.where(d, filters.not_equals("q", "1"))) == ["a.md"]
    assert {r.path: r.fm_state for r in d.collect()} == {"a.md": "ok", "b.md": "error", "c.md": "absent"}
    assert d.select(frontmatter_json(d).alias("j")).first().j == '{"x":null,"y":{"w":1.5,"z":null}}'


def test_list_and_read(docs):
    out = query.listing(docs.filter("fm_state = 'ok'"), sort="-type", fields=["type"]).collect()
    assert [r.path for r in out] == ["opp-001.md", "inc-001.md", "gov-001.md", "adr-001.md", "adr-002.md", "adr-003.md"]
    for sort in ("-type", "status", "none"):
        order = [r.path for r in query.listing(docs, sort=sort).collect()]
        assert {r.path: r.pos for r in query.positions(docs, sort).collect()} == {p: k + 1 for k, p in enumerate(order)}
    t = query.tables(docs, ["options"])
    assert query.column(t, "Owner").first()["values"] == ["@ann", "@team/all"] and query.cell(t, "Option", 1).first().value == "two"
    assert query.cell(t, "Option", 9).count() == 0 and query.column(t, "owner").count() == 0
    assert query.section(docs, ["Widget", "INSTALL"]).count() == 1 and query.section(docs, ["Install"]).count() == 1
    assert query.documents_json(docs).count() == 7


def test_validation(docs, spark):
    s, u = Schema.parse(SCHEMA), Users.parse(USERS)
    got = validate.validate(docs, s, u).collect()
    assert [(r.path, r.code, r.severity, r.location) for r in got] == [("adr-003.md", "R011", "warning", "frontmatter.superseded_by")]
    one = validate.summary(docs, validate.validate(docs, s, u), s).first()
    assert tuple(one) == (6, 6, 0, 0, 1)


def test_faults(spark):
    s, u = Schema.parse(SCHEMA + 'type "only" singleton=#true { match "README.md"; section "Use" required=#true; section "More" }\ntype "gone" singleton=#true { match "GONE.md"; section "X" required=#true }\ntype "maybe" singleton=#true { match "M.md"; section "X" }'), Users.parse(USERS)
    rows = {
        "a/adr-1.md": doc(type="adr", title="5", status="Accepted", author="ann", tags="[a, 3]", date='"2024-1-1"', enables="[1, X, ./adr-2.md, ./none.md]", supersedes="[ADR-1]") + "# Options\n\n| Owner |\n|---|\n| @zoe |\n",
        "a/adr-2.md": doc(type="adr", title="t", status="accepted", author='"@zoe"') + "# Decision\n\n# Options\n\nno table\n",
        "b.md": doc(type="nope"), "c.md": "---\nx: [\n---\n", "d.md": "none", "e.md": doc(title="no type"), "README.md": "# Other\n",
    }
    d = parse_documents(spark.createDataFrame(list(rows.items()), "path string, raw string"))
    got = sorted((r.path, r.code, r.location.replace("frontmatter", "fm")) for r in validate.validate(d, s, u).collect())
    assert got == sorted(
        [
            ("GONE.md", "T020", "file"), ("README.md", "S010", "document body"), ("b.md", "F002", "fm.type"), ("c.md", "E000", "file"),
            ("a/adr-1.md", "F020", "fm.title"), ("a/adr-1.md", "F021", "fm.status"), ("a/adr-1.md", "U010", "fm.author"), ("a/adr-1.md", "F020", "fm.tags[1]"),
            ("a/adr-1.md", "F030", "fm.date"), ("a/adr-1.md", "F020", "fm.enables[0]"), ("a/adr-1.md", "R001", "fm.enables[1]"), ("a/adr-1.md", "R010", "fm.enables[3]"),
            ("a/adr-1.md", "F020", "fm.supersedes"), ("a/adr-1.md", "S010", "document body"), ("a/adr-1.md", "S021", 'section "Options" > table'),
            ("a/adr-1.md", "U011", "fm.table:Options.Owner.row0"), ("a/adr-2.md", "U011", "fm.author"), ("a/adr-2.md", "S030", 'section "Decision"'),
        ]
    )
    single = sorted((r.path, r.code) for r in validate.document_state(d, s, single=True).collect())
    assert single == [("b.md", "F002"), ("c.md", "E000"), ("d.md", "F000"), ("e.md", "F001")]


def test_a_pattern_that_does_not_compile(spark):
    s = Schema.parse('type "t" { field "f" type="string" pattern="(" }')
    d = parse_documents(spark.createDataFrame([("a.md", doc(type="t", f="x"))], "path string, raw string"))
    assert [(r.code, r.location) for r in validate.validate(d, s).collect()] == [("S000", "schema")]
    assert validate.validate(d.filter("false"), s).count() == 0


def test_graph(net):
    e, n, s = net
    assert e.count() == 22 and n.count() == 6
    by = {r.relation: r["count"] for r in e.groupBy("relation").count().collect()}
    assert by == {"related": 5, "enables": 3, "triggers": 3, "enabled_by": 3, "caused_by": 3, "inline_ref": 2, "superseded_by": 1, "blocks": 1, "blocked_by": 1}
    d = {r.id: (r.n_in, r.n_out) for r in graph.degrees(e).collect()}
    assert {k: v[0] for k, v in d.items()} == {"ADR-001": 6, "ADR-002": 4, "OPP-001": 4, "GOV-001": 3, "ADR-003": 2, "INC-001": 2, "ADR-005": 1}
    assert graph.ranked(graph.degrees(e), "n_out").first().id == "OPP-001"
    count = lambda id_, k, back=False: graph.walk(e, n.filter(F.col("id") == id_).select("id"), k, back).count()
    assert [count("ADR-001", k) for k in (1, 2, 3)] == [3, 14, 22] and [count("GOV-001", k, True) for k in (1, 2)] == [3, 15]
    assert [(r.code, r.severity) for r in graph.health(e, n, s).collect()] == [("G030", "error")]
    assert graph.next_id(n, "adr").first().next_id == "ADR-004" and graph.next_id(n, "zzz").first().next_id == "ZZZ-001"
    assert graph.refs_to(e, "inc_001").count() == 2


def test_health(spark):
    e = spark.createDataFrame([("A", "B", "next", 0), ("B", "C", "next", 1), ("C", "A", "next", 2), ("D", "D", "x", 0), ("F", "G", "prev", 0), ("G", "F", "next", 0)], "from string, to string, relation string, ord long")
    n = spark.createDataFrame([(i, None, None, None, None) for i in "ABCDEFG"], "id string, path string, type string, title string, status string")
    s = Schema.parse('relation "next" inverse="prev" acyclic=#true\nrelation "x"')
    got = [(r.code, r.message) for r in graph.health(e, n, s).collect()]
    assert [c for c, _ in got] == ["G011", "G010", "G010", "G020", "G021"]
    assert [m for c, m in got if c == "G010"] == ["cycle: A -> B -> C -> A", "cycle: F -> G -> F"]
    assert got[-1][1] == "4 parts: A+2; F+1; and 2 more"
    assert len([1 for r in graph.health(e, n, s, normalised=True).collect() if r.code == "G010"]) == 1
    assert {r.id: r.component for r in graph.components(e, n).collect()} == dict(zip("ABCDEFG", "AAADEFF", strict=True))


def test_sync(docs, net):
    e, n, s = net
    actions, warnings = sync.plan(e, n, s)
    assert sorted((r.id, r.field, tuple(r.refs)) for r in actions.collect()) == [
        ("ADR-001", "enables", ("ADR-002",)), ("ADR-001", "triggers", ("INC-001",)), ("ADR-002", "enabled_by", ("GOV-001",)),
        ("ADR-002", "enables", ("OPP-001",)), ("ADR-003", "caused_by", ("OPP-001",)), ("OPP-001", "enabled_by", ("INC-001",)),
    ]
    assert warnings.count() == 0
    new = sync.apply(docs, actions)
    after = parse_documents(docs.select("path", "raw").join(new.select("path"), "path", "left_anti").unionByName(new)).cache()
    assert sync.plan(graph.edges(after, s), graph.nodes(after, s), s)[0].count() == 0
    assert after.filter("path = 'adr-003.md'").first().fields["caused_by"]["display"] == "[INC-001, OPP-001]"


def test_a_field_for_one_takes_one(spark):
    s = Schema.parse('relation "a" inverse="b" cardinality="one"')
    d = parse_documents(spark.createDataFrame([("x-1.md", doc(a="Z-1")), ("x-2.md", doc(a="Z-1")), ("z-1.md", doc(t="1"))], "path string, raw string"))
    actions, warnings = sync.plan(graph.edges(d, s), graph.nodes(d, s), s)
    assert [tuple(r) for r in actions.collect()] == [("Z-1", "b", ["X-1"])] and [tuple(r) for r in warnings.collect()] == [("Z-1", "b", "X-1", "X-2")]


def test_search(docs):
    got = search.search(docs, "ADR-001")
    assert {(r.path, r.section) for r in got.collect()} >= {("adr-002.md", "frontmatter"), ("adr-003.md", "Decision")}
    assert search.search(docs, "keep it", section="decision").first().line == 13
    assert col(search.search(docs, "first", field="TITLE")) == ["adr-001.md"]
    assert search.search(docs, "First", case_sensitive=True).count() == 1 and search.search(docs, "FIRST", case_sensitive=True).count() == 0
    assert len(set(col(search.search(docs, "e", max_results=2)))) == 2
    with pytest.raises(ValueError):
        search.search(docs, "")


def test_diff(spark, docs):
    new = parse_documents(docs.select("path", F.replace(F.replace("raw", F.lit("title: First"), F.lit("title: 1st\nextra: 1")), F.lit("We keep it."), F.lit("We keep it.\nWe do.")).alias("raw")))
    assert sorted((r.field, r.change) for r in diff.fields(docs, new).collect()) == [("extra", "added"), ("title", "changed")]
    assert [(r.section, r.change, r.lines_added, r.lines_removed) for r in diff.sections(docs, new).collect()] == [("Decision", "modified", 1, 0)]
    assert diff.fields(docs, docs).count() == 0 and diff.sections(docs, docs).count() == 0


def test_changes(spark, docs):
    s = Schema.parse(SCHEMA)
    new, target = mutate.rename(docs, s, "adr-001.md", "ADR-100")
    assert target == "adr-100.md" and col(new) == ["adr-002.md", "gov-001.md", "inc-001.md", "opp-001.md"]
    assert "ADR-100" in new.filter("path = 'gov-001.md'").first().raw
    some = docs.filter("path = 'adr-001.md'")
    assert "| two | @ben |" in mutate.set_cell(some, ["Options"], "Owner", 1, "@ben").first().raw
    assert "| a, b | c |" in mutate.add_row(some, ["Options"], mutate.parse_cells("a\\, b, c")).first().raw
    assert "Gone." in mutate.replace_section(some, ["Decision"], "Gone.").first().raw and "We keep" not in mutate.replace_section(some, ["Decision"], "Gone.").first().raw
    assert mutate.replace_section(some, ["None"], "x").first().raw == DOCS["adr-001.md"]
    assert "status: superseded\nsuperseded_by: ADR-002" in mutate.deprecate(docs, "adr-001.md", "adr_002").first().raw
    assert "title" not in mutate.remove_field(some, "title").first().raw
    bare = mutate.set_fields(docs.filter("path like '%README.md'"), {"n": "1", "s": "x"}).first().raw
    assert bare == "---\nn: 1\ns: x\n---\n# Widget\n\n## Install\n"
    with pytest.raises(ValueError):
        mutate.batch(docs, [], {"a": "b"})
    assert mutate.batch(docs, [filters.equals("type", "adr")], {"x": "1"}).count() == 3
    t = parse_documents(spark.createDataFrame([("decisions/adr-9.md", mutate.template(s, "adr", {"title": "T"}))], "path string, raw string"))
    assert {r.code for r in validate.validate(t, s).collect()} <= {"S030"}
    assert mutate.new_document(spark, graph.nodes(docs, s), s, "adr").first().path == "decisions/adr-004.md"


def test_migration(docs):
    old = Schema.parse(SCHEMA)
    new = Schema.parse(SCHEMA.replace('"proposed" "accepted"', '"accepted"').replace('field "tags" type="string[]"', 'field "day" type="string" default="$TODAY"').replace('section "Options"', 'section "History"\n section "Options"').replace('type "inc" {', 'type "inc" { field "x" type="string";'))
    plan = migrate.plan(docs, old, new)
    assert sorted((r.kind, r.type, r.name, r.value) for r in migrate.summarised(plan).collect()) == [("add_field", "adr", "day", "$TODAY"), ("add_section", "adr", "History", None), ("removed_enum_value", "adr", "status", "proposed")]
    after = parse_documents(migrate.apply(docs, plan))
    assert [r.kind for r in migrate.plan(after, old, new).collect()] == ["removed_enum_value"]
    assert after.first().fields["day"]["display"] == mutate.today()


def test_stats_and_pages(docs, net, tmp_path):
    e, n, _ = net
    assert {(r.type, r.status): r.n for r in stats.by_type_status(docs).collect()}["adr", None] == 3
    one = stats.summary(docs, e, n).first()
    assert (one.documents, one.edges, one.orphans, one.most_referenced, one.most_referring) == (6, 22, 0, "ADR-001", "OPP-001")
    assert stats.summary(docs.filter("false"), e.filter("false"), n.filter("false")).first().documents == 0
    export.site(docs, e, n, str(tmp_path))
    assert 'href="gov-001.html">GOV-001</a> blocks' in (tmp_path / "opp-001.html").read_text() and "<h2>adr</h2>" in (tmp_path / "index.html").read_text()
    assert graph.mermaid(e, n).first().line == "graph LR" and graph.dot(e, n).collect()[-1].line == "}"
    assert query.inspect(docs, validate.validate(docs, Schema.parse(SCHEMA))).count() == 7


def test_teams_with_cycles(spark):
    u = Users.parse("users:\n  a: {teams: [x]}\nteams:\n  x: {teams: [y]}\n  y: {teams: [x]}\n  z: {teams: [y]}\n")
    f = u.frames(spark)
    got = {(r.team, r.handle) for r in expand_teams(f["user_teams"], f["team_teams"]).collect()}
    assert got == {(t, h) for t in ("x", "y", "z") for h in u.members(t)}


def test_watch(spark, tmp_path):
    s, drops = Schema.parse(SCHEMA), str(tmp_path / "drops")
    put = lambda rows: spark.createDataFrame(rows, "path string, raw string, version long").write.mode("append").parquet(drops)
    w = Watch(spark, s, "file://" + str(tmp_path / "state"))
    put([(p, t, 1) for p, t in DOCS.items()])
    w.start(drops, once=True).awaitTermination()
    assert [r.code for r in w.diagnostics().collect()] == ["R011"]
    put([("adr-003.md", DOCS["adr-003.md"].replace("ADR-005", "ADR-001"), 2), ("gov-001.md", doc(type="gov"), 2), ("opp-001.md", None, 3)])
    w.start(drops, once=True).awaitTermination()
    assert [(r.path, r.code) for r in w.diagnostics().collect()] == [("gov-001.md", "F010")] and w.documents().count() == 6
    w.step(w.documents(), 0)  # a batch that is repeated changes nothing
    assert w.documents().count() == 6 and os.path.isdir(tmp_path / "state")
