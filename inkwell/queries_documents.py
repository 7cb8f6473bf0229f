"""More queries of the document operators: scans, faults, exports, changes, over whole star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus
from .functions.parse import frontmatter_json, parse_documents, parse_frontmatter
from .operators import export, filters, graph, mutate, query, render, search, stats, validate
from .plans.schema import Schema
from .plans.users import expand_teams
from .queries import _P, _T, _add, _shown, _table
from .sources import files
from .sources.storage import new_path, written

#: Nations with a text, and regions: a small set of documents that link to each other.
_GEO = """
select format_string('nation/nat-%03d.md', n_nationkey) path, concat('---\\ntype: nation\\ntitle: "', n_name, '"\\nin_region: ', format_string('REG-%03d', n_regionkey), '\\n---\\n# About\\n\\nNear ', format_string('REG-%03d', n_regionkey), '.\\n\\n# Coast\\n\\nIt lies near the sea.\\n') raw from {nation}
union all select format_string('region/reg-%03d.md', r_regionkey), concat('---\\ntype: region\\ntitle: "', r_name, '"\\n---\\n') from {region}
"""
_NAT, _REG = "printf('nation/nat-%03d.md', n_nationkey)", "printf('region/reg-%03d.md', r_regionkey)"
_NRAW = "concat('---', chr(10), 'type: nation', chr(10), 'title: \"', n_name, '\"', chr(10), 'in_region: ', printf('REG-%03d', n_regionkey), chr(10), '---', chr(10), '# About', chr(10), chr(10), 'Near ', printf('REG-%03d', n_regionkey), '.', chr(10), chr(10), '# Coast', chr(10), chr(10), 'It lies near the sea.', chr(10))"
_RRAW = "concat('---', chr(10), 'type: region', chr(10), 'title: \"', r_name, '\"', chr(10), '---', chr(10))"


def _geo_files(spark, sf_dir) -> DataFrame:
    return corpus._sql(spark, sf_dir, _GEO)


def _geo(spark, sf_dir) -> DataFrame:
    return written(parse_documents(_geo_files(spark, sf_dir)), "geo")


# scans


@_add(
    f"""with n as (select {_NAT} as path, {_NRAW} as raw from nation), r as (select {_REG} as path, {_RRAW} as raw from region)
    select 'ignoring' as scan, * from n union all select 'all', * from n union all select 'all', * from r union all select 'named', * from r where path = 'region/reg-001.md'
    union all select 'listed', * from n where path = 'nation/nat-002.md' union all select 'one', 'given.md', 'text'"""
)
def scans(spark, sf_dir):
    """Documents written to files, and read by each kind of scan; regions are in the ignore file."""
    root = new_path(spark, "tree")
    files.write_files(_geo_files(spark, sf_dir).unionByName(files.one(spark, "region/\n", ".gitignore")), root)
    found = [
        ("ignoring", files.scan(spark, root)),
        ("all", files.scan(spark, root, no_ignore=True)),
        ("named", files.scan_names(spark, root, ["reg-001.md"])),
        ("listed", files.scan_paths(spark, root, ["nation/nat-002.md", "gone.md"])),
        ("one", files.one(spark, "text", "given.md")),
    ]
    out = None
    for name, d in found:
        d = d.select(F.lit(name).alias("scan"), "path", "raw")
        out = d if out is None else out.unionByName(d)
    return out


@_add(
    f"""select {_P} as path, case when p_partkey % 10 = 0 then 'added' when p_partkey % 11 = 0 then 'removed' else 'changed' end as change from part
    where (p_partkey % 10 = 0) <> (p_partkey % 11 = 0) or p_partkey % 10 <> 0 and p_partkey % 7 = 0"""
)
def snapshot_changes(spark, sf_dir):
    """Metadata snapshots of two versions: some files come, some go, some are longer."""
    parts = corpus._sql(spark, sf_dir, "select format_string('part/part-%06d.md', p_partkey) path, p_partkey k, p_name raw, timestamp '2024-01-01' mtime, cast(length(p_name) as bigint) size from {part}")
    old = files.snapshot(parts.filter("k % 10 <> 0"))
    new = files.snapshot(parts.filter("k % 11 <> 0").withColumn("size", F.expr("size + if(k % 7 = 0, 1, 0)")))
    return files.stale(old, new)


@_add(f"select {_P} as path, cast(p_partkey % 3 = 0 as boolean) as other from part")
def content_hash(spark, sf_dir):
    """Whether the hash of a document's text differs after some texts were changed."""
    parts = corpus.part_files(spark, sf_dir).withColumns({"mtime": F.lit("2024-01-01").cast("timestamp"), "size": F.octet_length("raw").cast("long")})
    third = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int") % 3 == 0
    a, b = files.snapshot(parts), files.snapshot(parts.withColumn("raw", F.when(third, F.concat("raw", F.lit("!"))).otherwise(F.col("raw"))))
    return a.join(b.withColumnRenamed("hash", "h"), "path").select("path", (F.col("hash") != F.col("h")).alias("other"))


@_add(f"select {_P} as path, cast(11 + (p_partkey % 13 <> 0)::int + (p_size % 5 = 0 and p_partkey % 2 = 0)::int + (p_size > 25)::int as bigint) as lines from part")
def body_offset(spark, sf_dir):
    return corpus.part_heads(spark, sf_dir).select("path", F.col("body_line_offset").cast("long").alias("lines"))


@_add(
    f"""select {_P} as path, k.f as field, k.k as kind from part, (values ('title', 'string', 0), ('kind', 'string', 0), ('status', 'string', 0), ('spec', 'mapping', 0), ('bulky', 'bool', 1), ('size', 'number', 2)) k(f, k, c) where c = 0 or c = 1 and p_size > 25 or c = 2 and p_partkey % 17 <> 0
    union all select {_P}, 'size', 'string' from part where p_partkey % 17 = 0"""
)
def value_kinds(spark, sf_dir):
    out = corpus.part_heads(spark, sf_dir).select("path", F.explode("fields").alias("field", "v"))
    return out.filter("field in ('title', 'kind', 'status', 'spec', 'bulky', 'size')").select("path", "field", "v.kind")


@_add(
    """select printf('a/cust-%06d.md', c_custkey) as path, case c_custkey % 5 when 1 then 'F000' when 2 then 'E000' when 3 then 'F001' when 4 then 'F002' end as code,
    case c_custkey % 5 when 1 then 'frontmatter' when 2 then 'file' when 3 then 'frontmatter' else 'frontmatter.type' end as location from customer where c_custkey % 5 > 0"""
)
def val_document_state(spark, sf_dir):
    """Single documents without frontmatter, with malformed frontmatter, without a type, of an unknown one."""
    names = {"customer": f"parquet.`{sf_dir}/customer.parquet`"}
    raw = spark.sql(
        """select format_string('a/cust-%06d.md', c_custkey) path, case c_custkey % 5 when 0 then '---\\ntype: customer\\n---\\n' when 1 then 'Only text.\\n' when 2 then '---\\ntitle: [a\\n---\\n' when 3 then '---\\ntitle: x\\n---\\n' else '---\\ntype: ghost\\n---\\n' end raw from {customer}""".format(**names)
    )
    return validate.document_state(parse_frontmatter(raw), corpus.link_schema(), single=True).select("path", "code", "location")


@_add(f"select {_NAT} as path, 'S000' as code, 'warning' as severity, 'schema' as location from nation")
def val_bad_pattern(spark, sf_dir):
    schema = Schema.parse('type "nation" { field "title" type="string" pattern="(" }')
    return _shown(validate.field_checks(_geo(spark, sf_dir), schema).filter("code is not null"))


@_add("select printf('note/part-%06d.md', p_partkey) as path, 'R010' as code, 'error' as severity, 'frontmatter.see' as location from part where 3 * p_partkey not in (select p_partkey from part)")
def val_ref_paths(spark, sf_dir):
    """References by path, from the document's folder or from the root."""
    schema = Schema.parse('type "note" { field "see" type="ref" }\nref-format { path pattern="\\\\.md$" }')
    raw = corpus._sql(spark, sf_dir, "select format_string('note/part-%06d.md', p_partkey) path, concat('---\\ntype: note\\nsee: ', if(p_partkey % 2 = 0, '/note/', '../note/./'), format_string('part-%06d.md', 3 * p_partkey), '\\n---\\n') raw from {part}")
    docs = written(parse_frontmatter(raw), "notes")
    return _shown(validate.resolve_refs(validate.field_checks(docs, schema), docs, schema))


@_add("select printf('r%d/LEAFLET.md', r_regionkey) as path, 'S010' as code, 'error' as severity, 'document body' as location from region where r_regionkey % 2 = 1")
def val_singletons(spark, sf_dir):
    """Files of a singleton's name are of its type, whatever their folder."""
    raw = corpus._sql(spark, sf_dir, "select concat('r', r_regionkey, '/LEAFLET.md') path, if(r_regionkey % 2 = 0, '# About\\n\\nText.\\n', '# Other\\n') raw from {region}")
    return _shown(validate.validate(written(parse_documents(raw), "leaflets"), corpus.part_schema()))


# whole documents, search, tables


@_add(
    f"""select {_NAT} as path, concat('{{"frontmatter":{{"in_region":"', printf('REG-%03d', n_regionkey), '","title":"', n_name, '","type":"nation"}},"path":"', {_NAT}, '","sections":[{{"heading":"About","level":1,"content":"\\nNear ', printf('REG-%03d', n_regionkey), '.\\n\\n"}},{{"heading":"Coast","level":1,"content":"\\nIt lies near the sea.\\n"}}],"body":"# About\\n\\nNear ', printf('REG-%03d', n_regionkey), '.\\n\\n# Coast\\n\\nIt lies near the sea.\\n"}}') as json from nation
    union all select {_REG}, concat('{{"frontmatter":{{"title":"', r_name, '","type":"region"}},"path":"', {_REG}, '","sections":[],"body":""}}') from region"""
)
def documents_whole(spark, sf_dir):
    return query.documents_json(_geo(spark, sf_dir))


@_add(
    f"""select {_NAT} as path, printf('NAT-%03d', n_nationkey) as id, 'nation' as type, concat('{{"in_region":"', printf('REG-%03d', n_regionkey), '","title":"', n_name, '","type":"nation"}}') as frontmatter,
    '[{{"heading":"About","level":1,"content_length":16}},{{"heading":"Coast","level":1,"content_length":23}}]' as sections, '[]' as diagnostics from nation
    union all select {_REG}, printf('REG-%03d', r_regionkey), 'region', concat('{{"title":"', r_name, '","type":"region"}}'), '[]', '[]' from region"""
)
def inspect_whole(spark, sf_dir):
    docs = _geo(spark, sf_dir)
    return query.inspect(docs, validate.validate(docs, corpus.link_schema()))


@_add(
    f"""with n as (select {_NAT} as path, n_name, n_regionkey from nation order by 1 limit 7) select path, n_name as id, cast(0 as bigint) as match_ord, 'About' as section, cast(8 as bigint) as line, concat('Near ', printf('REG-%03d', n_regionkey), '.') as context from n
    union all select path, n_name, 1, 'Coast', 12, 'It lies near the sea.' from n"""
)
def search_limited(spark, sf_dir):
    """A limit is of documents, the first by path; matches are numbered as they stand."""
    out = search.search(_geo(spark, sf_dir), "NEAR", max_results=7)
    return out.withColumns({"match_ord": F.col("match_ord").cast("long"), "line": F.col("line").cast("long")})


@_add(f"select {_P} as path, concat('second|', p_size, '|@u2') as cells {_T}")
def table_row(spark, sf_dir):
    return query.row(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]), 1).select("path", F.array_join("cells", "|").alias("cells"))


@_add(f"select {_P} as path, 'second' as value {_T}")
def table_cell_by_name(spark, sf_dir):
    return query.cell(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]), *query.parse_cell("Brand,1")).select("path", "value")


@_add("""select 'json' as format, concat('[', string_agg(concat('{"path": "', printf('region/reg-%03d.md', r_regionkey), '", "title": "', r_name, '"}'), ', ' order by r_regionkey), ']') as text from region
union all select 'compact', concat('path', chr(9), 'title', chr(10), string_agg(concat(printf('region/reg-%03d.md', r_regionkey), chr(9), r_name), chr(10) order by r_regionkey)) from region
union all select 'markdown', concat('| path | title |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', printf('region/reg-%03d.md', r_regionkey), ' | ', r_name, ' |'), chr(10) order by r_regionkey)) from region""")
def list_formats(spark, sf_dir):
    out = written(query.listing(_geo(spark, sf_dir), filters.equals("type", "region"), fields=["title"]), "shown").orderBy("path")
    return spark.createDataFrame([(f, render.rows(out, f)) for f in ("json", "compact", "markdown")], "format string, text string")


# pages


@_add(
    f"""with b as (select n_regionkey as k, concat('<section><h2>Backlinks</h2><ul>', string_agg(concat('<li><a href="nat-', printf('%03d', n_nationkey), '.html">', printf('NAT-%03d', n_nationkey), '</a> in_region</li>'), '' order by n_nationkey), '</ul></section>') as links from nation group by 1)
    select {_REG} as path, concat('<!doctype html><html><head><meta charset="utf-8"><title>', r_name, '</title></head><body><table><tr><th>title</th><td>', r_name, '</td></tr><tr><th>type</th><td>region</td></tr></table>', coalesce(links, ''), '</body></html>') as html from region left join b on k = r_regionkey
    union all select {_NAT}, concat('<!doctype html><html><head><meta charset="utf-8"><title>', n_name, '</title></head><body><table><tr><th>in_region</th><td><a href="reg-', printf('%03d', n_regionkey), '.html">', printf('REG-%03d', n_regionkey), '</a></td></tr><tr><th>title</th><td>', n_name, '</td></tr><tr><th>type</th><td>nation</td></tr></table><h1>About</h1>', chr(10), '<p>Near <a href="reg-', printf('%03d', n_regionkey), '.html">', printf('REG-%03d', n_regionkey), '</a>.</p>', chr(10), '<h1>Coast</h1>', chr(10), '<p>It lies near the sea.</p></body></html>') from nation"""
)
def export_pages(spark, sf_dir):
    """Whole pages, with links for ids, and with backlinks."""
    docs, schema = _geo(spark, sf_dir), corpus.link_schema()
    return export.pages(docs, graph.edges(docs, schema), graph.nodes(docs, schema))


@_add("""select 'nation' as type, concat('<h2>nation</h2><ul>', string_agg(concat('<li><a href="nat-', printf('%03d', n_nationkey), '.html">', n_name, '</a></li>'), '' order by n_nationkey), '</ul>') as html from nation
union all select 'region', concat('<h2>region</h2><ul>', string_agg(concat('<li><a href="reg-', printf('%03d', r_regionkey), '.html">', r_name, '</a></li>'), '' order by r_regionkey), '</ul>') from region""")
def export_index(spark, sf_dir):
    return export.index(graph.nodes(_geo(spark, sf_dir), corpus.link_schema()))


# the graph


@_add("select printf('CUST-%06d', c_custkey) as id, printf('%s/cust-%06d%s.md', case when c_custkey % 3 = 0 then 'b' else 'a' end, c_custkey, case when c_custkey % 3 = 0 then '-old' else '' end) as path, c_name as title from customer")
def graph_last_of_equal_ids(spark, sf_dir):
    """Of documents with the same id, the last path stands."""
    raw = corpus._sql(spark, sf_dir, "select format_string('a/cust-%06d.md', c_custkey) path, concat('---\\ntype: customer\\ntitle: \"', c_name, '\"\\n---\\n') raw from {customer} union all select format_string('b/cust-%06d-old.md', c_custkey), concat('---\\ntype: customer\\ntitle: \"', c_name, '\"\\n---\\n') from {customer} where c_custkey % 3 = 0")
    return graph.nodes(parse_frontmatter(raw), corpus.link_schema()).select("id", "path", "title")


@_add("""with r as (select n_regionkey as k, printf('NAT-%03d', min(n_nationkey)) as low, count(*) as n, row_number() over (order by -count(*), printf('NAT-%03d', min(n_nationkey))) as pos from nation group by 1)
select 'G010' as code, 'error' as severity, concat('cycle: ', string_agg(printf('NAT-%03d', n_nationkey), ' -> ' order by n_nationkey), ' -> ', printf('NAT-%03d', min(n_nationkey))) as message from nation group by n_regionkey having count(*) > 1
union all select 'G021', 'warning', concat((select count(*) from r), ' parts: ', string_agg(concat(low, '+', n - 1), '; ' order by pos) filter (where pos <= case when (select count(*) from r) <= 3 then 3 else 2 end), case when (select count(*) from r) > 3 then concat('; and ', (select count(*) from r) - 2, ' more') else '' end) from r having count(*) > 1
union all select 'G011', 'warning', concat('refers to itself: ', i, ' -> ', i, ' (', 'next', ')') from (select printf('NAT-%03d', n_nationkey) as i from nation where n_nationkey % 4 = 0)
union all select 'G030', 'error', concat('no such document: ', printf('NAT-%03d', n_nationkey), ' -> GONE-', n_nationkey, ' (next)') from nation where n_nationkey % 6 = 0""")
def graph_health_rings(spark, sf_dir):
    """The nations of a region are a ring; some refer to themselves, some to no document."""
    e = spark.sql(
        f"""with n as (select *, format_string('NAT-%03d', n_nationkey) id from parquet.`{sf_dir}/nation.parquet`)
        select id `from`, coalesce(lead(id) over w, first(id) over w) `to`, 'next' relation, cast(0 as bigint) ord from n window w as (partition by n_regionkey order by n_nationkey)
        union all select id, id, 'next', 1 from n where n_nationkey % 4 = 0 union all select id, concat('GONE-', n_nationkey), 'next', 2 from n where n_nationkey % 6 = 0"""
    )
    n = _table(spark, sf_dir, "nation").selectExpr("format_string('NAT-%03d', n_nationkey) as id", "'nation' as type", "n_name as title", "cast(null as string) as status")
    return graph.health(written(e, "rings"), n, Schema.parse('relation "next" acyclic=#true')).select("code", "severity", "message")


@_add("select concat('s', a.s_suppkey) as team, b.s_name as handle from supplier a join supplier b on a.s_suppkey <= b.s_suppkey")
def team_chain(spark, sf_dir):
    """Each team has the next as its sub-team, to a depth as long as the table."""
    s = _table(spark, sf_dir, "supplier")
    return expand_teams(s.selectExpr("concat('s', s_suppkey) as team", "s_name as handle"), s.filter("s_suppkey > 0").selectExpr("concat('s', s_suppkey - 1) as team", "concat('s', s_suppkey) as sub_team"))


@_add("select 'order' as type, count(*) as n from orders union all select 'customer', count(*) from customer where c_acctbal >= 0 union all select 'nation', count(*) from nation union all select 'region', count(*) from region")
def stats_by_type(spark, sf_dir):
    return stats.by_type_status(corpus.linked_heads(spark, sf_dir)).filter("status is null").select("type", "n")


# changes


@_add("select 'nation/nat-002.md' as path, 'superseded' as status, 'NAT-003' as superseded_by from nation where n_nationkey = 2")
def deprecate(spark, sf_dir):
    return query.listing(parse_frontmatter(mutate.deprecate(_geo(spark, sf_dir), "nation/nat-002.md", "nat_003")), fields=["status", "superseded_by"])


@_add(f"select {_NAT} as path, concat(left({_NRAW}, position('# About' in {_NRAW}) - 1), '# About', chr(10), chr(10), 'New.', chr(10), chr(10), '# Coast', chr(10), chr(10), 'It lies near the sea.', chr(10)) as raw from nation")
def replace_section(spark, sf_dir):
    new = mutate.replace_section(_geo(spark, sf_dir).filter("type = 'nation'"), ["About"], "New.")
    heads = _geo_files(spark, sf_dir).select("path", F.regexp_extract("raw", r"(?s)^---\n.*?\n---\n", 0).alias("head"))
    return parse_frontmatter(new).join(heads, "path").select("path", F.concat("head", "body").alias("raw"))


@_add(f"select {_P} as path, 'x, y|2|' as cells {_T}")
def add_row(spark, sf_dir):
    new = mutate.add_row(corpus.stored_parts(spark, sf_dir), ["Pricing"], mutate.parse_cells("x\\, y, 2"))
    return query.row(query.tables(parse_documents(new), ["Pricing"]), 2).select("path", F.array_join("cells", "|").alias("cells"))


@_add(f"select {_P} as path, p_name as title, cast(null as varchar) as brand from part where p_partkey % 13 <> 0")
def remove_field(spark, sf_dir):
    return query.listing(parse_frontmatter(mutate.remove_field(corpus.part_heads(spark, sf_dir), "brand")), fields=["title", "brand"])


@_add("""select printf('region/reg-%03d.md', r_regionkey) as path, concat('{"flag":true,"list":[1,"a"],"ratio":1.5,"text":"1-2","title":"', r_name, '","type":"region","whole":-7}') as j from region""")
def literals(spark, sf_dir):
    """Literals of the command line as values."""
    new = mutate.set_fields(_geo(spark, sf_dir).filter("type = 'region'"), {"flag": "true", "list": "[1, a]", "ratio": "1.5", "text": "1-2", "whole": "-7"})
    docs = parse_frontmatter(new)
    return docs.select("path", frontmatter_json(docs).alias("j"))


@_add("select printf('nat-%03d.md', max(n_nationkey) + 1) as path, concat('---', chr(10), 'title: New', chr(10), 'type: nat', chr(10), '---', chr(10), chr(10), '# About', chr(10)) as raw from nation")
def new_document(spark, sf_dir):
    """A document from its type's template, with the next free number."""
    schema = Schema.parse('type "nat" { field "title" type="string" required=#true; section "About" }')
    return mutate.new_document(spark, graph.nodes(_geo(spark, sf_dir)), schema, "nat", {"title": "New"})


@_add(f"select {_NAT} as path, cast(n_nationkey = 2 as boolean) as moved from nation where n_nationkey <> 2 union all select 'nation/nat-900.md', true from nation where n_nationkey = 2")
def rename_files(spark, sf_dir):
    """A tree of files after a document was renamed in it."""
    root = new_path(spark, "tree")
    files.write_files(_geo_files(spark, sf_dir), root)
    mutate.rename_apply(_geo(spark, sf_dir), corpus.link_schema(), root, "nation/nat-002.md", "NAT-900")
    return files.scan(spark, root).filter("path like 'nation/%'").select("path", (F.col("path") == "nation/nat-900.md").alias("moved"))
