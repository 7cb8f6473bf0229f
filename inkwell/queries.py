"""Queries of the document operators over the star tables, each with its SQL over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import corpus
from .functions.parse import dealt, frontmatter_json, parse_documents, parse_frontmatter
from .functions.scalar import closest, highlight, json_field
from .operators import diff, export, filters, graph, migrate, mutate, query, search, stats, sync, validate
from .plans.schema import Schema
from .plans.users import expand_teams
from .sources.files import glob_expression
from .sources.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_P = "printf('part/part-%06d.md', p_partkey)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# search over the plain text table

_LINES = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from documents),
m as (select * from l where not (i = n and t = '')),
c as (select *, lag(trim(t, E' \\t\\r\\n')) over w as b, lead(trim(t, E' \\t\\r\\n')) over w as a from m window w as (partition by doc_id order by i))
"""


@_add(_LINES + "select doc_id, cast(i as bigint) as line, concat_ws(' ', nullif(b, ''), nullif(trim(t, E' \\t\\r\\n'), ''), nullif(a, '')) as context from c where contains(lower(t), 'the')")
def search_lines(spark, sf_dir):
    """Flagship: lines of all documents that hold a text, with their neighbours."""
    return search.lines(_table(spark, sf_dir, "documents"), "doc_id", "text", "the").withColumn("line", F.col("line").cast("long"))


@_add(_LINES + "select coalesce(lang, '') as lang, count(*) as n_lines, count(distinct m.doc_id) as n_docs from m join documents d using (doc_id) where contains(t, 'and') group by 1")
def search_count_by_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    per = search.lines(docs, "doc_id", "text", "and", case_sensitive=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.join(docs.select("doc_id", "lang"), "doc_id").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum("k").alias("n_lines"), F.count(F.lit(1)).alias("n_docs"))


@_add("select o_orderkey, regexp_replace(o_orderpriority, '(me)', '*\\1*', 'gi') as marked from orders where contains(lower(o_orderpriority), 'me')")
def search_highlight(spark, sf_dir):
    return _table(spark, sf_dir, "orders").filter(F.contains(F.lower("o_orderpriority"), F.lit("me"))).select("o_orderkey", highlight(F.col("o_orderpriority"), "me").alias("marked"))


@_add(f"select {_P} as path, 'Overview' as section from part where p_partkey % 41 <> 0 union all select {_P}, 'Flow' from part")
def search_sections(spark, sf_dir):
    """The section of each match: the last heading before it; # in code is none."""
    docs = corpus.parts(spark, sf_dir)
    a = search.search(docs, "comes from", section="overview")
    b = search.search(docs, "# not a heading", case_sensitive=True)
    return a.select("path", "section").unionByName(b.select("path", "section"))


@_add(f"select {_P} as path, 'brand' as field, concat('brand: ', p_brand) as context, cast(4 as bigint) as line from part where p_partkey % 13 <> 0 and contains(p_brand, '#1')")
def search_frontmatter(spark, sf_dir):
    out = search.search(corpus.parts(spark, sf_dir), "#1", field="BRAND")
    return out.select("path", F.lit("brand").alias("field"), "context", F.col("line").cast("long").alias("line"))


# scans, filters, sorts, projections


@_add(f"select {_P} as path from part where regexp_matches({_P}, '^part/part-0*[0-9]*7\\.md$')")
def scan_glob(spark, sf_dir):
    return corpus.part_heads(spark, sf_dir).filter(F.col("file_name").rlike(glob_expression("part-*7.md"))).select("path")


def _filtered(*predicates):
    return lambda spark, sf_dir: filters.where(corpus.part_heads(spark, sf_dir), *predicates).select("path", "title")


for _name, _texts, _where in (
    ("filter_eq", ["brand=Brand#7"], "p_partkey % 13 <> 0 and p_brand = 'Brand#7'"),
    ("filter_ne", ["brand!=Brand#7"], "p_partkey % 13 = 0 or p_brand <> 'Brand#7'"),
    ("filter_contains", ["title~=red"], "contains(p_name, 'red')"),
    ("filter_in", ["kind=ECONOMY, PROMO"], "p_type in ('ECONOMY', 'PROMO')"),
    ("filter_nested", ["spec.size=11"], "p_size = 11"),
    ("filter_and", ["kind=PROMO", "title~=a", "size!=5"], "p_type = 'PROMO' and contains(p_name, 'a') and p_size <> 5"),
):
    QUERIES[_name] = lambda spark, sf_dir, texts=_texts: _filtered(*map(filters.parse, texts))(spark, sf_dir)
    ORACLES[_name] = f"select {_P} as path, p_name as title from part where {_where}"


@_add(f"select {_P} as path from part where p_size > 25")
def filter_has(spark, sf_dir):
    return filters.where(corpus.part_heads(spark, sf_dir), filters.has("bulky")).select("path")


@_add(f"select {_P} as path from part where p_size <= 25")
def filter_not_has(spark, sf_dir):
    return filters.where(corpus.part_heads(spark, sf_dir), ~filters.has("bulky")).select("path")


@_add("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def filter_json_path(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", json_field(F.col("props"), "k").cast("long").alias("k"))


@_add(f"select {_P} as path, cast(p_size as varchar) as size, row_number() over (order by cast(p_size as varchar) desc, {_P}) as pos from part")
def sort_field_desc(spark, sf_dir):
    """The display decides, falling; ties rise by path."""
    return query.positions(corpus.part_heads(spark, sf_dir), "-size").select("path", F.col("key").alias("size"), "pos")


@_add(f"select {_P} as path, p_name as title, case when p_partkey % 13 <> 0 then p_brand end as brand, case when p_size > 25 then 'true' end as bulky from part")
def list_project(spark, sf_dir):
    return query.listing(corpus.part_heads(spark, sf_dir), fields=["title", "brand", "bulky"])


@_add(f"""select concat('{{"path":"', {_P}, '","title":"', p_name, '"', case when p_size > 25 then ',"bulky":true' else '' end, '}}') as json from part""")
def list_json(spark, sf_dir):
    return query.list_json(corpus.part_heads(spark, sf_dir), ["title", "bulky"]).select("json")


@_add("select '' as path, '' as j where false")
def frontmatter_of_null_documents(spark, sf_dir):
    """Documents without frontmatter have none to show."""
    bare = corpus.part_files(spark, sf_dir).select("path", F.regexp_replace("raw", r"(?s)^---.*?\n---\n", "").alias("raw"))
    docs = parse_frontmatter(bare).filter("fm_state = 'ok'")
    return docs.select("path", frontmatter_json(docs).alias("j"))


@_add("select printf('nation/nat-%03d.md', n_nationkey) as path, concat('{\"in_region\":\"', printf('REG-%03d', n_regionkey), '\",\"title\":\"', n_name, '\",\"type\":\"nation\"}') as j from nation")
def frontmatter_all(spark, sf_dir):
    docs = corpus.linked(spark, sf_dir).filter("type = 'nation'")
    return docs.select("path", frontmatter_json(docs).alias("j"))


# sections, tables, links


@_add(f"select {_P} as path, case when p_partkey % 41 = 0 then '' else concat('The ', p_name, ' comes from its maker.') end as text, cast(1 as bigint) as level from part")
def section_get(spark, sf_dir):
    return query.section(corpus.parts(spark, sf_dir), [" OVERVIEW"]).select("path", "section.text", F.col("section.level").cast("long").alias("level"))


@_add(f"select {_P} as path, concat('Size ', p_size, '.') as text from part where p_partkey % 7 <> 0 and p_partkey % 3 <> 0")
def section_path(spark, sf_dir):
    return query.section(corpus.parts(spark, sf_dir), ["Pricing", "detail"]).select("path", "section.text")


@_add(f"select {_P} as path, h.h as heading, cast(h.l as bigint) as level from part, (values ('Overview', 1, 1), ('Pricing', 1, 2), ('Detail', 2, 3), ('Notes', 1, 4), ('Flow', 1, 5)) h(h, l, o) where not (h.h in ('Pricing', 'Detail') and p_partkey % 7 = 0) and not (h.h = 'Detail' and p_partkey % 3 = 0)")
def headings(spark, sf_dir):
    return query.headings(corpus.parts(spark, sf_dir)).select("path", F.col("text").alias("heading"), F.col("level").cast("long").alias("level"))


@_add(f"select {_P} as path, count(*) as n from part, (values ('a', 1), ('b', 0), ('c', 0), ('d', 0)) v(a, pr) where not (pr = 1 and p_partkey % 7 = 0) group by 1")
def top_sections(spark, sf_dir):
    return query.top_sections(corpus.parts(spark, sf_dir)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


_T = "from part where p_partkey % 7 <> 0 and p_partkey % 11 <> 0"


@_add(
    f"""select {_P} as path, cast(0 as bigint) as row_idx, 'Brand' as col, p_brand as value {_T}
    union all select {_P}, 0, case when p_partkey % 29 = 0 then 'Cost' else 'Price' end, cast(cast(p_retailprice as decimal(12,2)) as varchar) {_T}
    union all select {_P}, 0, 'Keeper', case when p_partkey % 37 = 0 then '' else '@u1' end {_T}
    union all select {_P}, 1, 'Brand', 'second' {_T} union all select {_P}, 1, case when p_partkey % 29 = 0 then 'Cost' else 'Price' end, cast(p_size as varchar) {_T}
    union all select {_P}, 1, 'Keeper', '@u2' {_T}"""
)
def table_cells(spark, sf_dir):
    out = query.cells(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]))
    return out.select("path", F.col("row_idx").cast("long").alias("row_idx"), F.col("column").alias("col"), "value")


@_add(f"select {_P} as path, concat(cast(cast(p_retailprice as decimal(12,2)) as varchar), '|', p_size) as prices {_T} and p_partkey % 29 <> 0")
def table_column(spark, sf_dir):
    return query.column(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]), "Price").select("path", F.array_join("values", "|").alias("prices"))


@_add(f"select {_P} as path, cast(p_size as varchar) as value {_T} and p_partkey % 29 <> 0")
def table_cell(spark, sf_dir):
    return query.cell(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]), "Price", 1).select("path", "value")


@_add(f"select {_P} as path, concat(p_brand, '/second') as brands {_T}")
def table_objects(spark, sf_dir):
    out = query.table_objects(query.tables(corpus.parts(spark, sf_dir), ["Pricing"]))
    return out.select("path", F.array_join(F.transform("objects", lambda o: o["Brand"]), "/").alias("brands"))


@_add(f"select {_P} as path, concat('maker-', p_size, '.md') as url from part where p_partkey % 41 <> 0")
def links(spark, sf_dir):
    return query.links(corpus.parts(spark, sf_dir)).select("path", "url")


# validation

_K = {
    "F010": ("frontmatter", "p_partkey % 13 = 0"),
    "F020": ("frontmatter.size", "p_partkey % 17 = 0"),
    "F021": ("frontmatter.status", "p_partkey % 19 = 0"),
    "F030": ("frontmatter.code", "p_partkey % 23 = 0"),
    "F040": ("frontmatter.retired_on", "p_size % 5 = 0 and p_partkey % 2 <> 0 and p_partkey % 19 <> 0"),
    "R001": ("frontmatter.replaces", "p_partkey % 47 = 0"),
    "R011": ("frontmatter.replaces", "p_partkey % 47 <> 0 and p_partkey + 50 not in (select p_partkey from part)"),
    "U010": ("frontmatter.owner", "p_partkey % 31 = 0"),
    "U011": ("frontmatter.owner", "p_partkey % 31 <> 0 and p_partkey % 4 = 3"),
    "S010 ": ("document body", "p_partkey % 7 = 0"),
    "S010": ("document body", "p_partkey % 7 <> 0 and p_partkey % 3 = 0"),
    "S020": ('section "Pricing"', "p_partkey % 7 <> 0 and p_partkey % 11 = 0"),
    "S021": ('section "Pricing" > table', "p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_partkey % 29 = 0"),
    "S022": ('section "Pricing" > table > Keeper[0]', "p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_partkey % 37 = 0"),
    "S030": ('section "Overview"', "p_partkey % 41 = 0"),
    "S031": ('section "Notes"', "p_partkey % 4 < 2"),
    "S032": ('section "Flow"', "p_partkey % 43 = 0"),
}
_WARN = ("R001", "R011")
_SQL = {c: f"select {_P} as path, '{c.strip()}' as code, '{'warning' if c in _WARN else 'error'}' as severity, '{loc}' as location from part where {cond}" for c, (loc, cond) in _K.items()}
_SQL["T010"] = f"select {_P} as path, 'T010' as code, 'error' as severity, 'type' as location from (select *, row_number() over (order by p_partkey) as r from part) where r = 1001"
_SQL["T020"] = "select 'LEAFLET.md' as path, 'T020' as code, 'error' as severity, 'file' as location"


def _codes(codes: str) -> str:
    return " union all ".join(s for c, s in _SQL.items() if c.strip() in codes.split())


def _shown(d: DataFrame) -> DataFrame:
    return d.select("path", "code", "severity", "location")


@_add(_codes("F010 F020 F021 F030 F040"))
def val_fields(spark, sf_dir):
    return _shown(validate.field_checks(written(corpus.part_heads(spark, sf_dir), "heads"), corpus.part_schema()).filter("code is not null"))


@_add(_codes("R001 R011"))
def val_refs(spark, sf_dir):
    docs = written(corpus.part_heads(spark, sf_dir), "heads")
    return _shown(validate.resolve_refs(validate.relation_checks(docs, corpus.part_schema()), docs, corpus.part_schema()))


@_add(_codes("U010 U011"))
def val_users(spark, sf_dir):
    return _shown(validate.resolve_users(validate.field_checks(corpus.part_heads(spark, sf_dir), corpus.part_schema()), corpus.users()))


@_add(_codes("S010 S020 S021 S022 S030 S031 S032"))
def val_sections(spark, sf_dir):
    return _shown(validate.section_checks(corpus.checked_parts(spark, sf_dir), corpus.part_schema()).filter("code is not null"))


@_add(_codes("T010 T020"))
def val_counts(spark, sf_dir):
    docs, schema = written(corpus.part_heads(spark, sf_dir), "heads"), corpus.part_schema()
    return _shown(validate.type_counts(docs, schema).unionByName(validate.singleton_presence(docs, schema)))


@_add(f"select printf('customer/cust-%06d.md', c_custkey) as path, 'F002' as code from customer where c_acctbal >= 0 union all select printf('orders/ord-%07d.md', o_orderkey), 'F002' from orders union all select printf('nation/nat-%03d.md', n_nationkey), 'F002' from nation union all select printf('region/reg-%03d.md', r_regionkey), 'F002' from region")
def val_unknown_type(spark, sf_dir):
    return validate.document_state(corpus.linked(spark, sf_dir), corpus.part_schema()).select("path", "code")


@_add(f"with d as ({' union all '.join(_SQL.values())}) select path, code, severity, location from d")
def validate_all(spark, sf_dir):
    return _shown(validate.validate(corpus.checked_parts(spark, sf_dir), corpus.part_schema(), corpus.users()))


@_add(f"with d as ({' union all '.join(_SQL.values())}) select code, severity, count(*) as n from d group by all")
def val_summary(spark, sf_dir):
    return stats.by_code(validate.validate(corpus.checked_parts(spark, sf_dir), corpus.part_schema(), corpus.users()))


@_add(f"with d as ({' union all '.join(_SQL.values())}), p as (select path, count(*) filter (where severity = 'error') as e, count(*) filter (where severity = 'warning') as w from d group by 1), f as (select {_P} as path from part union select 'LEAFLET.md') select count(*) as files, count(*) filter (where coalesce(e, 0) = 0) as ok, count(*) filter (where e > 0) as with_errors, cast(sum(e) as bigint) as errors, cast(sum(w) as bigint) as warnings from f left join p using (path)")
def val_files(spark, sf_dir):
    docs = corpus.checked_parts(spark, sf_dir)
    d = written(validate.validate(docs, corpus.part_schema(), corpus.users()), "diagnostics")
    return validate.summary(docs, d, corpus.part_schema())


@_add(f"with d as ({_codes('F010 F021')}) select path, code, case when code = 'F021' then 'active' end as value from d where code = 'F021' union all select {_P}, 'S010', null from part where p_partkey % 7 = 0 or p_partkey % 3 = 0")
def fix_plan(spark, sf_dir):
    docs, schema = corpus.checked_parts(spark, sf_dir), corpus.part_schema()
    return mutate.fix_plan(docs, validate.validate(docs, schema, corpus.users()), schema).select("path", "code", "value")


@_add(f"select path, code, severity, location from ({_codes('F010')}) union all select {_P}, 'F040', 'error', 'frontmatter.retired_on' from part where p_size % 5 = 0 and p_partkey % 2 <> 0 and p_partkey % 19 <> 0 union all select {_P}, 'S020', 'error', 'section \"Pricing\"' from part where p_partkey % 7 = 0 or p_partkey % 11 = 0 union all select {_P}, 'S010', 'error', 'document body' from part where p_partkey % 7 = 0 or p_partkey % 3 = 0")
def fix_apply(spark, sf_dir):
    """What F010, F021, F040, S010 and S020 say of the mended documents: a heading is added at
    the end, so a nested one, or the nested ones of a new one, are still to be placed."""
    docs, schema = corpus.checked_parts(spark, sf_dir, "raw"), corpus.part_schema()
    mended = mutate.fix_apply(docs, mutate.fix_plan(docs, validate.validate(docs, schema, corpus.users()), schema))
    mended = written(parse_documents(mended, validate.COLUMNS, validate.SECTION), "mended")
    after = written(docs.drop("raw").join(mended.select("path"), "path", "left_anti").unionByName(mended), "after")
    return _shown(validate.validate(after, schema, corpus.users()).filter("code in ('F010', 'F021', 'F040', 'S010', 'S020')"))


@_add("select o_orderkey, case o_orderpriority when '1-URGENT' then 'URGENT' when '2-HIGH' then 'HIGH' when '3-MEDIUM' then 'MEDIUM' when '5-LOW' then 'LOW' end as nearest from orders")
def fix_closest_enum(spark, sf_dir):
    word = F.substring("o_orderpriority", 2, 100)
    return _table(spark, sf_dir, "orders").select("o_orderkey", closest(word, ["URGENT", "HIGH", "MEDIUM", "LOW"], F.lit(2)).alias("nearest"))


# the link graph

_E = """
with e as (
  select printf('ORD-%07d', o_orderkey) as f, printf('CUST-%06d', o_custkey) as t, 'placed_by' as r from orders
  union all select printf('CUST-%06d', c_custkey), printf('NAT-%03d', c_nationkey), 'in_nation' from customer where c_acctbal >= 0
  union all select printf('NAT-%03d', n_nationkey), printf('REG-%03d', n_regionkey), 'in_region' from nation
  union all select printf('REG-%03d', n_regionkey), printf('NAT-%03d', n_nationkey), 'nations' from nation where n_nationkey % 2 = 0
  union all select printf('CUST-%06d', c_custkey), printf('REG-%03d', c_nationkey % 5), 'inline_ref' from customer where c_acctbal >= 0),
n as (
  select printf('ORD-%07d', o_orderkey) as id, 'order' as type from orders
  union all select printf('CUST-%06d', c_custkey), 'customer' from customer where c_acctbal >= 0
  union all select printf('NAT-%03d', n_nationkey), 'nation' from nation union all select printf('REG-%03d', r_regionkey), 'region' from region)
"""


def _graph_docs(spark, sf_dir) -> DataFrame:
    return written(corpus.linked_graph(spark, sf_dir), "linked")


def _graph(spark, sf_dir, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes); without ``store`` for one use of few edges, whose filter reaches the scan."""
    docs, schema = _graph_docs(spark, sf_dir), corpus.link_schema()
    e = graph.edges(docs, schema)
    return written(e, "edges") if store else e, graph.nodes(docs, schema)


@_add(_E + "select id, type from n")
def graph_nodes(spark, sf_dir):
    return graph.nodes(corpus.linked_graph(spark, sf_dir, ["fm_state"]), corpus.link_schema()).select("id", "type")


@_add(_E + 'select f as "from", t as "to", r as relation from e')
def graph_edges(spark, sf_dir):
    return graph.edges(_graph_docs(spark, sf_dir), corpus.link_schema()).select("from", "to", "relation")


@_add(_E + 'select f as "from", t as "to", r as relation, type as peer_type from e left join n on t = id where f = \'CUST-000001\'')
def refs_from(spark, sf_dir):
    e, n = _graph(spark, sf_dir, store=False)
    own = written(graph.refs_from(e, "customer/cust-000001.md"), "own")  # of one document
    peers = n.join(F.broadcast(own.select(F.col("to").alias("id")).distinct()), "id", "left_semi")
    return graph.with_peers(own, peers, "to").select("from", "to", "relation", "peer_type")


@_add(_E + 'select f as "from", t as "to", r as relation from e where t = \'NAT-002\'')
def refs_to(spark, sf_dir):
    return graph.refs_to(_graph(spark, sf_dir, store=False)[0], "nat_002").select("from", "to", "relation")


for _depth in (2, 3):
    QUERIES[f"refs_transitive_{_depth}"] = lambda spark, sf_dir, d=_depth: (lambda e, n: graph.walk(e, n.filter("type = 'order'").select("id"), d).select("seed", F.col("depth").cast("long").alias("depth"), "from", "to", "relation"))(*_graph(spark, sf_dir))
    ORACLES[f"refs_transitive_{_depth}"] = (
        _E
        + """, s1 as (select f as seed, 1 as depth, f, t, r from e where starts_with(f, 'ORD')), v1 as (select distinct seed, t as id from s1),
        s2 as (select distinct seed, 2 as depth, f, t, r from v1 join e on e.f = v1.id), v2 as (select distinct seed, t as id from s2 except select * from v1),
        s3 as (select distinct seed, 3 as depth, f, t, r from v2 join e on e.f = v2.id)
        select seed, cast(depth as bigint) as depth, f as "from", t as "to", r as relation from (select * from s1 union all select * from s2"""
        + (" union all select * from s3" if _depth == 3 else "")
        + ")"
    )


@_add(_E + "select coalesce(a.t, b.f) as id, coalesce(a.c, 0) as n_in, coalesce(b.c, 0) as n_out from (select t, count(*) as c from e group by 1) a full join (select f, count(*) as c from e group by 1) b on a.t = b.f")
def graph_degree(spark, sf_dir):
    return graph.degrees(_graph(spark, sf_dir)[0])


@_add(_E + "select t as id, count(*) as n_in from e group by 1 order by n_in desc, id desc limit 1")
def most_referenced(spark, sf_dir):
    return graph.ranked(graph.degrees(_graph(spark, sf_dir)[0]), "n_in")


@_add(_E + 'select f as "from", t as "to" from e anti join n on t = id')
def graph_dangling(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return graph.dangling(e, n).select("from", "to")


@_add(_E + "select id from n where id not in (select f from e where r = 'placed_by' union all select t from e where r = 'placed_by')")
def graph_orphans(spark, sf_dir):
    e, n = _graph(spark, sf_dir, store=False)
    return graph.orphans(e.filter("relation = 'placed_by'"), n).select("id")


def _part_edges(spark, sf_dir, to: str, times: str) -> tuple[DataFrame, DataFrame]:
    p = _table(spark, sf_dir, "part")
    n = p.count()
    e = p.selectExpr("format_string('PART-%06d', p_partkey) as `from`", f"format_string('PART-%06d', {times.format(n=n)}) as `to`", f"'{to}' as relation", "p_partkey as ord")
    return e, p.selectExpr("format_string('PART-%06d', p_partkey) as id", "'part' as type", "p_name as title", "cast(null as string) as status")


@_add("select printf('PART-%06d', p_partkey) as id from part where (7 * p_partkey) % (select count(*) from part) = p_partkey")
def graph_self_refs(spark, sf_dir):
    return graph.self_references(_part_edges(spark, sf_dir, "next", "(7 * p_partkey) % {n}")[0]).select(F.col("from").alias("id"))


@_add("""with recursive c as (select count(*) as n from part), e as (select p_partkey as a, (7 * p_partkey) % n as b from part, c), s as (select a, b from e union select b, a from e),
r(a, b) as (select a, a from e union select r.a, s.b from r join s on r.b = s.a) select printf('PART-%06d', a) as id, printf('PART-%06d', min(b)) as component from r group by a""")
def graph_components(spark, sf_dir):
    return graph.components(*_part_edges(spark, sf_dir, "next", "(7 * p_partkey) % {n}"))


@_add("""with recursive c as (select count(*) as n from part), e as (select p_partkey as a, (p_partkey * p_partkey + 1) % n as b from part, c where p_partkey <> (p_partkey * p_partkey + 1) % n),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select printf('PART-%06d', a) as id from r where a = b""")
def graph_cycles(spark, sf_dir):
    e, _ = _part_edges(spark, sf_dir, "next", "(p_partkey * p_partkey + 1) % {n}")
    return graph.on_cycles(e.select(F.col("from").alias("a"), F.col("to").alias("b")).filter("a <> b"))


@_add()
def graph_health(spark, sf_dir):
    """G-codes of a graph with cycles; the messages' walk is sequential, tests compare it."""
    e, n = _part_edges(spark, sf_dir, "next", "(p_partkey * p_partkey + 1) % {n}")
    return graph.health(e, n, Schema.parse('relation "next" acyclic=#true'))


@_add(_E + "select printf('CUST-%03d', max(c_custkey) + 1) as next_id from customer where c_acctbal >= 0")
def next_id(spark, sf_dir):
    return graph.next_id(graph.nodes(corpus.linked_graph(spark, sf_dir, ["fm_state"]), corpus.link_schema()), "cust")


@_add(_E + "select 1 as one from n limit 0")
def graph_duplicate_ids(spark, sf_dir):
    return corpus.linked_graph(spark, sf_dir, ["fm_state"]).groupBy("id").count().filter("count > 1").select(F.lit(1).alias("one"))


@_add(
    _E
    + """select t as id, case r when 'placed_by' then 'orders_of' when 'in_nation' then 'has_customers' when 'in_region' then 'nations' else 'in_region' end as field, string_agg(f, ',' order by f) as refs
    from (select distinct f, t, r from e where r <> 'inline_ref') x where t in (select id from n)
    and not exists (select 1 from e y where y.f = x.t and y.t = x.f and y.r = case x.r when 'placed_by' then 'orders_of' when 'in_nation' then 'has_customers' when 'in_region' then 'nations' else 'in_region' end) group by 1, 2"""
)
def sync_plan(spark, sf_dir):
    e, n = _graph(spark, sf_dir)
    return sync.plan(e, n, corpus.link_schema())[0].select("id", "field", F.array_join("refs", ",").alias("refs"))


@_add("select 1 as one where false")
def sync_apply(spark, sf_dir):
    """What is still to be done after the plan was applied: nothing."""
    docs, schema = corpus.linked(spark, sf_dir, "raw"), corpus.link_schema()
    e = written(graph.edges(docs, schema), "edges")
    new = sync.apply(docs, sync.plan(e, graph.nodes(docs, schema), schema)[0])
    after = written(parse_documents(docs.select("path", "raw").join(new.select("path"), "path", "left_anti").unionByName(new), ["fm_state", "links"]), "synced")
    return sync.plan(graph.edges(after, schema), graph.nodes(after, schema), schema)[0].select(F.lit(1).alias("one"))


@_add(_E + """select 'graph LR' as line union all select concat('  ', replace(id, '-', '_'), '["', id, ': ', case type when 'nation' then n_name else r_name end, '"]') from n left join nation on id = printf('NAT-%03d', n_nationkey) left join region on id = printf('REG-%03d', r_regionkey) where type in ('nation', 'region')
union all select concat('  ', replace(f, '-', '_'), ' -->|', r, '| ', replace(t, '-', '_')) from e where r in ('in_region', 'nations')""")
def mermaid(spark, sf_dir):
    e, n = _graph(spark, sf_dir, store=False)
    return graph.mermaid(e.filter("relation in ('in_region', 'nations')"), n.filter("type in ('nation', 'region')")).select("line")


@_add(_E + """select 'digraph documents {' as line union all select '}' union all select concat('  "', id, '" [label="', id, ': ', r_name, '"];') from n join region on id = printf('REG-%03d', r_regionkey)
union all select concat('  "', f, '" -> "', t, '" [label="', r, '"];') from e where r = 'nations'""")
def dot(spark, sf_dir):
    e, n = _graph(spark, sf_dir, store=False)
    return graph.dot(e, n, "region").select("line")


# differences, migration, changes


@_add(
    f"""select {_P} as path, 'size' as field, 'changed' as change, cast(p_size as varchar) as old_value, '99' as new_value from part where p_partkey % 7 = 0
    union all select {_P}, 'kind', 'removed', p_type, null from part where p_partkey % 5 = 0
    union all select {_P}, 'added', 'added', null, 'yes' from part where p_partkey % 9 = 0"""
)
def diff_fields(spark, sf_dir):
    return diff.fields(corpus.part_heads(spark, sf_dir), parse_frontmatter(corpus.part_files_2(spark, sf_dir)))


@_add(
    f"""select {_P} as path, 'Notes' as section, 'removed' as change, cast(0 as bigint) as lines_added, cast(p_partkey % 4 + 2 as bigint) as lines_removed from part where p_partkey % 6 = 0
    union all select {_P}, 'Remarks', 'added', p_partkey % 4 + 4, 0 from part where p_partkey % 6 = 0"""
)
def diff_sections(spark, sf_dir):
    out = diff.sections(corpus.parts(spark, sf_dir), parse_documents(corpus.part_files_2(spark, sf_dir)))
    return out.select("path", "section", "change", F.col("lines_added").cast("long").alias("lines_added"), F.col("lines_removed").cast("long").alias("lines_removed"))


def _new_schema() -> Schema:
    text = corpus.PART_SCHEMA.replace('"active" "retired" "planned"', '"active" "planned" "archived"').replace('field "code" type="string"', 'field "grade" type="string" default="A"\n    field "code" type="string" required=#true').replace('section "Flow" { diagram type="mermaid" }', 'section "History"')
    return Schema.parse(text.replace('    field "owner" type="user"\n', ""))


@_add("""select * from (values ('part', 'field_added', 'grade', 'A'), ('part', 'field_changed', 'code', 'string -> string required'), ('part', 'field_removed', 'owner', null), ('part', 'section_added', 'History', null),
('part', 'section_removed', 'Flow', null), ('part', 'value_added', 'status', 'archived'), ('part', 'value_removed', 'status', 'retired')) v(type, kind, name, detail)""")
def schema_diff(spark, sf_dir):
    return migrate.diff(spark, corpus.part_schema(), _new_schema())


@_add(
    f"""select {_P} as path, 'add_field' as kind, 'grade' as name, 'A' as value from part union all select {_P}, 'remove_field', 'owner', null from part
    union all select {_P}, 'removed_enum_value', 'status', 'retired' from part where p_size % 5 = 0 and p_partkey % 19 <> 0 union all select {_P}, 'add_section', 'History', null from part"""
)
def migration_plan(spark, sf_dir):
    return migrate.plan(corpus.parts(spark, sf_dir), corpus.part_schema(), _new_schema()).select("path", "kind", "name", "value")


@_add(f"select {_P} as path, 'removed_enum_value' as kind from part where p_size % 5 = 0 and p_partkey % 19 <> 0")
def migration_apply(spark, sf_dir):
    """What is left to do afterwards."""
    titles = lambda files, *more: parse_documents(files, ["fm_state", "sections", *more], ["heading"])
    docs = written(titles(corpus.part_files(spark, sf_dir), "raw"), "parts")
    new = migrate.apply(docs, migrate.plan(docs, corpus.part_schema(), _new_schema()))
    return migrate.plan(titles(new), corpus.part_schema(), _new_schema()).select("path", "kind")


@_add(f"select {_P} as path, 'planned' as status, '7' as size from part where p_type = 'PROMO'")
def batch_set(spark, sf_dir):
    new = parse_frontmatter(mutate.batch(corpus.part_heads(spark, sf_dir), [filters.equals("kind", "PROMO")], {"status": "planned", "size": "7"}))
    return query.listing(new, fields=["status", "size"])


@_add("select printf('customer/cust-%06d.md', c_custkey) as path, '[NAT-900]' as in_nation from customer where c_nationkey = 2 and c_acctbal >= 0 union all select printf('region/reg-%03d.md', n_regionkey), null from nation where n_nationkey = 2")
def rename_cascade(spark, sf_dir):
    new, _ = mutate.rename(corpus.linked(spark, sf_dir, "raw"), corpus.link_schema(), "nation/nat-002.md", "NAT-900")
    return query.listing(parse_frontmatter(new), fields=["in_nation"])


@_add(f"select {_P} as path, '0.00' as value {_T} and p_partkey % 29 <> 0")
def set_cell(spark, sf_dir):
    new = mutate.set_cell(dealt(corpus.part_files(spark, sf_dir)), ["Pricing"], "Price", 0, "0.00")
    new = parse_documents(new, ["fm_state", "sections"], ["ord", "parent", "level", "heading", "path", "tables"])
    return query.cell(query.tables(new, ["Pricing"]), "Price", 0).filter("value = '0.00'").select("path", "value")


@_add(f"select {_P} as path, concat(case when p_partkey % 41 = 0 then '' else concat('The ', p_name, ' comes from its maker.', chr(10), chr(10)) end, 'Added.') as text from part")
def append_section(spark, sf_dir):
    new = parse_documents(mutate.append_section(dealt(corpus.part_files(spark, sf_dir)), ["Overview"], "Added."))
    return query.section(new, ["Overview"]).select("path", "section.text")


# aggregates and the rest


@_add("with s as (select 'order' as type, o_orderstatus as status from orders) select type, status, count(*) as n from s group by 1, 2 union all select type, null, count(*) from (select 'order' as type from orders union all select 'customer' from customer where c_acctbal >= 0 union all select 'nation' from nation union all select 'region' from region) group by 1")
def stats_by_type_status(spark, sf_dir):
    return stats.by_type_status(corpus.linked_heads(spark, sf_dir))


@_add("select (select o_orderkey from orders order by o_orderdate, o_orderkey limit 1) as oldest_id, cast(min(o_orderdate) as date) as oldest, (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 1) as newest_id, cast(max(o_orderdate) as date) as newest from orders")
def stats_staleness(spark, sf_dir):
    return stats.staleness(_table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


@_add(_E + "select (select count(*) from n) as documents, (select count(*) from e) as edges, (select count(*) from n where id not in (select f from e union all select t from e)) as orphans, (select t from e group by 1 order by count(*) desc, t desc limit 1) as most_referenced, (select f from e group by 1 order by count(*) desc, f desc limit 1) as most_referring")
def stats_summary(spark, sf_dir):
    docs = _graph_docs(spark, sf_dir)
    e, n = written(graph.edges(docs, corpus.link_schema()), "edges"), graph.nodes(docs, corpus.link_schema())
    return stats.summary(docs, e, n).select("documents", "edges", "orphans", "most_referenced", "most_referring")


@_add("""select concat('nation', n_nationkey) as team, c_name as handle from customer join nation on c_nationkey = n_nationkey union all select concat('region', n_regionkey), c_name from customer join nation on c_nationkey = n_nationkey
union all select 'world', c_name from customer""")
def team_expand(spark, sf_dir):
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    members = c.selectExpr("concat('nation', c_nationkey) as team", "c_name as handle")
    teams = n.selectExpr("concat('region', n_regionkey) as team", "concat('nation', n_nationkey) as sub_team").union(n.selectExpr("'world'", "concat('region', n_regionkey)").distinct())
    return expand_teams(members, teams)


@_add()
def inspect(spark, sf_dir):
    docs = corpus.stored_parts(spark, sf_dir)
    return query.inspect(docs, validate.validate(docs, corpus.part_schema(), corpus.users()))


@_add("""select * from (values ('title', 'string', true, 0), ('brand', 'string', true, 1), ('size', 'number', true, 2), ('status', 'enum', false, 3), ('code', 'string', false, 4), ('owner', 'user', false, 5)) v(name, field_type, required, ord)""")
def describe_fields(spark, sf_dir):
    return query.describe(spark, corpus.part_schema(), "fields", "part").select("name", "field_type", "required", "ord")


@_add(f"select count(*) as pages, count(*) filter (where p_partkey % 41 <> 0) as with_link from part")
def export_html(spark, sf_dir):
    out = export.pages(corpus.parts(spark, sf_dir), spark.createDataFrame([], "from string, to string, relation string"))
    return out.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.contains("html", F.lit("its maker</a>"))).alias("with_link"))


@_add(f"select {_P} as path from part")
def documents_json(spark, sf_dir):
    out = query.documents_json(corpus.parts(spark, sf_dir))
    return out.filter(F.try_parse_json("json").isNotNull()).select("path")
