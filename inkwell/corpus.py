"""The star tables as document sets: rows rendered to Markdown with frontmatter, in SQL expressions.

Some rows are rendered with faults, by arithmetic on their keys, so that each
check of the validator has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.parse import parse_documents, parse_frontmatter, parse_graph
from .operators import validate
from .plans.schema import Schema
from .plans.users import Users
from .sources.storage import written

PART_SCHEMA = r"""
type "part" folder="part" max_count=1000 {
    field "title" type="string" required=#true
    field "brand" type="string" required=#true description="maker"
    field "size" type="number" required=#true
    field "status" type="enum" default="active" { values "active" "retired" "planned" }
    field "code" type="string" pattern="^P-\\d{4}$"
    field "owner" type="user"
    section "Overview" required=#true { content min-paragraphs=1 }
    section "Pricing" required=#true {
        table required=#true {
            column "Brand" required=#true
            column "Price" type="number" required=#true
            column "Keeper" type="user" required=#true
        }
        section "Detail" required=#true
    }
    section "Notes" { list min-items=2 }
    section "Flow" { diagram type="mermaid" }
    rule "retirement" { when "status" equals="retired"; then-required "retired_on" }
}
type "leaflet" singleton=#true { match "LEAFLET.md"; section "About" required=#true }
relation "replaces" inverse="replaced_by" cardinality="one"
ref-format { part-id pattern="^PART-\\d+$" }
"""

USERS = "users:\n  u0: {name: Zero, teams: [a]}\n  u1: {teams: [b]}\n  u2: {teams: [b]}\nteams:\n  a: {}\n  b: {teams: [a]}\n"

LINK_SCHEMA = """
type "order" folder="orders" { field "title" type="string" required=#true }
type "customer" folder="customer" { field "title" type="string" required=#true }
type "nation" { field "title" type="string" }
type "region" { field "title" type="string" }
relation "placed_by" inverse="orders_of" cardinality="many"
relation "in_nation" inverse="has_customers" cardinality="many"
relation "in_region" inverse="nations" cardinality="many"
"""

_PART = """
select format_string('part/part-%06d.md', p_partkey) path, p_partkey as k,
  concat('---\\ntype: part\\ntitle: "', p_name, '"\\n',
    if(p_partkey % 13 = 0, '', concat('brand: "', p_brand, '"\\n')),
    'kind: ', p_type, '\\nsize: ', if(p_partkey % 17 = 0, concat('"', p_size, '"'), cast(p_size as string)),
    '\\nstatus: ', if(p_partkey % 19 = 0, 'activ', if(p_size % 5 = 0, 'retired', 'active')),
    if(p_size % 5 = 0 and p_partkey % 2 = 0, '\\nretired_on: "2024-01-01"', ''),
    '\\ncode: ', if(p_partkey % 23 = 0, 'X-', 'P-'), format_string('%04d', p_partkey % 10000),
    '\\nowner: "', if(p_partkey % 31 = 0, '', '@'), 'u', p_partkey % 4, '"',
    '\\nreplaces: ', if(p_partkey % 47 = 0, 'none', format_string('PART-%06d', p_partkey + 50)),
    if(p_size > 25, '\\nbulky: true', ''), '\\nspec: {{size: ', p_size, ', grade: "', p_type, '"}}\\n---\\n',
    '# Overview\\n\\n', if(p_partkey % 41 = 0, '', concat('The *', p_name, '* comes from [its maker](maker-', p_size, '.md).\\n\\n')),
    if(p_partkey % 7 = 0, '', concat('# Pricing\\n\\n', if(p_partkey % 11 = 0, 'No prices yet.\\n', concat(
      '| Brand | ', if(p_partkey % 29 = 0, 'Cost', 'Price'), ' | Keeper |\\n| --- | --- | --- |\\n| ', p_brand, ' | ', cast(p_retailprice as decimal(12,2)), ' | ', if(p_partkey % 37 = 0, '', '@u1'), ' |\\n| second | ', p_size, ' | @u2 |\\n')),
      if(p_partkey % 3 = 0, '', concat('\\n## Detail\\n\\nSize ', p_size, '.\\n')), '\\n')),
    '# Notes\\n\\n', repeat('- item\\n', p_partkey % 4),
    '\\n# Flow\\n\\n```', if(p_partkey % 43 = 0, 'text', 'mermaid'), '\\n# not a heading\\n```\\n') raw
from {part}
"""

#: The second version of part documents: larger, some renamed, without some fields.
_PART_2 = """
select path, regexp_replace(regexp_replace(regexp_replace(
  if(k % 7 = 0, regexp_replace(raw, '(?m)^size: .*$', 'size: 99'), raw),
  if(k % 5 = 0, '(?m)^kind: .*\\n', '(?!)'), ''),
  if(k % 6 = 0, '(?m)^# Notes$', '(?!)'), '# Remarks\\n\\nOne more line.'),
  if(k % 9 = 0, '(?m)^---\\n(?=# Overview)', '(?!)'), 'added: yes\\n---\\n') raw
from ({part_docs})
"""

_LINKS = """
select format_string('orders/ord-%07d.md', o_orderkey) path, concat('---\\ntype: order\\ntitle: "Order ', o_orderkey, '"\\nstatus: ', o_orderstatus, '\\npriority: "', o_orderpriority, '"\\nplaced_by: ', format_string('CUST-%06d', o_custkey), '\\n---\\n') raw from {orders}
union all select format_string('customer/cust-%06d.md', c_custkey), concat('---\\ntype: customer\\ntitle: "', c_name, '"\\nin_nation: [', format_string('NAT-%03d', c_nationkey), ']\\n---\\n# About\\n\\nSegment ', c_mktsegment, '; see [the region](../region/reg-', format_string('%03d', c_nationkey % 5), '.md) and [nation](nat_', format_string('%03d', c_nationkey), ').\\n') from {customer} where c_acctbal >= 0
union all select format_string('nation/nat-%03d.md', n_nationkey), concat('---\\ntype: nation\\ntitle: "', n_name, '"\\nin_region: ', format_string('REG-%03d', n_regionkey), '\\n---\\n') from {nation}
union all select format_string('region/reg-%03d.md', r_regionkey), concat('---\\ntype: region\\ntitle: "', r_name, '"\\nnations: [', ns, ']\\n---\\n') from {region} join
  (select n_regionkey, array_join(sort_array(collect_list(format_string('NAT-%03d', n_nationkey))), ', ') ns from {nation} where n_nationkey % 2 = 0 group by n_regionkey) on r_regionkey = n_regionkey
"""


def _sql(spark: SparkSession, sf_dir: str, text: str, **more: str) -> DataFrame:
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("part", "orders", "customer", "nation", "region")}
    return spark.sql(text.format(**(names | more)))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _PART).select("path", "raw")


def part_files_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _PART.format(part=f"parquet.`{sf_dir}/part.parquet`")
    return spark.sql(_PART_2.replace("{part_docs}", inner)).select("path", "raw")


def part_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter only."""
    return parse_frontmatter(part_files(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(part_files(spark, sf_dir))


def stored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed once, for queries of several passes."""
    return written(parts(spark, sf_dir), "parts")


def checked_parts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """As ``stored_parts``, with what the checks read alone, and ``more`` columns."""
    return written(parse_documents(part_files(spark, sf_dir), [*validate.COLUMNS, *more], validate.SECTION), "parts")


def linked(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Orders, customers that owe nothing, nations, regions, parsed and written: fields and
    links, and of texts (raw, body, sections) what is asked for."""
    return written(parse_documents(_sql(spark, sf_dir, _LINKS), ["fm_state", "parse_error", "links", *more]), "linked")


def linked_graph(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """The same documents with what the graph reads of them, not stored."""
    return parse_graph(_sql(spark, sf_dir, _LINKS), link_schema().relation_names(), only or ["fm_state", "refs", "links"])


def linked_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their frontmatter only, not stored: for queries of one pass."""
    return parse_frontmatter(_sql(spark, sf_dir, _LINKS))


def part_schema() -> Schema:
    return Schema.parse(PART_SCHEMA)


def users() -> Users:
    return Users.parse(USERS)


def link_schema() -> Schema:
    return Schema.parse(LINK_SCHEMA)
