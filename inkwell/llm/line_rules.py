"""Quality rules: cross-document line frequency by host.

Lines are compared without case, outer blanks and repeated blanks, by a 64-bit
hash. A line of a host is boilerplate where more than
``max(min_docs, share * documents of the host)``, or than ``max_docs``, distinct
documents hold it: the share lets small hosts have common phrases, and what a
thousand documents hold is boilerplate however large the host.
Those lines go; a document is rejected where less than ``least_left`` of its
characters on non-blank lines is left.

The set of such lines is small beside the corpus; its joins broadcast only below
a checked size. All of it is built-in expressions: hashes are shuffled, texts only where
very many documents hold boilerplate.

Defined cases: null or empty text has no lines and is rejected; blank lines are
neither counted nor removed; a null host is the host ''; rows that share a
doc_id are one document (the least text and host stand); rows without doc_id, or
with one that is no whole number, are left out; ties at the limit stay. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text, sized, store

#: Production parameters.
MIN_DOCS, SHARE, MAX_DOCS, LEAST_LEFT = 4, 0.01, 1000, 0.5


def _norm(line):
    return F.lower(F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h): the lines above their host's limit. docs: (doc_id, host, hs)."""
    total = docs.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    held = docs.select("host", F.explode(F.array_distinct("hs")).alias("h")).filter("h is not null")
    counts = held.groupBy("host", "h").count().filter(F.col("count") > min_docs)
    return counts.join(sized(total, 100_000), "host").filter(F.col("count") > F.least(F.col("host_docs") * F.lit(share), F.lit(float(max_docs)))).select("host", "h")


def clean_lines(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, least_left: float = LEAST_LEFT, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of the documents that stay, without boilerplate lines."""
    one = ids_and_text(docs.withColumnRenamed(host_col, "_ik_host"), extra=("_ik_host",))
    base = one.select("doc_id", "text", F.coalesce("_ik_host", F.lit("")).alias("host"))
    norm = F.transform(F.split("text", "\n", -1), _norm)
    hashes = F.transform(norm, lambda x: F.when(x != "", F.xxhash64(x)))
    keys = store(base.select("doc_id", "host", hashes.alias("hs")), "line-hashes")
    often = store(frequent_lines(keys, min_docs, share, max_docs), "frequent-lines")
    hits = keys.select("doc_id", "host", F.posexplode("hs").alias("p", "h")).filter("h is not null").join(sized(often), ["host", "h"])
    hits = store(hits.groupBy("doc_id").agg(F.collect_list("p").alias("ps")), "line-hits")
    lines = F.split("text", "\n", -1)
    joined = base.select("doc_id", "text").join(sized(hits, weight=F.size("ps")), "doc_id", "left")
    pairs = joined.select("doc_id", "ps", lines.alias("ls"))
    kept = F.when(F.col("ps").isNull(), F.col("ls")).otherwise(F.filter("ls", lambda x, i: ~F.array_contains(F.col("ps"), i)))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.when(F.trim(F.regexp_replace(x, "[ \t\r]+", " ")) != "", F.length(x)).otherwise(0))
    out = pairs.select("doc_id", kept.alias("ks"), F.size("ls").alias("n_lines"), "ls").select("doc_id", "ks", "n_lines", size(F.col("ls")).alias("before"), size(F.col("ks")).alias("after"))
    out = out.filter((F.col("after") > 0) & (F.col("after") >= F.col("before") * F.lit(least_left)))
    return out.select("doc_id", F.array_join("ks", "\n").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("ks")).cast("long").alias("n_removed"))


ORACLE = f"""
with l as (
  select doc_id, coalesce(source, '') as host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p
  from documents where text is not null and doc_id is not null),
n as (select *, lower(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'))) as k from l),
hosts as (select coalesce(source, '') as host, count(*) as docs from documents where doc_id is not null group by 1),
often as (
  select n.host, n.k from n where k <> '' group by n.host, n.k
  having count(distinct doc_id) > {MIN_DOCS}),
cut as (
  select o.host, o.k from often o join hosts h using (host)
  join (select host, k, count(distinct doc_id) as c from n group by 1, 2) c using (host, k)
  where c.c > least(h.docs * {SHARE}, {MAX_DOCS})),
m as (
  select n.doc_id, n.p, n.line, cut.k is not null as gone, case when n.k <> '' then length(n.line) else 0 end as size
  from n left join cut on n.host = cut.host and n.k = cut.k)
select doc_id, string_agg(line, chr(10) order by p) filter (where not gone) as text,
  count(*) as n_lines, count(*) filter (where gone) as n_removed
from m group by doc_id
having coalesce(sum(size) filter (where not gone), 0) > 0
  and sum(size) filter (where not gone) >= sum(size) * {LEAST_LEFT}
"""
