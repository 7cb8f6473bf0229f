"""The link graph: nodes, edges, neighbours to any depth, health, exports.

Iterations keep a written frontier; nothing is collected but the last round's
emptiness. Ids are upper case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_string_id, normal_id, path_to_id
from ..plans.schema import Schema
from ..sources.storage import written

def nodes(docs: DataFrame, schema: Schema | None = None) -> DataFrame:
    """(id, path, type, title, status) of documents with frontmatter and of singletons; of
    equal ids the last path stands."""
    row = F.struct("path", "type", "title", "status")
    return _nodes(docs, schema).groupBy("id").agg(F.max_by(row, F.struct(F.split("path", "/"))).alias("n")).select("id", "n.*")


def _nodes(docs: DataFrame, schema: Schema | None = None) -> DataFrame:
    """As ``nodes``, with all documents of equal ids."""
    singles = {t.match: t.name for t in schema.types if t.singleton} if schema else {}
    kind, keep = F.col("type"), F.col("fm_state") == "ok"
    for match, name in singles.items():
        kind = F.when(F.col("type").isNull() & (F.col("file_name") == match), F.lit(name)).otherwise(kind)
        keep = keep | (F.col("file_name") == match) & (F.col("fm_state") != "error")
    return docs.filter(keep).select("id", "path", kind.alias("type"), "title", "status")


def relation_edges(docs: DataFrame, schema: Schema) -> DataFrame:
    """(from, to, relation, ord) of relation fields, in the schema's order; repeats stay.
    docs may have the references as the column refs (``parse_graph`` of these names)."""
    names = schema.relation_names()
    if "refs" in docs.columns:
        at = docs.select(F.col("id").alias("from"), F.posexplode("refs").alias("ord", "e"))
        return at.select("from", F.upper("e.to").alias("to"), "e.relation", F.col("ord").cast("long").alias("ord"))
    if not names:
        return docs.sparkSession.createDataFrame([], "from string, to string, relation string, ord long")
    value = lambda k: F.try_element_at("fields", k)
    refs = lambda v: F.when(v["kind"] == "string", F.array(v["display"])).when(v["kind"] == "array", F.transform(F.filter(v["items"], lambda x: x["kind"] == "string"), lambda x: x["value"]))
    per = F.flatten(F.transform(F.array(*map(F.lit, names)), lambda k: F.coalesce(F.transform(refs(value(k)), lambda r: F.struct(k.alias("relation"), F.upper(r).alias("to"))), F.array().cast("array<struct<relation:string,to:string>>"))))
    out = docs.filter("fm_state = 'ok'").select(F.col("id").alias("from"), F.posexplode(per).alias("ord", "e"))
    return out.select("from", "e.to", "e.relation", F.col("ord").cast("long").alias("ord"))


def inline_edges(docs: DataFrame) -> DataFrame:
    """(from, to, relation, ord) of links in bodies: Markdown files, and ids."""
    at = docs.filter("fm_state <> 'error'").select("id", F.posexplode("links").alias("p", "url"))
    to = F.when(F.endswith("url", F.lit(".md")), path_to_id(F.col("url"))).when(is_string_id(F.col("url")), F.upper(F.replace("url", F.lit("_"), F.lit("-"))))
    return at.select(F.col("id").alias("from"), to.alias("to"), F.lit("inline_ref").alias("relation"), (F.col("p") + 1_000_000).cast("long").alias("ord")).filter("to is not null")


def edges(docs: DataFrame, schema: Schema, inline: bool = True) -> DataFrame:
    """Edges of relations, and of links between pairs that have no edge yet, one for each pair."""
    related = relation_edges(docs, schema)
    if not inline:
        return related
    # a document with frontmatter is a node; only links of the others have to be looked up
    bare = F.col("fm_state") == "absent"
    linked = inline_edges(docs.filter(~bare)).unionByName(inline_edges(docs.filter(bare)).join(_nodes(docs, schema).select(F.col("id").alias("from")), "from", "left_semi"))
    new = linked.join(related.select("from", "to"), ["from", "to"], "left_anti")
    first = new.groupBy("from", "to", "relation").agg(F.min("ord").alias("ord"))
    return related.unionByName(first)


def refs_from(e: DataFrame, id_: str) -> DataFrame:
    return e.filter(F.col("from") == normal_id(id_))


def refs_to(e: DataFrame, id_: str) -> DataFrame:
    return e.filter(F.col("to") == normal_id(id_))


def with_peers(e: DataFrame, n: DataFrame, side: str) -> DataFrame:
    """Edges with type, title and status of the node at ``side`` (from or to), where it exists."""
    peer = n.select(F.col("id").alias(side), F.col("type").alias("peer_type"), F.col("title").alias("peer_title"), F.col("status").alias("peer_status"))
    return e.join(peer, side, "left")


def walk(e: DataFrame, seeds: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(seed, depth, from, to, relation): breadth first from each seed (column id); an edge
    comes once, at its least depth. Depth 1 keeps repeated edges, as a direct look does."""
    near, far = ("to", "from") if backward else ("from", "to")
    start = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"))
    if depth > 1:
        start = written(start, "walk-seeds")
    else:
        return start.join(e.withColumn("at", F.col(near)), "at").select("seed", F.lit(1).alias("depth"), "from", "to", "relation")
    distinct = written(e.select("from", "to", "relation").distinct(), "walk-edges")
    frontier, seen, out = start, start, None
    for d in range(1, depth + 1):
        found = frontier.join(distinct.withColumn("at", F.col(near)), "at").select("seed", F.lit(d).alias("depth"), "from", "to", "relation")
        if d < depth:
            found = written(found, "walk-step")
        out = found if out is None else out.unionByName(found)
        if d == depth:
            break
        step = found.select("seed", F.col(far).alias("at")).distinct().join(seen, ["seed", "at"], "left_anti")
        frontier = written(step, "walk-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def degrees(e: DataFrame) -> DataFrame:
    """(id, n_in, n_out), also of targets that are no nodes."""
    ends = e.select(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def self_references(e: DataFrame) -> DataFrame:
    return e.filter(F.col("from") == F.col("to"))


def dangling(e: DataFrame, n: DataFrame) -> DataFrame:
    return e.join(n.select(F.col("id").alias("to")), "to", "left_anti")


def orphans(e: DataFrame, n: DataFrame) -> DataFrame:
    touched = e.select(F.col("from").alias("id")).unionByName(e.select(F.col("to").alias("id")))
    return n.join(touched, "id", "left_anti")


def components(e: DataFrame, n: DataFrame) -> DataFrame:
    """(id, component): the least id that a node is joined with, over edges between nodes.

    Least labels go to neighbours and along labels themselves, so that the
    rounds are logarithmic for chains.
    """
    ids = n.select("id").distinct()
    pairs = e.select(F.col("from").alias("a"), F.col("to").alias("b")).filter("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    label = written(ids.select("id", F.col("id").alias("l")), "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "l"), "b").select(F.col("a").alias("id"), F.col("l").alias("m"))
        low = label.select("id", F.col("l").alias("m")).unionByName(near).groupBy("id").agg(F.min("m").alias("m"))
        hook = low.join(label, "id").groupBy(F.col("l").alias("id")).agg(F.min("m").alias("m"))
        new = low.unionByName(hook).groupBy("id").agg(F.min("m").alias("m"))
        jump = new.join(new.select(F.col("id").alias("m"), F.col("m").alias("mm")), "m").select("id", F.least("m", "mm").alias("k"))
        after = written(jump.join(label, "id").select("id", F.col("k").alias("l"), (F.col("k") < F.col("l")).alias("moved")), "labels")
        label = after.select("id", "l")
        if after.filter("moved").isEmpty():
            return label.select("id", F.col("l").alias("component"))


def acyclic_edges(e: DataFrame, schema: Schema, normalised: bool = False) -> DataFrame:
    """(a, b): edges of acyclic relations. Names and inverses are one adjacency, unless
    ``normalised`` turns inverse edges round first."""
    out = e.limit(0).select(F.col("from").alias("a"), F.col("to").alias("b"))
    for r in schema.relations:
        if r.acyclic:
            out = out.unionByName(e.filter(F.col("relation") == r.name).select(F.col("from").alias("a"), F.col("to").alias("b")))
            if r.inverse:
                inv = e.filter(F.col("relation") == r.inverse)
                out = out.unionByName(inv.select(F.col("to").alias("a"), F.col("from").alias("b")) if normalised else inv.select(F.col("from").alias("a"), F.col("to").alias("b")))
    return out.filter("a <> b").distinct()


def cyclic_core(pairs: DataFrame) -> DataFrame:
    """(a, b): edges that are left when ends without a way on, or in, are peeled off again and
    again; none exactly where there is no cycle."""
    left = written(pairs.distinct(), "core")
    size = left.count()
    while size:
        ins, outs = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
        left = written(left.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"), "core")
        now = left.count()
        if now == size:
            break
        size = now
    return left


def on_cycles(pairs: DataFrame) -> DataFrame:
    """(id) of the nodes that lie on a cycle: those of the core that reach themselves.

    The closure doubles path lengths, so rounds are logarithmic; it is of the core only.
    """
    core = cyclic_core(pairs)
    reach = written(core, "reach")
    size = reach.count()
    while size:
        step = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reach = written(reach.unionByName(step).distinct(), "reach")
        now = reach.count()
        if now == size:
            break
        size = now
    return reach.filter("a = b").select(F.col("a").alias("id"))


def cycle_messages(pairs: DataFrame) -> DataFrame:
    """(cycle): one line for each edge back that a depth-first walk from the sorted ids meets.
    The walk itself is sequential, and done component by component of the core."""
    core = cyclic_core(pairs)
    ids = core.select(F.col("a").alias("id")).unionByName(core.select(F.col("b").alias("id"))).distinct()
    by = components(core.select(F.col("a").alias("from"), F.col("b").alias("to")), ids)
    rows = core.join(by.withColumnRenamed("id", "a"), "a")

    def dfs(pdf):
        import pandas as pd

        adjacent: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["a"], pdf["b"], strict=True)):
            adjacent.setdefault(a, []).append(b)
        done, found = set(), []
        for root in sorted(adjacent):
            if root in done:
                continue
            trail, stack = [root], [iter(adjacent[root])]
            on = {root}
            while stack:
                nxt = next(stack[-1], None)
                if nxt is None:
                    stack.pop()
                    gone = trail.pop()
                    on.discard(gone)
                    done.add(gone)
                elif nxt in on:
                    found.append(" -> ".join([*trail[trail.index(nxt) :], nxt]))
                elif nxt not in done:
                    trail.append(nxt)
                    on.add(nxt)
                    stack.append(iter(adjacent.get(nxt, [])))
        return pd.DataFrame({"cycle": found}, dtype=object)

    return rows.groupBy("component").applyInPandas(dfs, "cycle string")


def health(e: DataFrame, n: DataFrame, schema: Schema, normalised: bool = False) -> DataFrame:
    """(ord, code, severity, message): G011, G010, G020, G021, G030, in this order."""
    row = lambda d, o, code, sev, msg: d.select(F.lit(o).alias("ord"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), msg.alias("message"))
    arrow = F.concat(F.col("from"), F.lit(" -> "), F.col("to"), F.lit(" ("), F.col("relation"), F.lit(")"))
    out = row(self_references(e), 0, "G011", "warning", F.concat(F.lit("refers to itself: "), arrow))
    if any(r.acyclic for r in schema.relations):
        out = out.unionByName(row(cycle_messages(acyclic_edges(e, schema, normalised)), 1, "G010", "error", F.concat(F.lit("cycle: "), F.col("cycle"))))
    out = out.unionByName(row(orphans(e, n), 2, "G020", "info", F.concat(F.lit("no edges: "), F.col("id"))))
    per = components(e, n).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "component"))), 1, 3)
    cut = per.agg(F.count(F.lit(1)).alias("k"), first.alias("f")).filter("k > 1")
    text = F.concat(F.col("k").cast("string"), F.lit(" parts: "), F.array_join(F.transform(F.when(F.col("k") <= 3, F.col("f")).otherwise(F.slice("f", 1, 2)), lambda x: F.concat(x["component"], F.lit("+"), (-x["s"] - 1).cast("string"))), "; "), F.when(F.col("k") > 3, F.concat(F.lit("; and "), (F.col("k") - 2).cast("string"), F.lit(" more"))).otherwise(""))
    out = out.unionByName(row(cut, 3, "G021", "warning", text))
    return out.unionByName(row(dangling(e, n), 4, "G030", "error", F.concat(F.lit("no such document: "), arrow))).orderBy("ord", "message")


def next_id(n: DataFrame, prefix: str) -> DataFrame:
    """One row (next_id): PREFIX-number of three digits at least, one beyond the greatest."""
    p = prefix.upper()
    number = F.try_to_number(F.regexp_extract("id", f"^{p}-([0-9]{{1,10}})$", 1), F.lit("9999999999")).cast("long")
    at = n.filter(F.col("id").rlike(f"^{p}-[0-9]{{1,10}}$")).select(number.alias("k")).filter("k <= 4294967295")
    return at.agg((F.coalesce(F.max("k"), F.lit(0)) + 1).alias("k")).select(F.format_string(f"{p}-%03d", "k").alias("next_id"))


def _of_type(e: DataFrame, n: DataFrame, type_name: str | None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a type, and edges that begin there."""
    if type_name is None:
        return e, n
    some = n.filter(F.col("type") == type_name)
    return e.join(some.select(F.col("id").alias("from")), "from", "left_semi"), some


def mermaid(e: DataFrame, n: DataFrame, type_name: str | None = None) -> DataFrame:
    """Lines (part, key, line) of a Mermaid diagram, to be read in their order."""
    e, n = _of_type(e, n, type_name)
    name = F.replace("id", F.lit("-"), F.lit("_"))
    label = F.concat(F.col("id"), F.when(F.col("title").isNotNull(), F.concat(F.lit(": "), F.replace("title", F.lit('"'), F.lit("'")))).otherwise(""))
    old = F.coalesce(F.col("status").isin("deprecated", "superseded"), F.lit(False))
    first = n.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), name, F.when(old, '(["').otherwise('["'), label, F.when(old, '"])').otherwise('"]')).alias("line"))
    dash = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    second = e.select(F.lit(2).alias("part"), F.concat_ws("|", "from", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("key"), F.concat(F.lit("  "), dash(F.col("from")), F.lit(" -->|"), F.col("relation"), F.lit("| "), dash(F.col("to"))).alias("line"))
    head = n.sparkSession.createDataFrame([(0, "", "graph LR")], "part int, key string, line string")
    return head.unionByName(first).unionByName(second).orderBy("part", "key")


def dot(e: DataFrame, n: DataFrame, type_name: str | None = None) -> DataFrame:
    """Lines (part, key, line) of a DOT digraph."""
    e, n = _of_type(e, n, type_name)
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    old = F.coalesce(F.col("status").isin("deprecated", "superseded"), F.lit(False))
    first = n.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), q(F.col("id")), F.lit(" [label="), q(F.concat_ws(": ", "id", "title")), F.when(old, ", style=dashed").otherwise(""), F.lit("];")).alias("line"))
    second = e.select(F.lit(2).alias("part"), F.concat_ws("|", "from", F.lpad(F.col("ord").cast("string"), 9, "0")).alias("key"), F.concat(F.lit("  "), q(F.col("from")), F.lit(" -> "), q(F.col("to")), F.lit(" [label="), q(F.col("relation")), F.lit("];")).alias("line"))
    ends = n.sparkSession.createDataFrame([(0, "", "digraph documents {"), (3, "", "}")], "part int, key string, line string")
    return ends.unionByName(first).unionByName(second).orderBy("part", "key")


def ranked(d: DataFrame, by: str) -> DataFrame:
    """The row of greatest degree; of ties the greatest id."""
    return d.filter(F.col(by) > 0).agg(F.max_by(F.struct("id", by), F.struct(by, "id")).alias("m")).filter("m is not null").select("m.*")

