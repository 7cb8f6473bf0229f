"""Validation against a schema: diagnostics of every code, as one table.

Fields of all documents are checked in one pass over (document x declared
field); references and users that the pass meets come out as rows of their own,
and are resolved by joins. Sections are found level by level of the declared
tree, without a shuffle. The schema's tables are broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dialect, path_to_id, strip
from ..plans.schema import Schema
from ..plans.users import Users
from ..sources.storage import written

DIAGNOSTICS = ["path", "stage", "o1", "o2", "severity", "code", "message", "location", "hint"]
#: What the checks read of parsed documents, and of their sections.
COLUMNS = ["fm_state", "parse_error", "sections"]
SECTION = ["ord", "parent", "heading", "n_paragraphs", "n_lists", "n_items", "code_infos", "tables"]
DIAGRAMS = ["mermaid", "d2", "plantuml", "graphviz", "dot"]

_DIAG = "struct<stage:int,o1:int,o2:int,severity:string,code:string,message:string,location:string,hint:string,ref:string,user:string>"


def _diag(stage, o1, o2, severity, code, message, location, hint=None, ref=None, user=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    whole = lambda x: (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("int")
    return F.struct(whole(stage).alias("stage"), whole(o1).alias("o1"), whole(o2).alias("o2"), text(severity).alias("severity"), text(code).alias("code"), text(message).alias("message"), text(location).alias("location"), text(hint).alias("hint"), text(ref).alias("ref"), text(user).alias("user"))


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _typed(docs: DataFrame, schema: Schema) -> DataFrame:
    singles = [t.match for t in schema.types if t.singleton]
    return docs.filter(~F.col("file_name").isin(singles)) if singles else docs


def document_state(docs: DataFrame, schema: Schema, single: bool = False) -> DataFrame:
    """E000, F002; with ``single`` also F000 and F001, which directories pass over."""
    known = [t.name for t in schema.types]
    rest = _typed(docs, schema)
    has_type = F.map_contains_key("fields", F.lit("type"))
    cases = F.when(F.col("fm_state") == "error", _diag(0, 0, 0, "error", "E000", _cat("cannot be parsed: ", F.coalesce("parse_error", F.lit(""))), "file"))
    if single:
        cases = cases.when(F.col("fm_state") == "absent", _diag(0, 0, 0, "error", "F000", "the document has no frontmatter", "frontmatter", "begin the file with a block between two lines of ---"))
        cases = cases.when(~has_type, _diag(0, 0, 0, "error", "F001", "frontmatter has no type", "frontmatter", "name one of the schema's types"))
    cases = cases.when(has_type & ~F.col("type").isin(known), _diag(0, 0, 0, "error", "F002", _cat('type "', F.col("type"), '" is not in the schema'), "frontmatter.type", "types: " + ", ".join(known)))
    return rest.select("path", cases.alias("d")).filter("d is not null").select("path", "d.*")


def _patterns(schema: Schema) -> tuple[dict[str, str], list[tuple[str, str, str, int]]]:
    """(pattern -> Java's dialect, [(type, field, pattern, ord)] of those that do not compile)."""
    good, bad = {}, []
    for t in schema.types:
        for i, f in enumerate(t.fields):
            if f.pattern is not None and f.type in ("string", "string[]"):
                try:
                    re.compile(f.pattern)
                    if len(f.pattern) > 4096:
                        raise ValueError("too long")
                    good[f.pattern] = dialect(f.pattern)
                except (re.error, ValueError):
                    bad.append((t.name, f.name, f.pattern, i))
    return good, bad


def _matches(value: Column, pattern: Column, patterns: dict[str, str]) -> Column:
    """Whether the value meets its row's pattern: one compiled expression for each pattern."""
    out = F.lit(True)
    for p, java in patterns.items():
        out = F.when(pattern == F.lit(p), value.rlike(java)).otherwise(out)
    return out


def field_checks(docs: DataFrame, schema: Schema) -> DataFrame:
    """F010, F020, F021, F030, S000 and F040, and rows (ref, user) of what is to be resolved."""
    spark = docs.sparkSession
    tables = schema.frames(spark)
    good, bad = _patterns(schema)
    base = _typed(docs, schema).filter("fm_state = 'ok'").select("path", "type", "fields")
    at = base.join(F.broadcast(tables["fields"]), "type").withColumn("v", F.try_element_at("fields", F.col("name")))
    kind, shown = F.col("v.kind"), F.col("v.display")
    one = F.regexp_replace("field_type", r"\[\]", "")
    many = F.endswith("field_type", F.lit("[]"))
    location = _cat("frontmatter.", F.col("name"))
    expected = F.when(F.col("field_type").isin("number", "bool"), F.col("field_type")).when(many, F.lit("array")).otherwise(F.lit("string"))
    missing = F.when(F.col("v").isNull() & F.col("required"), _diag(1, "ord", 0, "error", "F010", _cat('required field "', F.col("name"), '" is missing'), "frontmatter", _cat(F.col("name"), ": <", F.col("field_type"), ">", F.when(F.col("description").isNotNull(), _cat(" — ", F.col("description"))).otherwise(""))))
    wrong = F.when(kind != expected, _diag(1, "ord", 0, "error", "F020", _cat('field "', F.col("name"), '" is a ', kind, ", not a ", F.col("field_type")), location))
    fits = kind == expected
    enum = F.when(fits & (F.col("field_type") == "enum") & ~F.array_contains("enum_values", shown), _diag(1, "ord", 0, "error", "F021", _cat('field "', F.col("name"), '" cannot be "', shown, '"'), location, _cat("one of: ", F.array_join("enum_values", ", "))))
    pattern = F.when(fits & (F.col("field_type") == "string") & ~_matches(shown, F.col("pattern"), good), _diag(1, "ord", 0, "error", "F030", _cat('field "', F.col("name"), '" does not match ', F.col("pattern")), location))
    ref = F.when(fits & (F.col("field_type") == "ref"), _diag(1, "ord", 0, None, None, F.col("name"), location, ref=shown))
    user = F.when(fits & (F.col("field_type") == "user"), _diag(1, "ord", 0, None, None, F.col("name"), location, user=shown))

    def element(x, i):
        name = _cat(F.col("name"), "[", i.cast("string"), "]")
        there = _cat("frontmatter.", name)
        bad_kind = x["kind"] != "string"
        return (
            F.when(bad_kind, _diag(1, "ord", i + 1, "error", "F020", _cat('field "', name, '" is a ', x["kind"], ", not a ", one), there))
            .when((F.col("field_type") == "string[]") & ~_matches(x["value"], F.col("pattern"), good), _diag(1, "ord", i + 1001, "error", "F030", _cat('field "', name, '" does not match ', F.col("pattern")), there))
            .when(F.col("field_type") == "ref[]", _diag(1, "ord", i + 1, None, None, name, there, ref=x["value"]))
            .when(F.col("field_type") == "user[]", _diag(1, "ord", i + 1, None, None, name, there, user=x["value"]))
        )

    elements = F.when(fits & many, F.transform("v.items", element)).otherwise(F.array().cast(f"array<{_DIAG}>"))
    found = F.array_compact(F.concat(F.array(missing, wrong, enum, pattern, ref, user), elements))
    out = [at.select("path", F.inline(found))]
    for t, name, p, i in bad:
        some = base.filter(F.col("type") == t).withColumn("v", F.try_element_at("fields", F.lit(name))).filter("v.kind = 'string'")
        out.append(some.select("path", F.inline(F.array(_diag(1, i, 0, "warning", "S000", f"pattern {p} of field {name} is no expression", "schema")))))
    rules = base.join(F.broadcast(tables["rules"]), "type").withColumn("v", F.try_element_at("fields", F.col("when_field"))).filter("v.kind = 'string' and v.display = when_equals")
    gone = rules.select("path", "name", "when_field", "when_equals", "fields", "ord", F.posexplode("then_required").alias("i", "need")).filter(F.try_element_at("fields", F.col("need")).isNull())
    out.append(gone.select("path", F.inline(F.array(_diag(2, "ord", "i", "error", "F040", _cat('field "', F.col("need"), '" must be there when ', F.col("when_field"), " is ", F.col("when_equals")), _cat("frontmatter.", F.col("need")), _cat("rule ", F.col("name")))))))
    return reduce(DataFrame.unionByName, out)


def relation_checks(docs: DataFrame, schema: Schema) -> DataFrame:
    """F020 of relations, and rows (ref) of what is to be resolved; relations hold for every type."""
    spark = docs.sparkSession
    names = schema.relation_names()
    known = [t.name for t in schema.types if not t.singleton]
    base = _typed(docs, schema).filter("fm_state = 'ok'").filter(F.col("type").isin(known))
    keys = F.array_sort(F.filter(F.map_keys("fields"), lambda k: k.isin(names) if names else F.lit(False)))
    at = base.select("path", "fields", F.posexplode(keys).alias("o", "field")).join(F.broadcast(schema.frames(spark)["relations"].select("field", "cardinality").dropDuplicates(["field"])), "field").withColumn("v", F.element_at("fields", F.col("field")))
    kind, location = F.col("v.kind"), _cat("frontmatter.", F.col("field"))
    scalar = F.when(kind == "string", _diag(3, "o", 0, None, None, F.col("field"), location, ref=F.col("v.display")))
    scalar = scalar.when((F.col("cardinality") == "one") | (kind != "array"), _diag(3, "o", 0, "error", "F020", _cat('relation "', F.col("field"), '" is a ', kind, ", not a ", F.when(F.col("cardinality") == "one", "ref").otherwise("ref[]")), location))

    def element(x, i):
        name = _cat(F.col("field"), "[", i.cast("string"), "]")
        return F.when(x["kind"] == "string", _diag(3, "o", i + 1, None, None, name, _cat("frontmatter.", name), ref=x["value"])).otherwise(_diag(3, "o", i + 1, "error", "F020", _cat('relation "', name, '" is a ', x["kind"], ", not a ref"), _cat("frontmatter.", name)))

    elements = F.when((F.col("cardinality") == "many") & (kind == "array"), F.transform("v.items", element)).otherwise(F.array().cast(f"array<{_DIAG}>"))
    return at.select("path", F.inline(F.array_compact(F.concat(F.array(scalar), elements))))


def resolve_refs(refs: DataFrame, files: DataFrame, schema: Schema) -> DataFrame:
    """R001, R010, R011 of (path, stage, o1, o2, message = name, location, ref); files: (path) of all."""
    formats = []
    for _, p in schema.ref_formats:
        try:
            re.compile(p)
            formats.append(dialect(p))
        except (re.error, ValueError):
            continue
    rows = written(refs.filter("ref is not null"), "refs")
    fits = reduce(lambda a, b: a | b, [F.col("ref").rlike(p) for p in formats], F.lit(not schema.ref_formats))
    flag = lambda d, sev, code, text, hint: d.select("path", "stage", "o1", "o2", F.lit(sev).alias("severity"), F.lit(code).alias("code"), _cat('reference "', F.col("ref"), '" in "', F.col("message"), '" ', text).alias("message"), "location", hint.alias("hint"))
    odd = flag(rows.filter(~fits), "warning", "R001", "has no known format", F.lit("formats: " + ", ".join(p for _, p in schema.ref_formats)))
    rest = rows.filter(fits)
    is_path = F.endswith("ref", F.lit(".md"))
    parent = F.regexp_replace("path", r"[^/]*$", "")
    target = normal_path(F.when(F.startswith("ref", F.lit("/")), F.col("ref")).otherwise(F.concat(parent, F.col("ref"))))
    there = files.select(normal_path(F.col("path")).alias("_p")).distinct()
    broken = flag(rest.filter(is_path & F.col("path").isNotNull()).withColumn("_t", target).join(there, F.col("_t") == F.col("_p"), "left_anti"), "error", "R010", "has no file", _cat("looked for ", F.col("_t")))
    ids = files.select(path_to_id(F.col("path")).alias("_id")).distinct()
    lost = flag(rest.filter(~is_path).join(ids, F.col("ref") == F.col("_id"), "left_anti"), "warning", "R011", "is no document's id", F.lit("no document of that id is in reach"))
    return odd.unionByName(broken).unionByName(lost)


def normal_path(p: Column) -> Column:
    """Without empty and ``.`` parts, with ``..`` taken back."""
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.array_join(done, "/")


def resolve_users(rows: DataFrame, users: Users | None) -> DataFrame:
    """U010, U011 of (path, stage, o1, o2, message = name, location, user)."""
    some = written(rows.filter("user is not null"), "users")
    flag = lambda d, code, text, hint: d.select("path", "stage", "o1", "o2", F.lit("error").alias("severity"), F.lit(code).alias("code"), _cat('user "', F.col("user"), '" in "', F.col("message"), '" ', text).alias("message"), "location", F.lit(hint).cast("string").alias("hint"))
    out = flag(some.filter(~F.startswith("user", F.lit("@"))), "U010", "does not begin with @", "write @name or @team/name")
    if users is None:
        return out
    known = users.frames(rows.sparkSession)["refs"]
    hint = "known: " + ", ".join(users.refs()) if users.refs() else None
    lost = some.filter(F.startswith("user", F.lit("@"))).join(F.broadcast(known.withColumnRenamed("ref", "_known")), F.col("user") == F.col("_known"), "left_anti")
    return out.unionByName(flag(lost, "U011", "is not known", hint))


def section_checks(docs: DataFrame, schema: Schema) -> DataFrame:
    """S010, S020, S021, S022, S030, S031, S032, and rows (user) of table cells, level by level."""
    tables = schema.frames(docs.sparkSession)
    defs = tables["sections"].withColumnRenamed("path", "names")
    cols = tables["columns"].groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name", "col_type", "required"))).alias("columns"))
    defs = defs.join(cols, "section_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<struct<ord:int,name:string,col_type:string,required:boolean>>")))
    singles = {t.match: t.name for t in schema.types if t.singleton}
    own = F.col("type")
    for match, name in singles.items():
        own = F.when(F.col("file_name") == match, F.lit(name)).otherwise(own)
    usable = (F.col("fm_state") == "ok") | F.col("file_name").isin(list(singles) or [""]) & (F.col("fm_state") != "error")
    base = docs.filter(usable).select("path", own.alias("type"), "sections")
    deepest = max((len(p) for p in _paths(schema)), default=0)
    out, parents = [], None
    for depth in range(deepest):
        level = F.broadcast(defs.filter(F.col("depth") == depth))
        if depth == 0:
            at = base.join(level, "type")
            pick = F.filter("sections", lambda s: F.lower(strip(s["heading"])) == F.lower(strip(F.col("name"))))
        else:
            at = parents.join(level.drop("type"), F.col("parent_id") == F.col("me"))
            pick = F.filter("sections", lambda s: (s["parent"] == F.col("parent_ord")) & (F.lower(s["heading"]) == F.lower("name")))
        at = at.withColumn("s", F.try_element_at(pick, F.lit(1)))
        out.append(at.select("path", F.inline(_one_section())))
        parents = at.filter("s is not null").select("path", "sections", F.col("section_id").alias("me"), F.col("s.ord").alias("parent_ord"))
    if not out:
        return docs.sparkSession.createDataFrame([], f"path string, {_DIAG[7:-1]}")
    return reduce(DataFrame.unionByName, out)


def _paths(schema: Schema) -> list[tuple]:
    out = []

    def walk(defs, at):
        for s in defs:
            out.append((*at, s.name))
            walk(s.children, (*at, s.name))

    for t in schema.types:
        walk(t.sections, ())
    return out


def _one_section() -> Column:
    """Diagnostics of a declared section (columns of the definition) and what was found (s)."""
    s, name = F.col("s"), F.col("name")
    here = _cat('section "', name, '"')
    d = lambda o2, code, message, location, hint=None: _diag(4, "section_id", o2, "error", code, message, location, hint)
    absent = F.when(s.isNull() & F.col("required"), d(0, "S010", _cat('required section "', F.array_join("names", " > "), '" is missing'), "document body", _cat("add the heading ", name, F.when(F.col("description").isNotNull(), _cat(" — ", F.col("description"))).otherwise(""))))
    n_tables = F.size("s.tables")
    no_table = F.when(s.isNotNull() & F.col("has_table") & F.col("table_required") & (n_tables == 0), d(1, "S020", _cat(here, " has no table"), here))
    prose = F.when(F.col("s.n_paragraphs") < F.col("min_paragraphs"), d(5000, "S030", _cat(here, " has ", F.col("s.n_paragraphs").cast("string"), " paragraphs of at least ", F.col("min_paragraphs").cast("string")), here))
    no_list = F.col("has_list") & F.col("list_required") & (F.col("s.n_lists") == 0)
    lists = F.when(no_list, d(5001, "S031", _cat(here, " has no list"), here)).when(F.col("s.n_items") < F.col("list_min_items"), d(5001, "S031", _cat(here, " has ", F.col("s.n_items").cast("string"), " list items of at least ", F.col("list_min_items").cast("string")), here))
    drawn = F.exists("s.code_infos", lambda c: F.when(F.col("diagram_type").isNotNull(), c == F.lower("diagram_type")).otherwise(c.isin(DIAGRAMS)))
    diagram = F.when(F.col("diagram_required") & s.isNotNull() & ~drawn, d(5002, "S032", _cat(here, " has no diagram"), here, _cat("add a code block of ", F.coalesce("diagram_type", F.lit(", ".join(DIAGRAMS))))))
    table = F.try_element_at("s.tables", F.lit(1))
    inside = _cat(here, " > table")

    def column(c):
        return F.when(c["required"] & ~F.array_contains(table["headers"], c["name"]), d(c["ord"] * 100 + 2, "S021", _cat("the table of ", here, ' lacks the column "', c["name"], '"'), inside))

    def cell(c):
        at = F.nullif(F.array_position(table["headers"], c["name"]).cast("int"), F.lit(0))

        def row(r, i):
            value = strip(F.coalesce(F.try_element_at(r, at), F.lit("")))
            place = _cat(inside, " > ", c["name"], "[", i.cast("string"), "]")
            empty = F.when(c["required"], d(c["ord"] * 100 + 3 + i, "S022", _cat("row ", i.cast("string"), ' of column "', c["name"], '" is empty'), place))
            filled = _diag(4, "section_id", c["ord"] * 100 + 3 + i, None, None, _cat("table:", name, ".", c["name"], ".row", i.cast("string")), _cat("frontmatter.table:", name, ".", c["name"], ".row", i.cast("string")), user=value)
            return F.when(value == "", empty).otherwise(filled)

        return F.when((c["col_type"] == "user") & at.isNotNull(), F.transform(table["rows"], row)).otherwise(F.array().cast(f"array<{_DIAG}>"))

    none = F.array().cast(f"array<{_DIAG}>")
    columns = F.when(table.isNotNull() & F.col("has_table"), F.concat(F.transform("columns", column), F.flatten(F.transform("columns", cell)))).otherwise(none)
    return F.array_compact(F.concat(F.array(absent, no_table, prose, lists, diagram), columns))


def type_counts(docs: DataFrame, schema: Schema) -> DataFrame:
    """T010: more documents of a type than max_count; at the first one too many, by path."""
    limits = [(t.name, t.max_count) for t in schema.types if t.max_count is not None]
    if not limits:
        return _none(docs)
    small = docs.sparkSession.createDataFrame(limits, "type string, max_count int")
    at = docs.filter("fm_state = 'ok'").select("type", "path").join(F.broadcast(small), "type")
    most = max(n for _, n in limits) + 1
    # the constant bound lets every task pass on no more rows of a type than that
    nth = at.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("path"))).filter(F.col("_n") <= most).filter("_n = max_count + 1")
    over = nth.join(at.groupBy("type").count(), "type")
    return over.select("path", F.inline(F.array(_diag(5, 0, 0, "error", "T010", _cat('type "', F.col("type"), '" has ', F.col("count").cast("string"), " documents of at most ", F.col("max_count").cast("string")), "type", "the first one too many, by path"))))


def singleton_presence(docs: DataFrame, schema: Schema) -> DataFrame:
    """T020: a singleton with a required section whose file is not there."""
    want = [(t.match, t.name) for t in schema.types if t.singleton and any(s.required for s in t.sections)]
    if not want:
        return _none(docs)
    w = docs.sparkSession.createDataFrame(want, "match string, type string")
    gone = F.broadcast(w).join(docs.select("file_name").filter(F.col("file_name").isin([m for m, _ in want])).distinct(), F.col("match") == F.col("file_name"), "left_anti")
    return gone.select(F.col("match").alias("path"), F.inline(F.array(_diag(5, 1, 0, "error", "T020", _cat('file of the singleton "', F.col("type"), '" is missing'), "file", _cat("create ", F.col("match"))))))


def _none(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"path string, {_DIAG[7:-1]}")


def validate(docs: DataFrame, schema: Schema, users: Users | None = None, files: DataFrame | None = None, single: bool = False) -> DataFrame:
    """All diagnostics. docs: parsed documents, best read from a written table, as several
    passes read them. files: (path) of all documents in reach, docs if not given."""
    checks = field_checks(docs, schema).unionByName(relation_checks(docs, schema)).unionByName(section_checks(docs, schema))
    checks = checks.unionByName(document_state(docs, schema, single)).unionByName(type_counts(docs, schema))
    if not single:
        checks = checks.unionByName(singleton_presence(docs, schema))
    checks = written(checks, "checks")
    plain = checks.filter("code is not null").select(*DIAGNOSTICS)
    pending = checks.filter("code is null")
    return plain.unionByName(resolve_refs(pending, docs if files is None else files, schema).select(*DIAGNOSTICS)).unionByName(resolve_users(pending, users).select(*DIAGNOSTICS))


def ordered(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy(F.split("path", "/"), "stage", "o1", "o2")


def compact(diagnostics: DataFrame) -> DataFrame:
    """One line each: path:code:severity:location:message."""
    return diagnostics.select("path", "stage", "o1", "o2", F.concat_ws(":", "path", "code", "severity", "location", "message").alias("line"))


def summary(docs: DataFrame, diagnostics: DataFrame, schema: Schema) -> DataFrame:
    """One row: files that are managed, ok, with errors; errors; warnings."""
    singles = [t.match for t in schema.types if t.singleton] or [""]
    managed = docs.filter((F.col("fm_state") == "error") | F.map_contains_key("fields", F.lit("type")) | F.col("file_name").isin(singles)).select("path").unionByName(diagnostics.filter("code = 'T020'").select("path")).distinct()
    per = diagnostics.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return managed.join(per, "path", "left").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("e", F.lit(0)) == 0).alias("ok"), F.count_if(F.col("e") > 0).alias("with_errors"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))
