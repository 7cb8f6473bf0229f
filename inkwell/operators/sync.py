"""Inverse relations that are missing, as a plan and as new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Schema


def missing_inverses(e: DataFrame, n: DataFrame, schema: Schema) -> DataFrame:
    """(id, field, ref): edges of relations with an inverse whose target exists and has none back."""
    inverse = e.sparkSession.createDataFrame([(r.name, r.inverse) for r in schema.relations if r.inverse] + [(r.inverse, r.name) for r in schema.relations if r.inverse], "relation string, field string")
    at = e.join(F.broadcast(inverse), "relation").select(F.col("to").alias("id"), "field", F.col("from").alias("ref")).distinct()
    held = e.select(F.col("from").alias("id"), F.col("relation").alias("field"), F.col("to").alias("ref"))
    return at.join(n.select("id"), "id", "left_semi").join(held, ["id", "field", "ref"], "left_anti")


def plan(e: DataFrame, n: DataFrame, schema: Schema) -> tuple[DataFrame, DataFrame]:
    """(actions (id, field, refs), warnings (id, field, held, ref)).

    A field for one reference takes the first that is wanted where it is empty;
    all that it cannot take are warnings.
    """
    ones = [x for r in schema.relations if r.cardinality == "one" for x in (r.name, r.inverse) if x]
    want = missing_inverses(e, n, schema)
    held = e.filter(F.col("relation").isin(ones or [""])).groupBy(F.col("from").alias("id"), F.col("relation").alias("field")).agg(F.min("to").alias("held"))
    at = want.join(held, ["id", "field"], "left")
    single = F.col("field").isin(ones or [""])
    grouped = at.groupBy("id", "field").agg(F.sort_array(F.collect_set("ref")).alias("refs"), F.first("held").alias("held"))
    take = F.when(~single, F.col("refs")).when(F.col("held").isNull(), F.slice("refs", 1, 1)).otherwise(F.array().cast("array<string>"))
    planned = grouped.withColumn("take", take)
    actions = planned.filter(F.size("take") > 0).select("id", "field", F.col("take").alias("refs"))
    warnings = planned.select("id", "field", F.coalesce("held", F.try_element_at("take", F.lit(1))).alias("held"), F.explode(F.array_except("refs", "take")).alias("ref"))
    return actions, warnings


def apply(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """(path, raw) of the documents that change."""
    from .mutate import rewrite

    per = actions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("field", "refs"))).alias("adds"))
    changed = docs.join(per, "id").select("path", "raw", F.to_json("adds").alias("edit"))

    def edit(fields, adds):
        for a in adds:
            old = fields.get(a["field"])
            held = [old] if isinstance(old, str) else list(old) if isinstance(old, list) else []
            known = {str(x).upper() for x in held}
            new = held + [r for r in a["refs"] if r.upper() not in known]
            fields[a["field"]] = new[0] if len(new) == 1 and not isinstance(old, list) else new
        return fields

    return rewrite(changed, edit)
