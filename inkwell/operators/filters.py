"""The six predicates on frontmatter, and their notation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(key: str) -> Column:
    """Display of a field by dotted path: the first part is a key, the rest goes through mappings."""
    first, _, rest = key.partition(".")
    value = F.try_element_at("fields", F.lit(first))
    if not rest:
        return value.getField("display")
    inner = F.try_variant_get(F.try_parse_json(value.getField("json")), "$" + "".join(f"['{p}']" for p in rest.split(".")), "variant")
    text = F.try_variant_get(F.try_parse_json(value.getField("json")), "$" + "".join(f"['{p}']" for p in rest.split(".")), "string")
    return F.when(F.is_variant_null(inner), F.lit("null")).otherwise(text)


def has(key: str) -> Column:
    """A key of the top level, also where its value is null."""
    return F.map_contains_key("fields", F.lit(key))


def equals(key: str, value: str) -> Column:
    return F.coalesce(shown(key) == F.lit(value), F.lit(False))


def not_equals(key: str, value: str) -> Column:
    """Also true where the field is absent."""
    return ~shown(key).eqNullSafe(F.lit(value))


def contains(key: str, value: str) -> Column:
    return F.coalesce(F.contains(shown(key), F.lit(value)), F.lit(False))


def among(key: str, values: list[str]) -> Column:
    return F.coalesce(shown(key).isin(values), F.lit(False))


def parse(text: str) -> Column:
    """``k=v``, ``k!=v``, ``k~=v`` or ``k=a,b``."""
    key, sign, value = text.partition("=")
    if not sign or not key.strip("!~"):
        raise ValueError(f"not a filter: {text!r}")
    if key.endswith("!"):
        return not_equals(key[:-1], value)
    if key.endswith("~"):
        return contains(key[:-1], value)
    return among(key, [v.strip() for v in value.split(",")]) if "," in value else equals(key, value)


def where(docs: DataFrame, *predicates: Column) -> DataFrame:
    """Rows that meet all; any predicate at all leaves out documents without readable frontmatter."""
    if not predicates:
        return docs
    return docs.filter(F.col("fm_state") == "ok").filter(reduce(lambda a, b: a & b, predicates))
