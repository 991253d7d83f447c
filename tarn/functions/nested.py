"""Maps and JSON values: containment, keys, merging, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_entries(m: Column, entries: dict[str, str]) -> Column:
    """Whether the map has all these entries; a missing key is a no."""
    return reduce(Column.__and__, (F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False)) for k, v in entries.items()))


def has_any_key(m: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(m), F.array(*(F.lit(k) for k in keys)))


def merged_maps(first: Column, second: Column) -> Column:
    """Entries of both; where both have a key the second one's value counts.  A null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(first, none), F.coalesce(second, none)
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def json_type(value: str, field: str) -> Column:
    """The JSON type of the field (named in a column) of an object: object, array, string, number, boolean or null."""
    found = F.expr(f"schema_of_variant(variant_get(try_parse_json({value}), concat('$.', {field}), 'variant'))")
    low = F.lower(found)
    return (
        F.when(low.startswith("object"), "object").when(low.startswith("array"), "array").when(low == "string", "string").when(low == "boolean", "boolean").when(low == "void", "null").otherwise("number")
    )
