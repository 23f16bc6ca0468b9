"""Map and JSON metadata expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_metadata(left: Column, right: Column) -> Column:
    """Union of two maps; on a shared key the right value wins. A null map counts as empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    left, right = F.coalesce(left, none), F.coalesce(right, none)
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def drop_empty(meta: Column) -> Column:
    """Keep entries whose value is neither null nor the empty text."""
    return F.map_filter(meta, lambda _, v: F.coalesce(v != "", F.lit(False)))


def metadata_text(meta: Column) -> Column:
    """Canonical JSON of a string map: entries in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta))))


def page_number_of(metadata_json: Column) -> Column:
    """``page_number`` of JSON metadata, null when absent or not a whole number."""
    return F.get_json_object(metadata_json, "$.page_number").try_cast("int")
