"""Keys of a posting beyond the run fields: one JSON object as text, which every later step can carry, sort and write."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk.functions.text import quote
from stellwerk.schema import RUN_FIELDS

KNOWN = ("run_id", "seq", *RUN_FIELDS)


def other_keys(values: Column) -> Column:
    """The JSON object of the keys that are no run fields, in their order; NULL if there is none.

    ``values`` is a map of variants, so numbers, texts, lists and objects stay what they are.
    """
    rest = F.map_filter(values, lambda k, _: ~k.isin(*KNOWN))
    return F.when(F.size(rest) > 0, F.to_json(rest, {"ignoreNullFields": "false"}))


def keys_of_line(line: Column) -> Column:
    """:func:`other_keys` of a JSON object given as text."""
    return other_keys(F.from_json(line, "map<string,variant>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}))


def keys_of_items(array: Column) -> Column:
    """:func:`other_keys` of every element of a JSON list of variants."""
    as_map = F.transform(array, lambda x: F.try_variant_get(x, "$", "map<string,variant>"))
    return F.transform(as_map, other_keys)


def extra_value(key: str, kind: str = "string", column: str = "extra") -> Column:
    """The value of a key as ``kind``; NULL without the key, or if its value is none of that kind.

    Any further path goes into ``key`` as Spark writes it: ``tags[0]``, ``budget.max``.
    """
    return F.expr(f"try_variant_get(try_parse_json(`{column}`), {quote('$.' + key)}, {quote(kind)})")


def merged_line(fields: Column, extra: Column) -> Column:
    """One JSON object with the fields of a struct and the keys of ``extra``, none of which may replace a field."""
    own, more = F.to_json(fields), keys_of_line(extra)
    both = F.concat(F.regexp_replace(own, r"\}$", ","), F.substring(more, 2, 2**31 - 1))
    return F.when(more.isNull(), own).when(own == "{}", more).otherwise(both)
