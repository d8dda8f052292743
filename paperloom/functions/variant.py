"""Values of unknown shape: functions over ``VARIANT`` columns (``F.try_parse_json`` makes one of JSON text).

Objects keep their keys in the order of the alphabet, as Spark stores them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def fields_of(v: Column) -> Column:
    """The fields of an object as a map; null for anything else."""
    return _as(v, "map<string,variant>")


def items_of(v: Column) -> Column:
    """The items of a list; null for anything else."""
    return _as(v, "array<variant>")


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def path_get(v: Column, path: Column | str, default: Column | str | None = None) -> Column:
    """The value at ``a.b.c`` as a variant, ``default`` where a step is missing or no object; an empty path is all of it.

    Steps are taken as they stand (no brackets or quotes are read), so keys may hold any character but a full stop.
    """
    steps = F.filter(F.split(_column(path), r"\."), lambda s: s != "")
    found = F.aggregate(steps, v, lambda at, step: F.try_element_at(fields_of(at), step))
    return found if default is None else F.coalesce(found, _column(default).cast("variant"))


def unwrap_value(v: Column, key: Column | str) -> Column:
    """``{key: {"value": x}}`` and ``{key: x}`` both give x; an object without ``value`` gives null."""
    at = F.try_element_at(fields_of(v), _column(key))
    return F.when(fields_of(at).isNotNull(), F.try_element_at(fields_of(at), F.lit("value"))).otherwise(at)


def text_of(v: Column) -> Column:
    """Scalars as text, lists and objects as JSON; null and JSON null give null."""
    return _as(v, "string")


def sanitise(v: Column, list_most: Column | int = 50, text_most: Column | int = 1000, key_most: Column | int | None = None, depth_most: int = 6, deep: str = "[truncated-depth]", more: str = "… [truncated]") -> Column:
    """The value with lists and objects cut to ``list_most`` entries, and texts and keys to their lengths.

    Cut texts end in ``more``; what lies below ``depth_most`` levels is the text ``deep``. Of keys that become equal
    the first stays. Other scalars stay. Null gives null. The result is JSON text; parse it for a variant.
    """
    key_most = text_most if key_most is None else key_most

    def short(t: Column, most: Column | int) -> Column:
        return F.when(F.length(t) > _column(most), F.concat(F.left(t, _column(most)), F.lit(more))).otherwise(t)

    def quoted(t: Column) -> Column:
        return F.to_json(t.cast("variant"))

    def named(x: Column) -> Column:
        """Children of a list or an object in one shape: key (null in lists) and value."""
        listed = F.transform(items_of(x), lambda i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("value")))
        cut = F.transform(F.slice(F.map_entries(fields_of(x)), F.lit(1), _column(list_most)), lambda e: F.struct(short(e["key"], key_most).alias("key"), e["value"].alias("value")))
        keys = F.transform(cut, lambda e: e["key"])
        first = F.filter(cut, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        return F.coalesce(F.slice(listed, F.lit(1), _column(list_most)), first)

    def fix(x: Column, depth: int) -> Column:
        if depth >= depth_most:
            return F.when(x.isNull(), F.lit("null")).otherwise(quoted(F.lit(deep)))
        inner = F.transform(named(x), lambda e: F.concat(F.coalesce(F.concat(quoted(e["key"]), F.lit(":")), F.lit("")), fix(e["value"], depth + 1)))
        scalar = F.when(x.isNull() | F.is_variant_null(x), F.lit("null")).when(is_text(x), quoted(short(text_of(x), text_most))).otherwise(F.to_json(x))
        listed = F.left(F.schema_of_variant(x), F.lit(5)) == "ARRAY"
        nested = F.concat(F.when(listed, "[").otherwise("{"), F.array_join(inner, ","), F.when(listed, "]").otherwise("}"))
        return F.when(named(x).isNotNull(), nested).otherwise(scalar)

    return F.when(v.isNotNull(), fix(v, 0))
