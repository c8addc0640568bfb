"""JSON path expressions with dotted-key semantics.

A dotted path ``a.b`` first looks for a literal key ``"a.b"``, then walks the
nested objects. All of it stays in JVM expressions (``get_json_object`` /
variant), so it runs inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nested(path: str) -> str:
    return "$" + "".join(f"['{part}']" for part in path.split("."))


def json_path(doc, path: str) -> Column:
    """Value at a dotted path (JSON text for objects/arrays, raw text for scalars)."""
    doc = _col(doc)
    if "." not in path:
        return F.get_json_object(doc, f"$['{path}']")
    return F.coalesce(F.get_json_object(doc, f"$['{path}']"), F.get_json_object(doc, _nested(path)))


def first_path(doc, paths: Iterable[str]) -> Column:
    """First non-null value over an ordered list of dotted paths."""
    return F.coalesce(*[json_path(doc, p) for p in paths])


def dynamic_path(doc, path_col) -> Column:
    """A path held in a column (per-source ``weight_field``).

    A literal dotted key wins, else the nested walk. ``get_json_object``
    accepts a column-valued path.
    """
    doc, path_col = _col(doc), _col(path_col)
    literal = F.call_function("get_json_object", doc, F.concat(F.lit("$['"), path_col, F.lit("']")))
    nested = F.call_function("get_json_object", doc, F.concat(F.lit("$."), path_col))
    return F.coalesce(literal, nested)


# --- VARIANT forms: parse an item once, then read many paths from it. -------

def variant_path(v, path: str) -> Column:
    """N1 on a parsed item: literal dotted key first, then the nested walk.
    Scalars come back as text, objects/arrays as JSON text, JSON null as NULL."""
    v = _col(v)
    literal = F.try_variant_get(v, f"$['{path}']", "string")
    if "." not in path:
        return literal
    return F.coalesce(literal, F.try_variant_get(v, _nested(path), "string"))


def variant_first(v, paths: Iterable[str]) -> Column:
    return F.coalesce(*[variant_path(v, p) for p in paths])


def variant_nested(v, path: str) -> Column:
    """The nested walk of a dotted path alone; null for a path of one key."""
    return F.try_variant_get(_col(v), _nested(path), "string") if "." in path else F.lit(None).cast("string")


def variant_texts(v, keys: Iterable[str]) -> Column:
    """The values at literal keys of a parsed item as one struct, each as ``variant_path`` gives it: the item is walked once
    instead of once per key. Null where the value is no object."""
    fields = ", ".join(f"`{k}`: string" for k in keys)
    return F.try_variant_get(_col(v), "$", f"struct<{fields}>")


def variant_type(v, path: str) -> Column:
    """Type name of the value at a dotted path (literal key first)."""
    v = _col(v)
    lit = F.try_variant_get(v, f"$['{path}']", "variant")
    node = lit if "." not in path else F.coalesce(lit, F.try_variant_get(v, _nested(path), "variant"))
    return F.schema_of_variant(node)


def variant_is_string(v, path: str) -> Column:
    return F.coalesce(variant_type(v, path) == F.lit("STRING"), F.lit(False))


def variant_array_items(v, keys: Iterable[str]) -> Column:
    """S1 on a parsed page: the first key (in order) holding an array, as
    array<variant>. A non-array value casts to NULL, so ``coalesce`` falls
    through to the next key; nothing found gives an empty array."""
    v = _col(v)
    arrays = [F.try_variant_get(v, f"$['{k}']", "array<variant>") for k in keys]
    return F.coalesce(*arrays, F.array().cast("array<variant>"))


def variant_is_object(v) -> Column:
    return F.coalesce(F.schema_of_variant(_col(v)).startswith("OBJECT"), F.lit(False))
