"""JSON of uncertain shape made into a struct of a given one: a template of defaults is compiled to one expression.

A template is a dict: of texts, numbers, truth values, lists and dicts, each of which is the default and says the type. ``[]``
is a list of texts, ``[{...}]`` a list of structs, ``{}`` any object, kept as JSON text. Values of other types are cast, a
scalar becomes a list of one, and what can't be cast is the default. Text that is no JSON object gives the defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

TRUE_WORDS = ("1", "true", "yes", "y")
_WHOLE, _NUMBER = r"^[+-]?\d+$", r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"


def coerced(json: Column, template: dict) -> Column:
    """The struct of ``template`` from JSON text."""
    return let(F.try_parse_json(json), lambda v: _struct(v, "$", template))


def _kind(v: Column, path: str) -> Column:
    """The type of the value at the path, without what it holds; null for null and for no value."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^(\w+)", 1), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    raw = F.try_variant_get(v, path, "string")
    return F.when(_kind(v, path) == "BOOLEAN", F.initcap(raw)).otherwise(raw)


def _struct(v: Column, path: str, template: dict) -> Column:
    return F.struct(*[_value(v, f"{path}['{k}']", default).alias(k) for k, default in template.items()])


def _value(v: Column, path: str, default) -> Column:
    if isinstance(default, dict):
        return _struct(v, path, default) if default else F.when(_kind(v, path) == "OBJECT", F.try_variant_get(v, path, "string")).otherwise("{}")
    if isinstance(default, list):
        return _structs(v, path, default[0]) if default else _list(v, path)
    kind, raw = _kind(v, path), F.try_variant_get(v, path, "string")
    said = F.trim(raw)
    if isinstance(default, bool):
        number = F.try_variant_get(v, path, "double")
        return (
            F.when(kind.isNull(), default).when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean")).when(kind == "STRING", F.lower(said).isin(*TRUE_WORDS))
            .when(kind.isin("ARRAY", "OBJECT"), ~raw.isin("[]", "{}")).otherwise(number != 0)
        )
    if isinstance(default, (int, float)):
        to, pattern = ("bigint", _WHOLE) if isinstance(default, int) else ("double", _NUMBER)
        truth = F.try_variant_get(v, path, "boolean").cast("int").cast(to)
        number = F.try_variant_get(v, path, "double" if to == "double" else "decimal(38,10)").cast(to)
        found = F.when(kind == "BOOLEAN", truth).when(kind == "STRING", F.when(F.rlike(said, F.lit(pattern)), said.try_cast(to))).when(~kind.isin("ARRAY", "OBJECT"), number)
        return F.coalesce(found, F.lit(default).cast(to))
    return F.when(kind.isNull(), F.lit(default)).otherwise(F.trim(_text(v, path)))


def _texts(items: Column) -> Column:
    return F.transform(items, lambda x: _text(x, "$"))


def _list(v: Column, path: str) -> Column:
    """An array of texts from an array, an array's JSON in a text, a text with separators, or one value."""
    kind, empty = _kind(v, path), F.array().cast("array<string>")
    items = lambda x, p: _texts(F.try_variant_get(x, p, "array<variant>"))

    def of_text(t: Column) -> Column:
        parsed = items(F.try_parse_json(t), "$")
        parts = F.filter(F.transform(F.split(t, "[、,，;/；|]+"), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(F.rlike(t, F.lit(r"(?s)^\[.*\]$")), F.coalesce(parsed, F.array(t))).otherwise(parts)

    return F.when(kind.isNull(), empty).when(kind == "ARRAY", items(v, path)).when(kind == "STRING", let(F.trim(F.try_variant_get(v, path, "string")), of_text)).otherwise(F.array(_text(v, path)))


def _structs(v: Column, path: str, template: dict) -> Column:
    """An array of structs from an array or one object; of other values none."""
    kind = _kind(v, path)
    one = F.array(_struct(v, path, template))
    listed = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: _struct(x, "$", template))
    return F.when(kind == "ARRAY", listed).when(kind == "OBJECT", one).otherwise(F.slice(one, 1, 0))
