"""Reading of loosely shaped JSON as variants: maps or lists of named objects, lists or bare values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def members(value: Column) -> Column:
    """The members of an object as map<string,variant>; null for anything else."""
    return value.try_cast("map<string,variant>")


def text(value: Column) -> Column:
    """A scalar as text; null for null, objects and arrays."""
    return F.when(members(value).isNull() & value.try_cast("array<variant>").isNull(), value.try_cast("string"))


def read_object(payload: Column) -> Column:
    """The members of a JSON object, or of one written as JSON text inside a JSON string; else null."""
    value = F.try_parse_json(payload)
    return F.coalesce(members(value), members(F.try_parse_json(value.try_cast("string"))))


def as_list(value: Column) -> Column:
    """The elements of an array; a bare value counts as a list of one, null and null elements as none."""
    elements = F.coalesce(value.try_cast("array<variant>"), F.array(value))
    return F.filter(F.when(value.isNull(), F.array().cast("array<variant>")).otherwise(elements), lambda e: ~F.is_variant_null(e))


def as_named(value: Column, key: str) -> Column:
    """Named objects as an array of (name, object): from a map by name, from a list of objects that hold
    their name under ``key``, or from one such object. What has no name or is no object is left out."""
    own = members(value)
    listed = F.transform(as_list(value), lambda e: F.struct(text(F.element_at(members(e), key)).alias("name"), members(e).alias("object")))
    mapped = F.transform(F.map_entries(own), lambda e: F.struct(e["key"].alias("name"), members(e["value"]).alias("object")))
    bare = own.isNotNull() & text(F.element_at(own, key)).isNotNull()
    return F.filter(F.when(own.isNotNull() & ~bare, mapped).otherwise(listed), lambda e: e["name"].isNotNull() & e["object"].isNotNull())


def get(map_column: Column, key: str) -> Column:
    """A member by name, null if it is absent."""
    return F.element_at(map_column, key)


def each(array: Column, make: Callable[[Column], Column]) -> Column:
    """``transform`` without an index."""
    return F.transform(array, lambda e: make(e))
