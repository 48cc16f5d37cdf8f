"""JSON objects held as text: merged, changed and unnested inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = "map<string,variant>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def merge(base: Column | str, over: Column | str) -> Column:
    """The object ``base`` with the keys of ``over`` put in or replaced, whole values at a time; null where either is no object."""
    a, b = F.from_json(_col(base), _OBJECT), F.from_json(_col(over), _OBJECT)
    return F.to_json(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x)))


def set_key(base: Column | str, key: str, value: Column) -> Column:
    """The object with one key set to a number, text, yes/no or array."""
    return merge(base, F.to_json(F.struct(value.alias(key))))


def elements(array: Column | str) -> Column:
    """Elements of an array as JSON texts, to be exploded; null where it is no array."""
    return F.transform(F.from_json(_col(array), "array<variant>"), lambda x: F.to_json(x))


def texts(array: Column | str) -> Column:
    """Elements of an array as texts."""
    return F.from_json(_col(array), "array<string>")
