"""Array predicates and set operations with the semantics of array operators in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(col: Column | str, values: list) -> Column:
    """``col = ANY(values)``; false for an empty list."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(*values) if values else F.lit(False)


def differs_from_any(col: Column | str, values: Column | list) -> Column:
    """``col <> ANY(values)``: true if at least one element differs. With two different elements it is always true for a value that isn't null."""
    c = F.col(col) if isinstance(col, str) else col
    array = values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])
    return F.exists(array, lambda e: e != c)


def same_set(a: Column | str, b: Column | str) -> Column:
    """Each array contains the other; order and repetition don't matter."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def subset(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(a, b)) == 0


def minus(a: Column | str, b: Column | str) -> Column:
    """Elements of the first that are none of the second; an empty array where nothing remains."""
    return F.array_except(a, b)


def length(a: Column | str) -> Column:
    """Length of an array, null for null and for an empty one."""
    n = F.size(a)
    return F.when(n > 0, n)


def unnest_lockstep(df: DataFrame, **columns: str) -> DataFrame:
    """Several arrays unnested side by side, the shorter ones padded with null; a row without elements is kept with nulls."""
    names = list(columns)
    zipped = F.explode_outer(F.arrays_zip(*[F.col(columns[n]).alias(n) for n in names]))
    out = df.withColumn("_z", zipped)
    return out.select("*", *[F.col(f"_z.{n}").alias(n) for n in names]).drop("_z")


def text_array(json: Column | str) -> Column:
    """A JSON array of strings as an array."""
    return F.from_json(json, "array<string>")


def sentence_like(tokens: Column | str, pattern: str) -> Column:
    """Lower-case tokens joined by blanks, null tokens as ``*``, match a LIKE pattern."""
    return F.array_join(F.transform(tokens, lambda t: F.lower(t)), " ", "*").like(pattern)


def appended(array: Column | str, value) -> Column:
    """The array with one more element; a null array counts as an empty one."""
    a = F.col(array) if isinstance(array, str) else array
    return F.when(a.isNull(), F.array(F.lit(value))).otherwise(F.array_append(a, F.lit(value)))
