"""Vector expressions over ``array<float|double>``; computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if the lengths differ or an entry is null."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """The vector at unit length; the zero vector stays zero."""
    # the length is bound once by a lambda of its own: inside the inner one it would be computed for every entry
    bound = F.transform(F.array(F.struct(_doubles(v).alias("v"))), lambda s: _divided(s["v"], norm(s["v"])))
    return F.get(bound, F.lit(0))


def _divided(v: Column, length: Column) -> Column:
    return F.get(F.transform(F.array(length), lambda by: F.transform(v, lambda x: F.when(by > 0, x / by).otherwise(x))), F.lit(0))


def scale(v: Column | str, by: float) -> Column:
    return F.transform(_doubles(v), lambda x: x * by)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y)


def mix(unmasked: Column | str, masked: Column | str, alpha: float | str) -> Column:
    """``alpha`` parts of the unmasked and ``1 - alpha`` of the masked vector, at unit length."""
    alpha = float(alpha)
    return l2_normalize(F.zip_with(_doubles(unmasked), _doubles(masked), lambda x, y: alpha * x + (1 - alpha) * y))


def blend(first: Column | str, second: Column | str, alpha: float | str) -> Column:
    """``1 - alpha`` parts of the first and ``alpha`` of the second vector, not normalised: the other way round than :func:`mix`."""
    alpha = float(alpha)
    return F.zip_with(_doubles(first), _doubles(second), lambda x, y: (1 - alpha) * x + alpha * y)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return 1 - cosine(a, b)


def dims(v: Column | str) -> Column:
    return F.size(_col(v))


def constant(value: float, dim: int) -> Column:
    return F.array_repeat(F.lit(float(value)), dim)


def is_zero(v: Column | str) -> Column:
    return F.forall(_col(v), lambda x: x == 0)


def element_means(v: Column | str, dim: int) -> Column:
    """Aggregate: the element-wise mean of a group's vectors as one array. Partial sums are merged before the shuffle."""
    return F.array(*[F.avg(F.get(_doubles(v), F.lit(i))) for i in range(dim)])
