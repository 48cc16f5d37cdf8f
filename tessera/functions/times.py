"""Times as text and as differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_char(time: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)


def seconds_between(start: Column | str, finish: Column | str) -> Column:
    """Whole seconds from start to finish, below 0 where the finish is earlier; null where either is."""
    return F.timestamp_diff("SECOND", F.col(start) if isinstance(start, str) else start, F.col(finish) if isinstance(finish, str) else finish)


def age(seconds: Column) -> Column:
    """A duration as ``3 days 04:05:06``, without days as ``04:05:06``."""
    days = F.floor(seconds / 86_400)
    clock = F.concat_ws(":", *[F.lpad(F.floor(F.pmod(seconds, F.lit(m)) / d).cast("string"), 2, "0") for m, d in ((86_400, 3_600), (3_600, 60), (60, 1))])
    return F.when(seconds.isNotNull(), F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day ").otherwise(" days "), clock)).otherwise(clock))
