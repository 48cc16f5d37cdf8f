"""Positions within keys, without gathering a key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_rank(rows: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``rank``, 0 to n-1 within each key.

    Rows are numbered within (key, bucket), buckets being a hash of the ordering columns, and a bucket begins where those before it
    end. So a key of many rows is spread over all buckets. ``order`` must identify a row within its key.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(5), *order), F.lit(buckets)))
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    # at most as many rows for each key as there are buckets
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(inner) - 1).join(starts, [*keys, "_b"]).withColumn("rank", F.col("rank") + F.col("_start")).drop("_b", "_start")
