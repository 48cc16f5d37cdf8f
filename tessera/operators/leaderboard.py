"""Ranking runs by metrics, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(runs: DataFrame, partition: str, run: str, metrics: list[str], n: int | None = None) -> DataFrame:
    """``partition, run, rank_<metric>..., avg_rank, rank``: ranks with ties within each partition, highest metric first, a null or NaN metric last.

    The average of a run's ranks is ranked again; with ``n`` all runs ranked up to n come out, ties included. Ranks are counted from the
    numbers of runs at each value, so that a large partition isn't sorted in one task unless all its values differ.
    """
    rows = runs
    for m in metrics:
        value = F.coalesce(F.nanvl(F.col(m), F.lit(None).cast("double")), F.lit(float("-inf")))
        rows = _ranked(rows.withColumn("_v", value), partition, f"rank_{m}", descending=True)
    mean = sum((F.col(f"rank_{m}") for m in metrics), F.lit(0)) / float(len(metrics))
    rows = _ranked(rows.withColumn("avg_rank", mean).withColumn("_v", mean), partition, "rank", descending=False)
    rows = rows.select(partition, run, *[f"rank_{m}" for m in metrics], "avg_rank", "rank")
    return rows if n is None else rows.where(F.col("rank") <= n)


def _ranked(rows: DataFrame, partition: str, name: str, descending: bool) -> DataFrame:
    """``rows`` with the rank of ``_v`` within its partition: one more than the number of rows with a better value."""
    counts = rows.groupBy(F.col(partition).alias("_p"), "_v").agg(F.count("*").alias("_n"))
    order = F.desc("_v") if descending else F.asc("_v")
    before = F.sum("_n").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("_p", "_v", (F.coalesce(before, F.lit(0)) + 1).alias(name))
    same = rows[partition].eqNullSafe(ranks["_p"]) & rows["_v"].eqNullSafe(ranks["_v"])
    return rows.join(ranks, same).drop("_p", "_v")


def summary(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """``by, n, mean, std, min, q25, q50, q75, max`` of the values that are neither null nor NaN; std is the sample's, quartiles are interpolated."""
    v = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    q = lambda p: F.percentile("_v", F.lit(p))
    return runs.withColumn("_v", v).groupBy(by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("_v").alias("max"))


def status_counts(runs: DataFrame, by: str, status: str = "status") -> DataFrame:
    return runs.groupBy(by, status).agg(F.count("*").alias("n"))


def best_run(ranked: DataFrame, order: list[str]) -> DataFrame:
    """One row: of the best rank the first by all of ``order``."""
    return ranked.orderBy("rank", *order).limit(1)


def latest_successful(runs: DataFrame, key: str, finish: str, success: str) -> DataFrame:
    """Of each key the successful row that finished last; rows without a finish don't count. A null success is none."""
    rows = runs.where(F.coalesce(F.col(success), F.lit(False)) & F.col(finish).isNotNull())
    kept = [c for c in runs.columns if c not in (key, finish)]
    best = rows.groupBy(key).agg(F.max(F.struct(finish, *kept)).alias("_r"))
    return best.select(key, "_r.*").select(*runs.columns)


def best_settings(runs: DataFrame, experiment: str, setting: str, metric: str) -> DataFrame:
    """``experiment, setting, n, mean, rank``: of every experiment the settings whose mean over their runs (over seeds, above all) is the greatest.

    Runs without a score count for nothing; equally good settings are all given.
    """
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    means = runs.where(F.col(experiment).isNotNull()).groupBy(experiment, setting).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).where("n > 0")
    ranked = _ranked(means.withColumn("_v", F.round("mean", 9)), experiment, "rank", descending=True)
    return ranked.where("rank = 1").select(experiment, setting, "n", "mean", "rank")
