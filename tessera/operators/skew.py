"""A few keys holding most records: per-key work without the imbalance.

Method: fragment and replicate by estimated load. Keys are bin-packed to tasks by their row counts; a key that
is heavier than a task's share is split into as many shards as its load asks for, and what is joined to it is
replicated to those shards only. Rows are sent to their task by number, so no task gets more than its share.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Light keys share this many buckets for each task; a bucket is packed as one.
BUCKETS_PER_TASK = 16
#: A key is packed by itself if it holds more than this part of a task's share. So there are at most tasks / HEAVY such keys.
HEAVY = 0.25


@dataclass
class LoadPlan:
    """Which task a bucket of light keys goes to, and which tasks the shards of a heavy key go to."""

    tasks: int
    buckets: list[int]
    heavy: dict[str, list[int]]
    loads: list[float]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(17), key), F.lit(len(self.buckets))).cast("int")

    def _tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The plan as two tables of at most ``tasks * BUCKETS_PER_TASK`` and ``tasks / HEAVY`` rows: task of a bucket, and tasks of a heavy key."""
        light = spark.createDataFrame(pa.table({"_b": pa.array(range(len(self.buckets)), pa.int32()), "_light": pa.array(self.buckets, pa.int32())}))
        heavy = spark.createDataFrame(pa.table({"_h": pa.array(list(self.heavy), pa.string()), "_shards": pa.array(list(self.heavy.values()), pa.list_(pa.int32()))}))
        return F.broadcast(light), F.broadcast(heavy)

    def _planned(self, rows: DataFrame, key: str) -> DataFrame:
        light, heavy = self._tables(rows.sparkSession)
        rows = rows.withColumn("_b", self.bucket(F.col(key)))
        return rows.join(light, "_b", "left").join(heavy, F.col(key) == F.col("_h"), "left").drop("_b", "_h")

    def place(self, rows: DataFrame, key: str, spread: Column) -> DataFrame:
        """``rows`` with ``_task``: the task of its key's bucket, or for a heavy key that of its shard, chosen by ``spread``."""
        shard = F.get("_shards", F.pmod(F.xxhash64(F.lit(23), spread), F.size("_shards")).cast("int"))
        return self._planned(rows, key).withColumn("_task", F.coalesce(shard, "_light")).drop("_light", "_shards")

    def replicate(self, rows: DataFrame, key: str) -> DataFrame:
        """A row for every task that holds rows of its key, in ``_task``."""
        tasks = F.array_distinct(F.coalesce("_shards", F.array("_light")))
        return self._planned(rows, key).withColumn("_task", F.explode(tasks)).drop("_light", "_shards")


def plan_loads(rows: DataFrame, key: str, tasks: int) -> LoadPlan:
    """Count rows by key (merged before the shuffle), pack buckets and shards onto tasks, heaviest first.

    To the driver come the counts of ``tasks * BUCKETS_PER_TASK`` buckets and of at most ``tasks / HEAVY`` keys.
    Null keys have no load. ``key`` is a string column.
    """
    n = tasks * BUCKETS_PER_TASK
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).count()
    total = F.sum("count")
    heavy_share = HEAVY / tasks
    totals = counts.agg(total.alias("total")).select("total")
    marked = counts.withColumn("heavy", F.col("count") > heavy_share * totals.scalar())
    bucket = F.pmod(F.xxhash64(F.lit(17), F.col("k")), F.lit(n)).cast("int")
    summed = marked.groupBy(F.when(F.col("heavy"), F.col("k")).alias("k"), F.when(~F.col("heavy"), bucket).alias("b")).agg(F.sum("count").alias("load")).collect()
    whole = sum(r.load for r in summed)
    share = max(1.0, whole / tasks)
    items = []
    for r in summed:
        if r.k is None:
            items.append((float(r.load), r.b, None))
        else:
            shards = max(1, math.ceil(r.load / share))
            items += [(r.load / shards, None, r.k)] * shards
    loads = [(0.0, t) for t in range(tasks)]
    heapq.heapify(loads)
    buckets, heavy = [i % tasks for i in range(n)], {}
    for load, b, k in sorted(items, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2] or "")):
        held, t = heapq.heappop(loads)
        if k is None:
            buckets[b] = t
        else:
            heavy.setdefault(k, []).append(t)
        heapq.heappush(loads, (held + load, t))
    return LoadPlan(tasks, buckets, heavy, [h for h, _ in sorted(loads, key=lambda x: x[1])])


def _tasks(df: DataFrame, tasks: int | None) -> int:
    return tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def balanced_join(left: DataFrame, right: DataFrame, key: str, spread: str, tasks: int | None = None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``: heavy keys of the left are sharded by ``spread``, their right rows replicated to the shards.

    ``how`` is ``inner`` or ``left``. Null keys match nothing; with ``left`` their rows are kept. Columns of the right that the left
    has too come out as ``right_<name>``. Either side may be empty.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    tasks = _tasks(left, tasks)
    k = F.col(key).cast("string")
    plan = plan_loads(left.select(k.alias("_k")), "_k", tasks)
    sent = plan.place(left.withColumn("_k", k), "_k", F.col(spread))
    # rows without a key meet nothing, so any task will do
    sent = sent.withColumn("_task", F.when(F.col("_k").isNotNull(), F.col("_task")).otherwise(F.pmod(F.xxhash64(spread), F.lit(tasks)).cast("int")))
    clash = [c for c in right.columns if c != key and c in left.columns]
    copies = right.withColumnsRenamed({c: f"right_{c}" for c in clash}).withColumn("_k", k).where("_k is not null").drop(key)
    copies = plan.replicate(copies, "_k")
    # both sides go to their tasks by number, and the join needs no other exchange
    return sent.repartitionById(tasks, "_task").hint("shuffle_merge").join(copies.repartitionById(tasks, "_task"), ["_task", "_k"], how).drop("_task", "_k")


def per_key_results(rows: DataFrame, key: Column, label: Column, record: Column, large: float = 0.025, tasks: int | None = None) -> DataFrame:
    """``key, n_rows, n_labels, n_records, share, is_large``: for every key its rows, distinct labels and distinct records.

    Share is of all rows, those without a key included; a key of more than ``large`` of them is large. A row with a null label or
    record counts as a row only. Heavy keys are counted in shards by record: the counts of records add up, and the labels of
    the shards are merged once more. An empty table gives no rows.
    """
    tasks = _tasks(rows, tasks)
    picked = rows.select(key.cast("string").alias("_k"), label.cast("string").alias("_l"), record.cast("string").alias("_r"))
    plan = plan_loads(picked.select("_k"), "_k", tasks)
    # rows without a record have nothing to be told apart by; they are counted by label before anything is sent
    bare = picked.where("_k is not null and _r is null").groupBy("_k", "_l").agg(F.count("*").alias("n"))
    held = plan.place(picked.where("_k is not null and _r is not null"), "_k", F.col("_r"))
    # by number: every task gets the keys and shards that were packed for it
    placed = held.repartitionById(tasks, "_task")
    # within its task each shard is reduced to its distinct records and labels before anything is sent on
    records = placed.groupBy("_task", "_k", "_r").agg(F.count("*").alias("n")).groupBy("_task", "_k").agg(F.sum("n").alias("n"), F.count("_r").alias("records"))
    labels = placed.where("_l is not null").select("_task", "_k", "_l").distinct()
    none = F.lit(0).cast("long")
    both = records.select("_k", F.lit(None).cast("string").alias("_l"), "n", "records").union(labels.select("_k", "_l", none, none)).union(bare.select("_k", "_l", "n", none))
    by_label = both.groupBy("_k", "_l").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
    merged = by_label.groupBy("_k").agg(F.sum("n").alias("n_rows"), F.count("_l").alias("n_labels"), F.sum("records").alias("n_records"))
    share = F.col("n_rows") / picked.agg(F.count("*").alias("c")).scalar()
    return merged.select(F.col("_k").alias("key"), "n_rows", "n_labels", "n_records", share.alias("share"), (share > large).alias("is_large"))
