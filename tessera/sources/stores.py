"""Keyed tables: idempotent imports, updates, lookups and copies as joins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, stored: DataFrame, identity: str, order: str) -> DataFrame:
    """Rows whose identity isn't stored yet, each identity once: of several the one that comes first by ``order``. Null identities are left out."""
    rows = incoming.where(F.col(identity).isNotNull())
    others = [c for c in incoming.columns if c != identity]
    one = rows.groupBy(identity).agg(F.min_by(F.struct(*others), order).alias("_r")).select(identity, "_r.*").select(*incoming.columns)
    return one.join(stored.select(identity), identity, "left_anti").select(*incoming.columns)


def new_links(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Bridge rows that aren't stored, each once: an insert that ignores conflicts."""
    return incoming.distinct().join(stored, incoming.columns, "left_anti")


def overlay(stored: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key`` and ``columns``: stored rows with the update's values where they aren't null, and the update's rows that weren't stored."""
    u = update.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns])
    return stored.select(key, *columns).join(u, key, "full").select(key, *[F.coalesce(f"_u_{c}", c).alias(c) for c in columns])


def missing(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Keys the store doesn't have."""
    return keys.join(store.select(key), key, "left_anti")


def present(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return keys.join(store.select(key), key, "left_semi")


def without(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The store after these keys were deleted."""
    return store.join(keys.select(key), key, "left_anti")


def back_off(keys: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of the keys from the first store, and from the second where the first has none."""
    got = first.join(keys.select(key).distinct(), key, "left_semi")
    rest = missing(keys.select(key).distinct(), first, key)
    return got.unionByName(second.join(rest, key, "left_semi"), allowMissingColumns=True)


def with_vectors(keys: DataFrame, stores: dict[str, DataFrame], key: str = "key", embedding: str = "embedding") -> DataFrame:
    """Keys with a vector column for each store, null where it has none."""
    for name, store in stores.items():
        keys = keys.join(store.select(key, F.col(embedding).alias(name)), key, "left")
    return keys


def copy_by_global_id(vectors: DataFrame, source: DataFrame, target: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``key, embedding``: vectors under the target's ids, matched through ``global_id`` (tables of ``id, global_id``); keys already stored are left out.

    Of several source rows for one target the vector of the smallest source id is copied.
    """
    pairs = source.select(F.col("id").alias("key"), "global_id").join(target.select(F.col("id").alias("new"), "global_id"), "global_id")
    found = vectors.join(pairs, "key").groupBy("new").agg(F.min_by("embedding", "key").alias("embedding")).select(F.col("new").alias("key"), "embedding")
    return found if stored is None else missing(found, stored, "key")


def open_store(spark: SparkSession, url: str, dim: int | None = None) -> DataFrame:
    """``key, embedding`` of a vector store named by a URL.

    ``file:`` and other file systems hold Parquet of key and embedding; ``table:name`` is a table of the catalog; ``model:path?model=m&masking=k`` is the part
    of a table of several models. With ``dim`` vectors of another length are left out.
    """
    scheme, _, rest = url.partition(":")
    if scheme == "table":
        rows = spark.table(rest)
    elif scheme == "model":
        path, _, query = rest.partition("?")
        rows = spark.read.parquet(path)
        for k, v in re.findall(r"(\w+)=([^&]*)", query):
            if k not in ("model", "masking"):
                raise ValueError(f"a store is chosen by model and masking, not by {k!r}")
            rows = rows.where(F.col(k) == v)
    else:
        rows = spark.read.parquet(url)
    rows = rows.select("key", "embedding")
    return rows if dim is None else rows.where(F.size("embedding") == dim)


def count_and_dims(store: DataFrame) -> DataFrame:
    """``dims, n``: how many vectors of each length; null vectors have null dims."""
    return store.groupBy(F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims")).agg(F.count("*").alias("n"))


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Write the rows whose key isn't in the store yet to it, each key once; how many. A store that isn't there is begun."""
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    from tessera.storage import materialize

    held = materialize(rows.dropDuplicates([key]), "append")
    n = held.count()
    if n:
        held.write.mode("append").parquet(path)
    return n


def append_log(spark: SparkSession, path: str, name: str, messages: list[str]) -> None:
    """Messages of a run as rows of a log table, with their time and their place among those of the call; nothing written is changed."""
    rows = spark.createDataFrame([(name, i, m) for i, m in enumerate(messages)], "name string, i int, message string")
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
