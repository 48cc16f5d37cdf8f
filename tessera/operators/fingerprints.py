"""Order-independent fingerprints of tables and configurations."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid_of(digest: Column) -> Column:
    """An md5 digest written as a uuid."""
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def row_digest(columns: list[str]) -> Column:
    """md5 of the columns as text, nulls marked, so that no two rows read the same."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def table_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n, fingerprint``: one row. The sums of the four words of all row digests are hashed, so rows are neither sorted nor gathered, and a repeated row counts."""
    d = rows.select(row_digest(columns).alias("d"))
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    s = d.agg(F.count("*").alias("n"), *[F.coalesce(w, F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    return s.select("n", uuid_of(F.md5(F.concat_ws(",", "n", "w0", "w1", "w2", "w3"))).alias("fingerprint"))


def group_fingerprints(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The same for each group: ``by, n, fingerprint``."""
    d = rows.select(by, row_digest(columns).alias("d"))
    words = [F.sum(F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    s = d.groupBy(by).agg(F.count("*").alias("n"), *[w.cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    return s.select(by, "n", uuid_of(F.md5(F.concat_ws(",", "n", "w0", "w1", "w2", "w3"))).alias("fingerprint"))


def vector_text(embedding: Column | str) -> Column:
    """A vector as text, its entries in millionths, so that other engines read it alike."""
    return F.array_join(F.transform(embedding, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string")), ",")


def split_fingerprints(split_instances: DataFrame, instances: DataFrame, datasetsplits: DataFrame) -> DataFrame:
    """``datasetsplit, n, fingerprint``: of each split assignment which instance (by ``global_id``) is in which split."""
    names = datasetsplits.select(F.col("id").alias("datasetsplit_id"), F.col("name").alias("datasetsplit"))
    rows = split_instances.join(instances.select(F.col("id").alias("instance_id"), "global_id"), "instance_id").join(names, "datasetsplit_id")
    return group_fingerprints(rows, "datasetsplit", ["global_id", "split"])


def vector_fingerprints(vectors: DataFrame, split_instances: DataFrame, instances: DataFrame, datasetsplits: DataFrame) -> DataFrame:
    """The same of the vectors of each split assignment's instances; ``vectors`` is ``key, embedding``."""
    names = datasetsplits.select(F.col("id").alias("datasetsplit_id"), F.col("name").alias("datasetsplit"))
    texts = vectors.select(F.col("key").alias("instance_id"), vector_text("embedding").alias("embedding"))
    rows = split_instances.join(texts, "instance_id").join(instances.select(F.col("id").alias("instance_id"), "global_id"), "instance_id").join(names, "datasetsplit_id")
    return group_fingerprints(rows, "datasetsplit", ["global_id", "embedding"])


def config_hash(config: dict) -> str:
    """md5 of a configuration written canonically: sorted keys, no blanks."""
    return hashlib.md5(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def set_hash(identifiers: list[str]) -> str:
    """md5 of sorted identifiers: the order of runs doesn't matter."""
    return hashlib.md5("".join(sorted(identifiers)).encode()).hexdigest()
