"""Where intermediate tables live.

Long plans are cut by writing a table into the folder that the cluster shares
(``spark.checkpoint.dir``), so a lost executor costs one stage and not the job.
Only a local session that names none gets a folder of its own; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. All of a local session runs on one machine, so it may go without; then it has a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a folder all its machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the tables this process wrote; how many. Results that are still lazy can't be read afterwards."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back: the lineage ends at the table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that has fewer partitions than the cluster has cores, over all of them; a larger scan is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
