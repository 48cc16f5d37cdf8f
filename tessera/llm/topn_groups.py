"""Top N items within every group.

Method: statistics-guided skipping. The items are written clustered by group into files whose small row groups come in descending
score; their footers tell the best score of each. Row groups are then read in descending best score, and one is skipped once its
best is strictly below the N-th score so far of every group in it, of one group or of several.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize, new_path

#: Bytes of a row group of the clustered table.
ROW_GROUP_BYTES = 256 * 1024
#: Rows of a file, about; a group of more has files of its own.
BUCKET_ROWS = 500_000


def latest(rows: DataFrame, item: str, version: str, keep: list[str]) -> DataFrame:
    """One row for each item: that of its greatest version, a null version counting least.

    Of several rows of that version the one with the greatest remaining values is taken, so that the result
    doesn't depend on the order of the rows. Items whose id is null are left out.
    """
    rows = rows.select(F.col(item).alias("item"), F.col(version).alias("version"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).where("item is not null")
    kept = [f"k{i}" for i in range(len(keep))]
    # by aggregation and not by a window: copies of one item are merged before the shuffle
    return rows.groupBy("item").agg(F.max(F.struct("version", *kept)).alias("r")).select("item", *[f"r.{k}" for k in kept])


def cluster(items: DataFrame) -> str:
    """Write ``grp, score, item, bucket, size`` clustered by group, each file in descending score; the folder.

    Groups that can't have a file for themselves share a bucket, all of whose rows are in one file; ``size`` is how many rows the group has there.
    A group larger than a bucket is divided by score among files of its own, with a null ``size``. So in every file row groups come in descending
    best score, and the last ones hold what most groups don't need.
    """
    spark = items.sparkSession
    path = new_path(spark, "by-group")
    items = materialize(items.select("grp", "score", "item"), "items")
    sizes = materialize(items.groupBy("grp").agg(F.count("*").alias("size")), "sizes")
    large = sizes.where(F.col("size") > BUCKET_ROWS)
    files = max(1, -(-items.count() // BUCKET_ROWS))
    writer = lambda df, at: df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.size.row.check.min", 1000).parquet(f"{path}/{at}")
    bucket = F.pmod(F.xxhash64(F.lit(29), "grp"), F.lit(files)).cast("int")
    small = items.join(sizes.where(F.col("size") <= BUCKET_ROWS), "grp").withColumn("bucket", bucket).repartitionById(files, "bucket")
    writer(small.sortWithinPartitions(F.desc("score"), "grp", "item").select("grp", "score", "item", "size"), "shared")
    if not large.isEmpty():
        rest = items.join(large.select("grp"), "grp")
        # sorted ranges: the range bounds are taken from a sample, and a hot group is divided by its scores
        parts = max(1, -(-rest.count() // BUCKET_ROWS))
        rest = rest.repartitionByRange(parts, F.col("grp"), F.desc("score"), F.col("item")).sortWithinPartitions(F.col("grp"), F.desc("score"), F.col("item"))
        writer(rest.select("grp", "score", "item", F.lit(None).cast("long").alias("size")), "own")
    return path


def _open(name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
    return pq.ParquetFile(path, filesystem=system)


def _uri(name: str) -> str:
    return "file://" + name[len("file:") :] if name.startswith("file:/") and not name.startswith("file://") else name


def zones(spark, files: list[str]) -> DataFrame:
    """``file, rg, n, lo, hi, worst, best``: what the footers tell of each row group."""

    def read(batches):
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                f = _open(name)
                at = {f.metadata.row_group(0).column(c).path_in_schema: c for c in range(f.metadata.num_columns)} if f.metadata.num_row_groups else {}
                for g in range(f.metadata.num_row_groups):
                    r = f.metadata.row_group(g)
                    a, s = r.column(at["grp"]).statistics, r.column(at["score"]).statistics
                    out.append((name, g, r.num_rows, a.min, a.max, s.min, s.max))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["file", "rg", "n", "lo", "hi", "worst", "best"])

    names = spark.createDataFrame([(_uri(f),) for f in files], "file string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return names.mapInArrow(read, "file string, rg int, n long, lo long, hi long, worst double, best double")


class Best:
    """The n best of every group among the rows seen so far, and what that says of rows still unseen."""

    def __init__(self, n: int):
        self.n = n
        self.grp, self.score, self.item = np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8")
        self.groups, self.seen, self.size, self.nth = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)

    def add(self, grp: np.ndarray, score: np.ndarray, item: np.ndarray, size: np.ndarray) -> None:
        groups, at, counts = np.unique(np.concatenate([self.groups, grp]), return_inverse=True, return_counts=True)
        seen, sizes = np.zeros(len(groups), "i8"), np.zeros(len(groups), "i8")
        old = at[: len(self.groups)]
        seen[old] = self.seen
        seen += counts - np.bincount(old, minlength=len(groups))
        sizes[old] = self.size
        sizes[at[len(self.groups) :]] = size
        g, s, i = (np.concatenate(x) for x in ((self.grp, grp), (self.score, score), (self.item, item)))
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        runs = np.diff(np.r_[start, len(g)])
        first = np.arange(len(g)) - np.repeat(start, runs) < self.n
        nth = np.where(runs >= self.n, s[np.minimum(start + self.n - 1, len(s) - 1)], -np.inf)
        self.grp, self.score, self.item = g[first], s[first], i[first]
        self.groups, self.seen, self.size, self.nth = groups, seen, sizes, nth

    def may_skip(self, lo: int, hi: int, best: float, rows: int | None) -> bool:
        """Whether no row of a row group can be among the n best of a group it holds: its best score is strictly below the n-th of each.

        ``rows``: of a file of whole groups, all its rows. Which groups the row group holds is then known up to those of which all rows were
        seen; a group not seen at all is left as long as the sizes of the others don't make up the file.
        """
        if lo == hi:
            k = int(np.searchsorted(self.groups, lo))
            return k < len(self.groups) and self.groups[k] == lo and best < self.nth[k]
        if rows is None or self.size.sum() != rows:
            return False
        held = (self.groups >= lo) & (self.groups <= hi) & (self.seen < self.size)
        return bool((best < self.nth[held]).all())


def read_best(zoned: DataFrame, n: int, parts: int) -> DataFrame:
    """``grp, score, item``: at least the n best of each group of each file, read with skipping.

    ``zoned`` is :func:`zones` with ``floor``, a score that the n-th best of the only group of that row group is known to
    reach, or null. Also gives one row with a null group for each file: its score is the number of row groups skipped, its item that of those
    skipped that held several groups.
    """

    def read(batches):
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("file", pa.string()), ("rg", pa.int32()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("best", pa.float64()), ("floor", pa.float64())]))
        by_file: dict[str, list] = {}
        for r in t.to_pylist():
            by_file.setdefault(r["file"], []).append(r)
        for name, groups in by_file.items():
            f = _open(name)
            top, skipped, several, whole = Best(n), 0, 0, None
            for r in sorted(groups, key=lambda r: (-r["best"], r["rg"])):
                if (r["floor"] is not None and r["best"] < r["floor"]) or top.may_skip(r["lo"], r["hi"], r["best"], whole):
                    skipped += 1
                    several += r["lo"] != r["hi"]
                    continue
                part = f.read_row_group(r["rg"], columns=["grp", "score", "item", "size"])
                shared = part.column("size").null_count == 0
                whole = sum(x["n"] for x in groups) if shared else None
                top.add(*(part.column(c).to_numpy() for c in ("grp", "score", "item")), part.column("size").to_numpy() if shared else np.zeros(part.num_rows, "i8"))
            columns = (np.r_[top.grp, 0], np.r_[top.score, skipped].astype("f8"), np.r_[top.item, several])
            none = np.arange(len(columns[0])) == len(top.grp)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], mask=none), pa.array(columns[1]), pa.array(columns[2])], names=["grp", "score", "item"])

    # a file is read by one task: its row groups come in descending best score with the thresholds in memory
    return zoned.select("file", "rg", "n", "lo", "hi", "best", "floor").repartition(parts, "file").mapInArrow(read, "grp long, score double, item long")


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int, version: str | None = None) -> DataFrame:
    """``grp, item, score, rank``: the n items of each group with the highest scores, of equal scores the smaller item first.

    Group and item are integers, the score a number. An item counts once: with ``version`` by its latest row, else by its row
    of the greatest values. Items whose group is null or whose score is null or NaN don't count; -0.0 equals 0.0.
    Ties are never cut at random; an empty table gives no rows; other columns of the table are not read.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(group).cast("long").alias("_g"), F.col(item).cast("long").alias("_i"), F.col(score).cast("double").alias("_s"), (F.col(version) if version else F.lit(0)).alias("_v"))
    one = latest(rows, "_i", "_v", ["_g", "_s"]).select(F.col("k0").alias("grp"), (F.col("k1") + 0.0).alias("score"), "item")
    one = one.where("grp is not null and score is not null and not isnan(score)")
    path = cluster(one)
    files = list(spark.read.schema("grp long, score double, item long").option("recursiveFileLookup", True).parquet(path).inputFiles())
    zoned = zones(spark, files)
    # a row group of one group and at least n rows bounds that group's n-th score from below
    floors = zoned.where((F.col("lo") == F.col("hi")) & (F.col("n") >= n)).groupBy("lo").agg(F.max("worst").alias("floor"))
    zoned = zoned.join(floors, "lo", "left").withColumn("floor", F.when(F.col("lo") == F.col("hi"), F.col("floor")))
    best = read_best(zoned, n, max(1, len(files))).where("grp is not null")
    # at most n rows of a group come from each of its files
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select("grp", "item", "score", "rank")
