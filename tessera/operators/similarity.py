"""Pairs, centroids, nearest neighbours and silhouettes over vectors.

Vectors are ``array<float|double>`` of one length. Rows with a null vector or id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import element_means, l2_normalize
from tessera.operators.blocks import matrix, table_of, unit
from tessera.storage import materialize

#: Rows of a tile side when a group is compared with itself.
TILE_ROWS = 2048
#: Vectors that are broadcast at once for the nearest of them: 16,384 of 768 dimensions in float64 are 100 MB.
BROADCAST_ROWS = 16_384


def mixed_vectors(unmasked: DataFrame, masked: DataFrame, alpha: float | str, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """``key, vector``: the weighted, normalised sum of both vectors of a key; keys that lack one are left out."""
    from tessera.functions.vectors import mix

    b = masked.select(key, F.col(embedding).alias("_m"))
    return unmasked.join(b, key).select(key, mix(embedding, "_m", alpha).alias("vector"))


def blended_vectors(first: DataFrame, second: DataFrame, alpha: float | str, key: str = "key", embedding: str = "embedding") -> DataFrame:
    """``key, vector``: ``1 - alpha`` parts of the first and ``alpha`` of the second vector, not normalised."""
    from tessera.functions.vectors import blend

    b = second.select(key, F.col(embedding).alias("_m"))
    return first.join(b, key).select(key, blend(embedding, "_m", alpha).alias("vector"))


def similar_pairs(rows: DataFrame, group: str, key: str, vector: str, min_similarity: float, parts: int | None = None, knn: int | None = None, farthest: int | None = None) -> DataFrame:
    """``grp, a, b, cosine`` with a < b: all pairs of a group at least that similar; with ``knn`` only those to the ``knn`` most similar rows of either end.

    A group is cut into chunks, and each pair of chunks is a tile compared as one matrix product, so a large group is many tasks.
    Only pairs at or above the limit leave a task, with ``knn`` only the most similar of each row in the tile; of equally similar rows the smaller
    keys count. With ``farthest`` only so many least similar pairs leave each tile. A null group pairs with nothing.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col(group).cast("string").alias("grp"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("grp is not null and k is not null and v is not null")
    chunks = rows.groupBy("grp").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("of"))
    # the chunk counts are one row for each group; the vectors are joined to them on the group, split by AQE where one is large
    cut = rows.join(chunks, "grp").withColumn("c", F.pmod(F.xxhash64("k"), "of").cast("int"))
    tiles = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).select("grp", "k", "v", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        t = table_of(batches)
        if t is None:
            return
        order = pa.compute.sort_indices(t, [("grp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("c", "ascending")])
        t = t.select(["grp", "i", "j", "c", "k", "v"]).take(order)
        i, j, c = (t.column(x).to_numpy() for x in ("i", "j", "c"))
        g = t.column("grp").combine_chunks().dictionary_encode()
        g = (g.chunk(0) if isinstance(g, pa.ChunkedArray) else g).indices.to_numpy()
        keys, names = t.column("k").to_numpy(), t.column("grp")
        x = unit(matrix(t.column("v")))
        start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        for s, e in zip(start, np.r_[start[1:], len(g)]):
            m = s + int((c[s:e] == i[s]).sum())
            lo, hi = (slice(s, e), slice(s, e)) if i[s] == j[s] else (slice(s, m), slice(m, e))
            sims = x[lo] @ x[hi].T
            keep = sims >= min_similarity
            if knn is not None:
                keep &= _nearest_of_tile(sims, keys[lo], keys[hi], knn)
            a, b = np.nonzero(keep)
            ka, kb, w = keys[lo][a], keys[hi][b], sims[a, b]
            keep = ka < kb if i[s] == j[s] else ka != kb
            ka, kb, w = ka[keep], kb[keep], w[keep]
            if farthest is not None and len(w) > farthest:
                least = np.argpartition(w, farthest - 1)[:farthest]
                ka, kb, w = ka[least], kb[least], w[least]
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array([names[int(s)].as_py()] * len(w)), pa.array(np.minimum(ka, kb)), pa.array(np.maximum(ka, kb)), pa.array(w)], names=["grp", "a", "b", "cosine"])

    pairs = tiles.repartition(parts, "grp", "i", "j").mapInArrow(run, f"grp string, a {kind}, b {kind}, cosine double")
    if knn is None:
        return pairs
    pairs = materialize(pairs, "near")
    ends = pairs.select("*", F.col("a").alias("k"), F.col("b").alias("o")).union(pairs.select("*", F.col("b").alias("k"), F.col("a").alias("o")))
    rank = F.row_number().over(Window.partitionBy("grp", "k").orderBy(F.desc("cosine"), "o"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= knn).select("grp", "a", "b", "cosine").distinct()


def _nearest_of_tile(sims: np.ndarray, ka: np.ndarray, kb: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` greatest of their row or of their column, an entry of a key with itself left out; of equal ones the smaller keys."""
    sims = np.where(ka[:, None] == kb[None, :], -np.inf, sims)
    keep = np.zeros(sims.shape, bool)
    for m, at, out in ((sims, np.argsort(kb, kind="stable"), keep), (sims.T, np.argsort(ka, kind="stable"), keep.T)):
        near = at[np.argsort(-m[:, at], axis=1, kind="stable")[:, :k]]
        out[np.arange(len(m))[:, None], near] = True
    return keep


def centroids(rows: DataFrame, group: list[str], vector: str, dim: int, normalise: bool = True) -> DataFrame:
    """Group columns, ``embedding`` (the mean vector, at unit length) and ``numaveraged``."""
    mean = rows.where(F.col(vector).isNotNull()).groupBy(*group).agg(element_means(vector, dim).alias("embedding"), F.count("*").alias("numaveraged"))
    return mean.withColumn("embedding", l2_normalize("embedding")) if normalise else mean


def nearest(queries: DataFrame, targets: DataFrame, query_id: str, target_id: str, query_vector: str, target_vector: str) -> DataFrame:
    """``query_id, target_id, cosine``: the most similar target of every query, of equal ones the smaller id.

    Up to ``BROADCAST_ROWS`` targets are broadcast. More of them are divided into blocks of that many, and the queries into chunks; every chunk meets
    every block in a task, and the best of all blocks wins. Ids of targets are integers. Zero vectors have a cosine of 0 with everything.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("q is not null and v is not null")
    t = targets.select(F.col(target_id).cast("long").alias("t"), F.col(target_vector).cast("array<double>").alias("v")).where("t is not null and v is not null")
    kind = q.schema["q"].dataType.simpleString()

    def best(asked: pa.Array, x: np.ndarray, ids: np.ndarray, y: np.ndarray):
        sims = np.round(x @ y.T, 12)  # equal to 12 digits is equal: argmax takes the first, the smaller id
        at = sims.argmax(1)
        return pa.RecordBatch.from_arrays([asked, pa.array(ids[at]), pa.array(sims[np.arange(len(at)), at])], names=["q", "t", "cosine"])

    found = _blockwise(q, t, "t", best, f"q {kind}, t long, cosine double")
    top = found.groupBy("q").agg(F.max_by(F.struct("t", "cosine"), F.struct("cosine", -F.col("t"))).alias("b"))
    return top.select(F.col("q").alias(query_id), F.col("b.t").alias(target_id), F.col("b.cosine").alias("cosine"))


def _blockwise(q: DataFrame, t: DataFrame, key: str, f, schema: str, scale: bool = True) -> DataFrame:
    """``f(first column, unit vectors; keys, unit vectors)`` for every chunk of ``q`` (its last column is the vector) and every block of ``t`` (``key``, ``v``), keys in order.

    Without ``scale`` the vectors of ``t`` are passed as they are. One block is broadcast, with its size checked; of several every task gets one, together with a chunk of the rows.
    """
    n, of = t.count(), unit if scale else (lambda x: x)
    if n <= BROADCAST_ROWS:
        held = t.select(key, "v").toArrow().sort_by(key)
        ids, y = held.column(key).to_numpy(), of(matrix(held.column("v")))

        def broadcast(batches):
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, TILE_ROWS):
                    part = batch.slice(at, TILE_ROWS)
                    yield f(*part.columns[:-1], unit(matrix(part.column(part.num_columns - 1))), ids, y)

        return q.mapInArrow(broadcast, schema)
    blocks, chunks = -(-n // BROADCAST_ROWS), max(1, -(-q.count() // (4 * BROADCAST_ROWS)))
    width = len(q.columns) - 1
    named = [F.col(c).alias(f"_{i}") for i, c in enumerate(q.columns[:-1])]
    chunk, block = F.pmod(F.xxhash64(F.lit(3), q.columns[0]), F.lit(chunks)), F.pmod(F.xxhash64(F.lit(5), key), F.lit(blocks))
    rows = q.select(*named, F.lit(None).cast(t.schema[key].dataType).alias("_t"), F.col("v"), chunk.alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    nulls = [F.lit(None).cast(q.schema[c].dataType) for c in q.columns[:-1]]
    both = rows.union(t.select(*nulls, F.col(key), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))), block))

    def tiles(batches):
        held = table_of(batches)
        if held is None:
            return
        held = held.sort_by([("_c", "ascending"), ("_b", "ascending"), ("_t", "ascending")])
        c, b = held.column("_c").to_numpy(), held.column("_b").to_numpy()
        start = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])])
        for s, e in zip(start, np.r_[start[1:], len(c)]):
            part = held.slice(s, e - s).combine_chunks()
            is_target = pa.compute.is_valid(part.column("_t"))
            ts, qs = part.filter(is_target), part.filter(pa.compute.invert(is_target))
            if not ts.num_rows:
                continue
            ids, y = ts.column("_t").to_numpy(), of(matrix(ts.column("v")))
            for at in range(0, qs.num_rows, TILE_ROWS):
                few = qs.slice(at, TILE_ROWS).combine_chunks()
                yield f(*[few.column(i).chunk(0) for i in range(width)], unit(matrix(few.column("v"))), ids, y)

    return both.repartition(blocks * chunks, "_c", "_b").mapInArrow(tiles, schema)


def silhouettes(rows: DataFrame, key: str, cluster: str, vector: str, dim: int, group: str | None = None) -> DataFrame:
    """``key, cluster, silhouette``: cosine silhouette of every row among the clusters of its group, without forming pairs.

    The mean cosine distance of a unit vector to a cluster is 1 minus its product with the cluster's mean, so each row meets each cluster of its
    group once: by a join with the group's few clusters, or without a group block by block. Rows alone in their cluster, and all rows of a group
    of one cluster or of as many clusters as rows, have 0.
    """
    base = rows.select(F.col(key).alias("k"), F.col(cluster).alias("c"), (F.col(group) if group else F.lit(0)).alias("g"), l2_normalize(vector).alias("v")).where("k is not null and c is not null and v is not null")
    means = base.groupBy("g", "c").agg(element_means("v", dim).alias("m"), F.count("*").alias("n"))
    sizes = means.groupBy("g").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"))
    if group:
        others = means.select("g", F.col("c").alias("oc"), "m", "n")
        far = 1 - F.aggregate(F.zip_with("v", "m", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        met = base.join(others, "g").select("g", "k", "c", "oc", "n", far.alias("d"))
        own = F.max(F.when((F.col("oc") == F.col("c")) & (F.col("n") > 1), F.col("d") * F.col("n") / (F.col("n") - 1)))
        ab = met.groupBy("g", "k", "c").agg(own.alias("a"), F.min(F.when(F.col("oc") != F.col("c"), F.col("d"))).alias("b"))
    else:
        ab = _silhouette_parts(base, materialize(means, "means"))
    s = F.when((F.col("clusters") > 1) & (F.col("clusters") < F.col("members")) & F.col("a").isNotNull(), F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return ab.join(F.broadcast(sizes) if not group else sizes, "g").select(F.col("k").alias(key), F.col("c").alias(cluster), F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def _silhouette_parts(base: DataFrame, means: DataFrame) -> DataFrame:
    """``g, k, c, a, b``: mean distance to the own cluster and to the nearest other one, over blocks of means."""
    # a mean comes with its size as one more entry; clusters are told apart by a number
    numbered = means.select(F.xxhash64("c").alias("h"), F.concat(F.col("m"), F.array(F.col("n").cast("double"))).alias("v"))
    q = base.select("k", "c", F.xxhash64("c").alias("h"), "v")
    kinds = {c: base.schema[c].dataType.simpleString() for c in ("k", "c")}

    def parts(k: pa.Array, c: pa.Array, h: pa.Array, x: np.ndarray, ids: np.ndarray, raw: np.ndarray):
        n, m = raw[:, -1], raw[:, :-1]
        far = 1 - x @ m.T
        h = h.to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, h).clip(0, len(ids) - 1)
        here = ids[at] == h
        rows = np.arange(len(h))
        a = np.where(here & (n[at] > 1), far[rows, at] * n[at] / np.maximum(n[at] - 1, 1), np.nan)
        far[rows[here], at[here]] = np.inf
        b = far.min(1)
        return pa.RecordBatch.from_arrays([k, c, pa.array(a, mask=np.isnan(a)), pa.array(b, mask=np.isinf(b))], names=["k", "c", "a", "b"])

    met = _blockwise(q, numbered, "h", parts, f"k {kinds['k']}, c {kinds['c']}, a double, b double", scale=False)
    return met.groupBy("k", "c").agg(F.max("a").alias("a"), F.min("b").alias("b")).select(F.lit(0).alias("g"), "k", "c", "a", "b")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the hash of their key and the seed: the same rows however the table is partitioned."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def group_sample(rows: DataFrame, group: str, key: str, n: int, labelled: str | None = None, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group by that hash, rows with a label other than ``<unk>`` first."""
    from pyspark.sql import Window

    last = (F.coalesce(F.col(labelled), F.lit("<unk>")) == "<unk>") if labelled else F.lit(False)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(last, F.xxhash64(F.lit(seed), key), key))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def sampled_silhouettes(rows: DataFrame, key: str, cluster: str, vector: str, dim: int, n: int = 1000, draws: int = 3) -> DataFrame:
    """``draw, n, mean``: the mean silhouette of several samples of ``n`` rows, each drawn by the hash of its number."""
    out = None
    for d in range(draws):
        part = silhouettes(sample(rows.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()), key, n, d), key, cluster, vector, dim)
        one = part.agg(F.count("*").alias("n"), F.avg("silhouette").alias("mean")).select(F.lit(d).alias("draw"), "n", "mean")
        out = one if out is None else out.union(one)
    return out


def kth_largest_distance(rows: DataFrame, key: str, vector: str, k: int, margin: float = 1e-6) -> DataFrame:
    """``threshold``: the k-th largest cosine distance of all pairs, a little enlarged; null where there are fewer pairs. For tables of clusters."""
    pairs = similar_pairs(rows.withColumn("_all", F.lit("all")), "_all", key, vector, -2.0, farthest=k)
    top = pairs.select((1 - F.col("cosine")).alias("d")).orderBy(F.desc("d")).limit(k)
    return top.agg(F.count("*").alias("n"), F.min("d").alias("d")).select(F.when(F.col("n") == k, F.col("d") + margin).alias("threshold"))
