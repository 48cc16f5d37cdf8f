"""Most similar vectors for every vector.

Method: inverted lists with an adaptive dimension scan. Vectors are rotated, their dimensions
taken in blocks, and within each probed list a candidate is abandoned by a hypothesis test on
its partial distance (see ``_ivf``). Exact copies of a vector are collapsed before the search
and put back after it, so a group of copies costs its size and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _ivf
from tessera.storage import materialize


#: Lists probed for pairs at a cosine of 0.9 or more: those within the margin of the nearest. Of 133,525 such pairs of 318,402 vectors in 622 lists they hold
#: 0.99998, as 8 probes within 0.15 do, which reach 5.0 lists a vector instead of 3.5 (tests/llm measures the recall on smaller tables).
CLOSE_PROBES, CLOSE_MARGIN = 12, 0.1


def collapse_copies(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``rep, vec, copies``; ``rep, key``): different vectors under their smallest key, and whose vector is which."""
    # written, since it is read twice
    marked = materialize(usable.withColumn("h", F.md5("vec")), "usable")
    reps = materialize(marked.groupBy("h").agg(F.min("key").alias("rep"), F.first("vec").alias("vec"), F.count("*").alias("copies")), "vectors")
    shared = reps.where("copies > 1").select("h", "rep")
    members = marked.select("h", "key").join(shared, "h").select("rep", "key").union(reps.where("copies = 1").select("rep", F.col("rep").alias("key")))
    return reps.drop("h"), members


def _first_k(row: np.ndarray, cos9: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (greater cosine, then smaller id) of each row."""
    order = np.lexsort((other, -cos9, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[place < k]


def _search(placed: DataFrame, rotation: np.ndarray, k: int, min_similarity: float, confidence: float) -> DataFrame:
    """``rep, other, cos9``: the k best of each vector within each group."""

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        scan = _ivf.Scan(batches, rotation)
        limit = np.full(scan.n, 2 - 2 * (min_similarity - 1e-9))
        best = np.full((scan.n, k), -2.0)
        found: list[tuple] = []
        held = 0
        for i, j, cos in scan.pairs(limit, confidence):
            if not len(i):
                continue
            cos9 = np.round(cos, 9)
            keep = _first_k(i, cos9, scan.rep[j], k)
            i, j, cos9 = i[keep], j[keep], cos9[keep]
            found.append((i, j, cos9))
            held += len(i)
            rows, first, runs = np.unique(i, return_index=True, return_counts=True)
            new = np.full((len(rows), k), -2.0)
            new[np.repeat(np.arange(len(rows)), runs), _ivf.grown(runs)] = cos9
            best[rows] = -np.sort(-np.concatenate([best[rows], new], axis=1), axis=1)[:, :k]
            limit[rows] = np.minimum(limit[rows], np.where(best[rows, -1] > -2, 2 - 2 * best[rows, -1] + 2e-9, 9.0))
            if held > 64 * scan.n + 1_000_000:
                found, held = [_cut(found, scan.rep, k)], scan.n * k
        if found:
            i, j, cos9 = _cut(found, scan.rep, k)
            yield pa.RecordBatch.from_arrays([pa.array(scan.rep[i]), pa.array(scan.rep[j]), pa.array(cos9)], names=["rep", "other", "cos9"])

    return placed.mapInArrow(run, "rep long, other long, cos9 double")


def _cut(found: list[tuple], rep: np.ndarray, k: int) -> tuple:
    i, j, cos9 = (np.concatenate(x) for x in zip(*found))
    keep = _first_k(i, cos9, rep[j], k)
    return i[keep], j[keep], cos9[keep]


def nearest(
    usable: DataFrame,
    k: int = 5,
    min_similarity: float = -1.0,
    dim: int = 64,
    probes: int | None = _ivf.PROBES,
    margin: float = _ivf.MARGIN,
    confidence: float = _ivf.CONFIDENCE,
    every: int | None = None,
) -> DataFrame:
    """``key, neighbour, similarity, rank``: the k most similar vectors of other keys, for every key.

    ``usable`` is ``key, vec`` as :func:`_ivf.usable_vectors` gives it. The cosine is taken in double
    precision and rounded to 9 digits; of equal ones the smaller key comes first, at rank 1 to k.
    With ``min_similarity`` only neighbours at least that similar come out, and the search abandons
    all others early. Without a number of ``probes`` every list is searched. ``every``: only keys divisible by it are queries, against all rows.

    An empty table gives no rows; a collection of fewer than k + 1 vectors gives all there are.
    """
    spark = usable.sparkSession
    reps, members = collapse_copies(usable)
    members = materialize(members, "members")
    rows = reps.count()
    if every:
        asking = members.where(F.col("key") % every == 0).select("rep").distinct()
        reps_asked = reps.join(asking.withColumn("asks", F.lit(True)), "rep", "left").select("rep", "vec", F.coalesce("asks", F.lit(False)).alias("asks"))
    quantiser = _ivf.fit(reps, rows, dim)
    probes = len(quantiser.centroids) if probes is None else probes
    if every:
        # members that don't search are placed at home only
        placed = _ivf.place(reps_asked.where("asks"), quantiser, probes, margin)
        rest = _ivf.place(reps_asked.where("not asks"), quantiser, 1, 0.0, where=lambda r: np.zeros(len(r), bool))
        placed = placed.union(rest).repartitionById(quantiser.groups, "grp")
    else:
        placed = _ivf.place(reps, quantiser, probes, margin)
    near = _search(placed, quantiser.rotation, k + 1, min_similarity, confidence)
    by_rep = Window.partitionBy("rep").orderBy(F.desc("cos9"), "other")
    near = near.withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= k + 1).drop("n")
    # the copies of a vector are its neighbours too, at a cosine of 1
    twins = reps.where("copies > 1").select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cos9"))
    first_keys = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("other"), F.col("key").alias("neighbour"))
    by_key = Window.partitionBy("rep").orderBy(F.desc("cos9"), "neighbour")
    best = near.union(twins).join(first_keys, "other").withColumn("n", F.row_number().over(by_key)).where(F.col("n") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "neighbour", "cos9"))).alias("best"))
    asked = members.where(F.col("key") % every == 0) if every else members
    out = asked.join(lists, "rep").select("key", F.explode(F.slice(F.filter("best", lambda b: b["neighbour"] != F.col("key")), 1, k)).alias("b"), "best")
    own = F.array_position(F.transform("best", lambda b: b["neighbour"]), F.col("key"))
    rank = F.col("b.n") - F.when((own > 0) & (own < F.col("b.n")), 1).otherwise(0)
    return out.select("key", F.col("b.neighbour").alias("neighbour"), F.col("b.cos9").alias("similarity"), rank.cast("int").alias("rank"))


def close_neighbour_pairs(vectors: DataFrame, k: int = 5, min_similarity: float = 0.9, **options) -> DataFrame:
    """``key_a, key_b``: pairs at least ``min_similarity`` alike of which one is among the other's k nearest."""
    near = nearest(_ivf.usable_vectors(vectors), k, min_similarity, **({"probes": CLOSE_PROBES, "margin": CLOSE_MARGIN} | options))
    return near.where(F.col("similarity") >= min_similarity).select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
