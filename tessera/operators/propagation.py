"""Chinese Whispers across the cluster: label propagation over an edge table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


def propagate_labels(nodes: DataFrame, edges: DataFrame, max_iter: int = 100, weighted: bool = False, seed: int = 0) -> DataFrame:
    """``node, label`` from ``node, fixed`` and undirected edges ``a, b, w``.

    A node with a fixed label keeps it; the others start under their own name. A round visits every free node once, in two halves chosen by a hash of
    node, round and seed: each takes the label of most neighbours (``weighted``: of the greatest summed weight), of equal ones its own if it is among
    them, else a fixed one, else that of the smallest node; so two neighbours that would swap labels for ever don't. It ends when a round changes
    nothing; if that is not so after ``max_iter`` rounds, a warning says how many nodes the last one moved.
    A node without edges keeps its own label. Each half is one join of edges with labels and is written to a table.
    """
    free = F.col("fixed").isNull()
    # root: the node that a free label is named after
    state = nodes.select("node", "fixed", F.coalesce(F.col("fixed").cast("string"), F.concat(F.lit("#"), F.col("node").cast("string"))).alias("label"), F.when(free, F.col("node")).alias("root"))
    state = materialize(state, "labels")
    edges = edges.where("a <> b").select("a", "b", (F.col("w") if weighted else F.lit(1.0)).alias("w"))
    both = materialize(edges.union(edges.select("b", "a", "w")).toDF("to", "from", "w"), "edges")
    for turn in range(max_iter):
        n_moved = 0
        for half in range(2):
            votes = both.join(state.select(F.col("node").alias("from"), "label", "root"), "from").groupBy("to", "label", "root").agg(F.round(F.sum("w"), 9).alias("w"))
            own = state.where(free).select(F.col("node").alias("to"), F.col("label").alias("own"))
            own = own.where(F.pmod(F.xxhash64(F.lit(seed + turn), "to"), F.lit(2)) == half)
            order = F.struct(-F.col("w"), F.col("root").isNotNull(), F.col("root"), F.col("label"))
            best = votes.join(own, "to").groupBy("to", "own").agg(F.max("w").alias("top"), F.max(F.when(F.col("label") == F.col("own"), F.col("w"))).alias("mine"), F.min_by(F.struct("label", "root"), order).alias("new"))
            moved = best.where(F.col("mine").isNull() | (F.col("mine") < F.col("top"))).select(F.col("to").alias("node"), "new")
            changed = F.col("new").isNotNull()
            joined = state.join(moved, "node", "left").select("node", "fixed", F.when(changed, F.col("new.label")).otherwise(F.col("label")).alias("label"), F.when(changed, F.col("new.root")).otherwise(F.col("root")).alias("root"), changed.alias("changed"))
            new = materialize(joined, "labels")
            n_moved += new.where("changed").count()
            state = new.drop("changed")
        if not n_moved:
            break
    else:
        warnings.warn(f"labels have not settled: {n_moved} nodes moved in the last of {max_iter} rounds", RuntimeWarning, stacklevel=2)
    return state.select("node", "label")
