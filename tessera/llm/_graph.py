"""Spanning forests: in one task's memory with numpy, and across the cluster by Borůvka's rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import table_of
from tessera.storage import materialize


#: Edges that one task finishes; of more, rounds across the cluster leave fewer.
TASK_EDGES = 1_000_000


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges in their order, best first: positions of those in the spanning forest, the nodes, and the smallest node each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    n, edge, taken = len(nodes), np.arange(len(a)), [np.zeros(0, int)]
    comp = np.arange(n)
    while len(edge):
        best = np.full(n, len(a))
        ca, cb = comp[a[edge]], comp[b[edge]]
        np.minimum.at(best, ca, edge)
        np.minimum.at(best, cb, edge)
        has = np.flatnonzero(best < len(a))
        chosen = best[has]
        taken.append(np.unique(chosen))
        parent = np.arange(n)
        parent[has] = np.where(comp[a[chosen]] == has, comp[b[chosen]], comp[a[chosen]])
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]
        edge = edge[comp[a[edge]] != comp[b[edge]]]
    first = np.full(n, n)
    np.minimum.at(first, comp, np.arange(n))
    return np.unique(np.concatenate(taken)), nodes, nodes[first[comp]] if n else nodes


def spanning_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of the maximum spanning forest; equal weights are ordered by their ends."""
    lo, hi = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((hi, lo, -w))
    return order[_merge(lo[order], hi[order])[0]]


def _finish(batches):
    """The rest of the forest (kind 0) and the component of each node (kind 1) from all edges that are left."""
    t = table_of(batches)
    if t is None:
        return
    u, v, w, cu, cv = (t.column(c).to_numpy() for c in ("u", "v", "w", "cu", "cv"))
    order = np.lexsort((v, u, -w))
    taken, nodes, comp = _merge(cu[order], cv[order])
    at = order[taken]
    for kind, a, b, x in ((0, u[at], v[at], w[at]), (1, nodes, comp, np.zeros(len(nodes)))):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, "i4")), pa.array(a), pa.array(b), pa.array(x)], names=["kind", "a", "b", "w"])


def _relabel(edges: DataFrame, parents: DataFrame) -> DataFrame:
    for end in ("cu", "cv"):
        edges = edges.join(parents.select(F.col("c").alias(end), F.col("parent").alias("_p")), end).withColumn(end, F.col("_p")).drop("_p")
    return edges.where("cu != cv")


def boruvka(edges: DataFrame, jumps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(``u, v, w``: the maximum spanning forest; ``node, comp``: the component of every node that has an edge).

    ``edges`` is ``u, v, w`` with long ends and double weights, greater is better; parallel and repeated
    edges are allowed. In each round every component takes its best edge (of equal weights that with the
    smaller ends), hooks onto the component at its other end, and pointers are halved ``jumps`` times; a
    component not yet at its root after that merges in a later round. Rounds are logarithmic in the size of
    the largest component; each is written to a table. What is left is finished in one task as soon as it is no more than ``TASK_EDGES``
    edges; the forest is the same. A component is called by its smallest node.
    """
    edges = edges.where("u != v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))
    left = materialize(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "edges")
    forest = nodes = None
    while (n := left.count()) > TASK_EDGES:
        if nodes is None:
            nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("comp", F.col("node"))
        both = left.select("u", "v", "w", F.col("cu").alias("c"), F.col("cv").alias("o")).union(left.select("u", "v", "w", "cv", "cu"))
        best = both.groupBy("c").agg(F.max_by(F.struct("o", "u", "v", "w"), F.struct("w", -F.col("u"), -F.col("v"))).alias("b"))
        best = materialize(best.select("c", "b.*"), "best")
        back = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        parents = best.join(back, "o").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("parent"))
        for _ in range(jumps):
            up = parents.select(F.col("c").alias("parent"), F.col("parent").alias("grand"))
            parents = parents.join(up, "parent").select("c", F.col("grand").alias("parent"))
        parents = materialize(parents, "parents")
        taken = best.select("u", "v", "w").distinct()
        forest = taken if forest is None else forest.union(taken)
        left = materialize(_relabel(left, parents), "edges")
        nodes = materialize(nodes.join(parents, nodes.comp == parents.c, "left").select("node", F.coalesce("parent", "comp").alias("comp")), "nodes")
    if n or nodes is None:
        rest = materialize(left.repartition(1).mapInArrow(_finish, "kind int, a long, b long, w double"), "forest")
        taken = rest.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
        forest = taken if forest is None else forest.union(taken)
        parents = rest.where("kind = 1").select(F.col("a").alias("c"), F.col("b").alias("parent"))
        if nodes is None:
            return forest, parents.select(F.col("c").alias("node"), F.col("parent").alias("comp"))
        nodes = nodes.join(parents, nodes.comp == parents.c, "left").select("node", F.coalesce("parent", "comp").alias("comp"))
    nodes = materialize(nodes, "nodes")
    first = nodes.groupBy("comp").agg(F.min("node").alias("first"))
    return forest.distinct(), nodes.join(first, "comp").select("node", F.col("first").alias("comp"))
