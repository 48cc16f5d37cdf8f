"""Grouping records into clusters of mutually similar records.

Method: hierarchical density clustering. Close pairs within each group come from inverted lists
(``_ivf``); their mutual-reachability graph is reduced to a spanning forest in each task, the
forests are merged by distributed Borůvka rounds, and each tree is condensed into a hierarchy from
which the clusters of greatest stability are selected. Exact copies are one weighted node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.llm import _graph, _ivf
from tessera.storage import materialize

#: A group of more vectors is divided among inverted lists; smaller ones are one list, all against all.
WHOLE_ROWS = 4096
#: At most so many groups are listed as large, so that the list is at most 8 MB.
MAX_LARGE = 1_000_000
#: Edges of one tree that a task condenses; a larger tree is divided, with the same result.
TASK_EDGES = 1_000_000
#: Members of one block when a cluster is checked pair by pair.
CHECK_ROWS = 2048
NEAREST = 1e-6


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``grp, key, vec``: (``grp, rep, vec, copies``; ``rep, key``) with equal vectors of a group under their smallest key."""
    # written, since it is read twice
    marked = materialize(rows.withColumn("h", F.md5("vec")), "usable")
    reps = materialize(marked.groupBy("grp", "h").agg(F.min("key").alias("rep"), F.first("vec").alias("vec"), F.count("*").alias("copies")), "vectors")
    shared = reps.where("copies > 1").select("grp", "h", "rep")
    members = marked.select("grp", "h", "key").join(shared, ["grp", "h"]).select("rep", "key").union(reps.where("copies = 1").select("rep", F.col("rep").alias("key")))
    return reps.drop("h"), members


def _mix(grp: np.ndarray, lst: np.ndarray) -> np.ndarray:
    mixed = (grp.astype("u8") ^ ((lst.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1)).astype("i8")


def _place(reps: DataFrame, large: np.ndarray, quantiser: _ivf.Quantiser, parts: int, probes: int, margin: float) -> DataFrame:
    """``part, home, probes, rep, grp, vec, copies, core`` as :func:`_ivf.place` has it, with lists of their own for every group."""
    names = ["part", "home", "probes", "rep", "grp", "vec", "copies", "core"]

    def rows(part, home, asked, batch, at):
        one = asked if isinstance(asked, pa.Array) else pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1), pa.int32()), pa.array(asked))
        at = pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), pa.array(home), one, *(batch.column(c).take(at) for c in names[3:])], names=names)

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy()
            is_large = np.isin(grp, large)
            small = np.flatnonzero(~is_large)
            if len(small):
                lst = _mix(grp[small], np.full(len(small), -1))
                yield rows(lst % parts, lst, lst, batch, small)
            big = np.flatnonzero(is_large)
            for at in range(0, len(big), 4096):
                here = big[at : at + 4096]
                x = _ivf.unit(_ivf.matrix(batch.column("vec").take(pa.array(here))))
                home, lists = quantiser.probe(x, probes, margin)
                row, _ = np.nonzero(lists >= 0)
                row, lst = np.concatenate([row, np.arange(len(here))]), np.concatenate([lists[lists >= 0], home])
                own = np.arange(len(row)) >= len(row) - len(here)
                part = _mix(grp[here][row], quantiser.group[lst] + 100_000_000) % parts
                lst = _mix(grp[here][row], lst)
                order = np.lexsort((own, part, row))
                row, lst, own, part = row[order], lst[order], own[order], part[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]
                first, of = np.flatnonzero(new), np.cumsum(new) - 1
                homes = np.full(len(first), -1, "i8")
                homes[of[own]] = lst[own]
                counts = np.bincount(of[~own], minlength=len(first))
                asked = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(lst[~own]))
                yield rows(part[first], homes, asked, batch, here[row[first]])

    return reps.select("grp", "rep", "vec", "copies", "core").mapInArrow(send, "part int, home long, probes array<long>, rep long, grp long, vec binary, copies long, core double").repartitionById(parts, "part")


def _edges(placed: DataFrame, rotation: np.ndarray, min_similarity: float) -> DataFrame:
    """``kind, a, b, w``: kind 0 the spanning forest of each task's mutual-reachability edges, kind 1 the links of a vector."""

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        scan = _ivf.Scan(batches, rotation)
        core = scan.table.column("core").to_numpy()
        limit = np.full(scan.n, 2 - 2 * min_similarity)
        links = np.zeros(scan.n, "i8")
        kept = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        held = base = 0
        for i, j, cos in scan.pairs(limit):
            links += np.bincount(i, minlength=scan.n)
            w = np.minimum(cos, np.minimum(core[i], core[j]))
            kept.append((scan.rep[i], scan.rep[j], w))
            held += len(i)
            if held > 2_000_000 + 2 * base:
                kept, held = [_cut(kept, min_similarity)], 0
                base = len(kept[0][0])
        u, v, w = _cut(kept, min_similarity)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), "i4")), pa.array(u), pa.array(v), pa.array(w)], names=["kind", "a", "b", "w"])
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), "i4")), pa.array(scan.rep[some]), pa.array(links[some]), pa.array(np.zeros(len(some)))], names=["kind", "a", "b", "w"])

    return placed.mapInArrow(run, "kind int, a long, b long, w double")


def _cut(kept: list[tuple], min_similarity: float) -> tuple:
    u, v, w = (np.concatenate(x) for x in zip(*kept))
    good = w >= min_similarity
    u, v, w = u[good], v[good], w[good]
    keep = _graph.spanning_forest(u, v, w)
    return u[keep], v[keep], w[keep]


def _core(placed: DataFrame, rotation: np.ndarray, min_similarity: float, min_samples: int) -> DataFrame:
    """``grp, rep, vec, copies, core`` of the vectors that are in a close pair: only they can be in an edge.

    Core is the similarity to the ``min_samples``-th nearest, itself and copies counted; -1 if there are fewer within reach. A task gives
    for each vector its nearest in that task; the vectors come along, so they need not be joined again.
    """
    names = ["rep", "grp", "vec", "copies", "cos", "n"]

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        scan = _ivf.Scan(batches, rotation)
        copies = scan.table.column("copies").to_numpy()
        limit = np.full(scan.n, 2 - 2 * min_similarity)
        k = min_samples - 1
        kept = [(np.zeros(0, int), np.zeros(0), np.zeros(0, "i8"))]
        linked = np.zeros(scan.n, bool)
        for i, j, cos in scan.pairs(limit):
            linked[i] = linked[j] = True
            best = _top(i, cos, k)
            kept.append((i[best], cos[best], copies[j[best]]))
        i, cos, n = (np.concatenate(x) for x in zip(*kept))
        best = _top(i, cos, k)
        i, cos, n = i[best], cos[best], n[best]
        some = np.flatnonzero(linked)
        runs = np.bincount(i, minlength=scan.n)[some]
        at = pa.array(np.r_[0, np.cumsum(runs)], pa.int32())
        rows = scan.table.select(names[:4]).take(pa.array(some)).combine_chunks()
        cols = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in names[:4]]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at, pa.array(cos)), pa.ListArray.from_arrays(at, pa.array(n))], names=names)

    near = placed.mapInArrow(run, "rep long, grp long, vec binary, copies long, cos array<double>, n array<long>")
    # of each vector a task gives at most min_samples - 1 neighbours, and few tasks see it: the lists are short
    lists = near.groupBy("rep").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.first("copies").alias("copies"), F.reverse(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("cos", "n"))))).alias("near"))
    walk = F.aggregate(
        "near",
        F.struct(F.col("copies").alias("seen"), F.lit(-1.0).alias("core")),
        lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when((s["seen"] < min_samples) & (s["seen"] + x["n"] >= min_samples), x["cos"]).otherwise(s["core"]).alias("core")),
    )
    return lists.select("grp", "rep", "vec", "copies", F.when(F.col("copies") >= min_samples, 1.0).otherwise(walk["core"]).alias("core"))


def _top(i: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest of each i, by i."""
    order = np.lexsort((-cos, i))
    r = i[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    return order[np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)])) < k]


def condense(size: list, alive: list, inner: list, forced: list, a: list, b: list, dens: list, min_size: float, epsilon: float):
    """The condensed hierarchy of one tree, the birth of its root left open (0).

    Leaves are records with copies, or parts of the tree that were condensed before: of each its ``size`` in records, ``alive`` the sum of the
    densities at which its records leave the cluster that holds them all, ``inner`` the stability of the best clusters within it (None:
    there are none), ``forced`` whether those give way to it. Edges ``a, b`` come in descending density ``dens``.

    Density is the inverse of the distance 1 - w. A leaf leaves the cluster it is in at the density at which its part falls under ``min_size``
    records. Stability sums, over a cluster's records, the density at which they leave less that at which it began; from the leaves up, a
    cluster is preferred to its parts where it is at least as stable as they together, and parts that begin at a distance below
    ``epsilon`` give way to the cluster that holds them.

    Of every leaf: its cluster, the density at which it left, whether it is still whole then, and the selected cluster (-1: none below the root); of every
    cluster: birth and stability; of the root: stability from 0 on, that of the best clusters within it (None: none), whether they give way.
    """
    n = len(size)
    left, right, total, up = [], [], list(size), list(range(2 * n - 1))
    for k in range(n - 1):
        ends = []
        for x in (a[k], b[k]):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            ends.append(x)
        x, y = ends
        left.append(x)
        right.append(y)
        up[x] = up[y] = n + k
        total.append(total[x] + total[y])
    born, parent, own, inside, parts, gives_way = [0.0], [-1], [0.0], [0.0], [None], [False]
    member, leave, whole = [0] * n, [0.0] * n, [False] * n
    stack = [(2 * n - 2, 0, 0.0)]  # a part, its cluster, and the density at which it fell out, or 0
    while stack:
        node, c, fell = stack.pop()
        if node < n:
            member[node], leave[node], whole[node] = c, fell or 1 / NEAREST, not fell
            inside[c] += size[node]
            own[c] += size[node] * (fell - born[c]) if fell else alive[node] - size[node] * born[c]
            if not fell and inner[node] is not None:  # the only leaf that this cluster ends in
                parts[c], gives_way[c] = inner[node], forced[node]
            continue
        d, kids = dens[node - n], (left[node - n], right[node - n])
        big = [kid for kid in kids if total[kid] >= min_size]
        for kid in kids:
            if fell or kid not in big:
                stack.append((kid, c, fell or d))
            elif len(big) == 2:
                for column, v in ((born, d), (parent, c), (own, 0.0), (inside, 0.0), (parts, None), (gives_way, False)):
                    column.append(v)
                stack.append((kid, len(born) - 1, 0.0))
            else:
                stack.append((kid, c, 0.0))
    for c in range(len(born) - 1, 0, -1):
        inside[parent[c]] += inside[c]
        own[parent[c]] += inside[c] * (born[c] - born[parent[c]])
    selected = [True] * len(born)
    for c in range(len(born) - 1, 0, -1):
        best = own[c]
        if better(parts[c], own[c]):
            best, selected[c] = parts[c], False
        parts[parent[c]] = (parts[parent[c]] or 0.0) + best
    for c in range(len(born) - 1, 0, -1):
        selected[c] |= gives_way[c]
        if selected[c] and 1 / born[c] < epsilon:
            selected[c], gives_way[parent[c]] = False, True
    label = [-1] * len(born)
    for c in range(1, len(born)):
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else (c if selected[c] else -1)
    return member, leave, whole, label, born, own, parts[0], gives_way[0]


def better(parts: float | None, own: float) -> bool:
    """Whether the parts of a cluster are more stable than it; what differs by rounding only is equal."""
    return parts is not None and parts > own + 1e-9 * abs(own)


_EDGE = ("tree", "a", "b", "u", "v", "w")
_LEAF = ("tree", "leaf", "size", "alive", "inner", "forced")
_DONE = "kind int, tree long, leaf long, leave double, whole boolean, label long, born double, stability double, size long, alive double, inner double, forced boolean"


def _condensed(trees: DataFrame, leaves: DataFrame, parts: int, min_size: int, reach: float | None, epsilon: float) -> DataFrame:
    """Every tree condensed in a task: of each leaf (kind 0) the density at which it left and the selected cluster with its birth and
    stability, of each tree (kind 1) what it is as a leaf of a larger one.

    With ``reach`` the roots begin there and may be selected. A cluster is called by its smallest leaf.
    """
    null = lambda kind: F.lit(None).cast(kind)
    edges = trees.select(*_EDGE, null("long").alias("size"), null("double").alias("alive"), null("double").alias("inner"), null("boolean").alias("forced"))
    points = leaves.select("tree", F.col("leaf").alias("a"), null("long").alias("b"), null("long").alias("u"), null("long").alias("v"), null("double").alias("w"), "size", "alive", "inner", "forced")
    names = [f.split(" ")[0] for f in _DONE.split(", ")]

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        is_leaf = t.column("b").is_null().to_numpy()
        points, edges = t.filter(pa.array(is_leaf)), t.filter(pa.array(~is_leaf))
        points = points.sort_by([("tree", "ascending"), ("a", "ascending")])
        edges = edges.sort_by([("tree", "ascending"), ("w", "descending"), ("u", "ascending"), ("v", "ascending")])
        tree, ids = points.column("tree").to_numpy(), points.column("a").to_numpy()
        of = edges.column("tree").to_numpy()
        start = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        stop = np.r_[start[1:], len(tree)]
        lo, hi = np.searchsorted(of, tree[start], side="left").tolist(), np.searchsorted(of, tree[start], side="right").tolist()
        dens = (1 / np.maximum(1 - edges.column("w").to_numpy(), NEAREST)).tolist()
        ends = [edges.column(c).to_numpy() for c in "ab"]
        size, alive, inner, forced = (points.column(c).to_pylist() for c in ("size", "alive", "inner", "forced"))
        out: list[list] = [[] for _ in names]
        for s, e, i, j in zip(start.tolist(), stop.tolist(), lo, hi):
            own_ids = ids[s:e]
            a, b = (np.searchsorted(own_ids, x[i:j]).tolist() for x in ends)
            member, leave, whole, label, born, own, best, gives_way = condense(size[s:e], alive[s:e], inner[s:e], forced[s:e], a, b, dens[i:j], min_size, epsilon)
            root, records = own[0], sum(size[s:e])
            if reach is not None and records >= min_size:
                born[0], own[0] = 1 / reach, root - records / reach
                if gives_way or not better(best, own[0]):
                    label = [0] * len(label)
            own_ids = own_ids.tolist()
            smallest: dict[int, int] = {}
            for x, c in zip(own_ids, member):
                smallest.setdefault(label[c], x)
            for x, c, d, w in zip(own_ids, member, leave, whole):
                k = label[c]
                found = (smallest[k], born[k], own[k]) if k >= 0 else (None, None, None)
                for column, v in zip(out, (0, int(tree[s]), x, d, w, *found, None, None, None, None)):
                    column.append(v)
            if reach is None:
                for column, v in zip(out, (1, int(tree[s]), None, None, None, None, None, None, records, root, best, gives_way)):
                    column.append(v)
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _KINDS)], names=names)

    return edges.union(points).repartition(parts, "tree").mapInArrow(run, _DONE)


_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())


def _cut_trees(big: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges of large trees with ``upper``: whether an edge is among the lightest, of which a task holds all, in the order in which trees are condensed.

    The place of the cut is estimated and steers only how the work is divided. Edges of equal weight are told apart by their ends.
    """
    wanted = 0.75 * TASK_EDGES
    grid = [10 ** (i / 100 - 6) for i in range(601)]
    marked = big.join(sizes.select("tree", F.lit(wanted).alias("want"), F.col("n").alias("among")), "tree").withColumns({"upper": F.lit(False), "tied": F.lit(True)})
    for key in (F.col("w"), -F.col("u"), -F.col("v")):
        marked = marked.withColumn("_k", key)
        part = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.max("want") / F.max("among")))
        cut = marked.where("tied").groupBy("tree").agg(F.percentile_approx("_k", grid, 200_000).alias("q"), part.alias("part"))
        cut = cut.select("tree", F.get("q", F.floor((F.log10("part") + 6) * 100).cast("int")).alias("cut"))
        marked = marked.join(cut, "tree").withColumns({"upper": F.col("upper") | (F.col("tied") & (F.col("_k") < F.col("cut"))), "tied": F.col("tied") & (F.col("_k") == F.col("cut"))}).drop("_k", "cut", "want", "among")
        counts = marked.groupBy("tree").agg((F.lit(wanted) - F.count_if("upper")).alias("want"), F.greatest(F.lit(1), F.count_if("tied")).alias("among"))
        marked = marked.join(counts, "tree")
    # at least one edge is in the upper part, so that every round divides the tree
    return marked.withColumn("upper", F.col("upper") | F.col("tied")).select(*_EDGE, "upper")


def _hierarchies(trees: DataFrame, leaves: DataFrame, parts: int, min_size: int, reach: float | None, epsilon: float) -> DataFrame:
    """:func:`_condensed` for trees of any size.

    Of a tree that no task can hold the lightest edges are set aside; what is left falls into parts, which are condensed by themselves, and then
    are the leaves of the tree of the lightest edges. What comes out is the same as if one task had condensed the whole.
    """
    sizes = trees.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > TASK_EDGES)
    if sizes.isEmpty():
        return _condensed(trees, leaves, parts, min_size, reach, epsilon)
    sizes = materialize(sizes, "sizes")
    small = _condensed(trees.join(sizes, "tree", "left_anti"), leaves.join(sizes, "tree", "left_anti"), parts, min_size, reach, epsilon)
    marked = materialize(_cut_trees(trees.join(sizes.select("tree"), "tree", "left_semi"), sizes), "cut")
    points = leaves.join(sizes, "tree", "left_semi")
    lower = marked.where("not upper")
    _, found = _graph.boruvka(lower.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")))
    named = found.join(found.groupBy("comp").agg(F.min("node").alias("part")), "comp").select(F.col("node").alias("leaf"), "part")
    points = materialize(points.join(named, "leaf", "left").withColumn("part", F.coalesce("part", "leaf")), "parts")
    part_of = points.select("leaf", "part")
    within = lower.join(part_of, F.col("a") == F.col("leaf")).select(F.col("part").alias("tree"), *_EDGE[1:])
    low = materialize(_hierarchies(within, points.select(F.col("part").alias("tree"), *_LEAF[1:]), parts, min_size, None, epsilon), "low")
    above = marked.where("upper").select(*_EDGE)
    for end in "ab":
        above = above.join(part_of.select(F.col("leaf").alias(end), F.col("part").alias("_p")), end).withColumn(end, F.col("_p")).drop("_p")
    outer = points.select("part", F.col("tree").alias("outer")).distinct()
    tops = low.where("kind = 1").join(outer, F.col("tree") == F.col("part")).select(F.col("outer").alias("tree"), F.col("part").alias("leaf"), *_LEAF[2:])
    up = materialize(_hierarchies(above.select(*_EDGE), tops, parts, min_size, reach, epsilon), "up")
    over = up.where("kind = 0").select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), *[F.col(c).alias(f"_{c}") for c in ("leave", "whole", "label", "born", "stability")])
    both = low.where("kind = 0").join(over, F.col("tree") == F.col("_l"))
    stands = F.col("_label").isNull() & F.col("_whole")  # nothing above was selected, so what was selected within the part is
    pick = lambda c: F.when(stands, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    rows = both.select("kind", F.col("_t").alias("tree"), "leaf", F.when(F.col("_whole"), F.col("leave")).otherwise(F.col("_leave")).alias("leave"), (F.col("whole") & F.col("_whole")).alias("whole"), pick("label"), pick("born"), pick("stability"), "size", "alive", "inner", "forced")
    return small.union(rows).union(up.where("kind = 1"))


class Clustering:
    """The similarity hierarchy of every group: components, links and selected clusters as tables.

    ``rows`` is ``grp, key, vec`` with one usable vector for each key (:func:`grouped_vectors`); rows with a null in
    any of the three are left out. Only pairs of a group at least ``min_similarity`` alike are joined; it is
    the reach of the hierarchy, whose roots are what is connected at that similarity. ``min_samples`` counts
    a record itself; at 2 or less mutual reachability is the plain distance. An empty table gives empty results.
    """

    def __init__(self, rows: DataFrame, min_similarity: float = 0.9, min_samples: int = 2, min_size: int = 2, epsilon: float = 0.0, dim: int = 64, probes: int = 8, margin: float = 0.15):
        self.min_similarity, self.min_size, self.epsilon = min_similarity, min_size, epsilon
        self.reps, members = _collapse(rows.where("grp is not null and key is not null and vec is not null"))
        self.members = materialize(members, "members")
        n = self.reps.count()
        self.parts = int(max(1, -(-n // 16_384)))
        whole = max(WHOLE_ROWS, n // MAX_LARGE)
        large = np.array([r.grp for r in self.reps.groupBy("grp").count().where(F.col("count") > whole).select("grp").collect()], dtype="i8")
        held = self.reps.where(F.col("grp").isin(*large.tolist())) if 0 < len(large) <= 1000 else self.reps
        quantiser = _ivf.fit(held, n if len(large) else 1, dim)
        placed = _place(self.reps.withColumn("core", F.lit(1.0)), large, quantiser, self.parts, probes, margin)
        if min_samples > 2:
            core = materialize(_core(placed, quantiser.rotation, min_similarity, min_samples), "core")
            placed = _place(core, large, quantiser, self.parts, probes, margin)
        found = materialize(_edges(placed, quantiser.rotation, min_similarity), "links")
        self.links = found.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
        forest, nodes = _graph.boruvka(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"), "w"))
        self.forest = forest
        self.nodes = nodes.withColumnRenamed("node", "rep")

    def components(self) -> DataFrame:
        """``rep, comp, copies`` of everything that is linked or has copies."""
        near = self.nodes.join(self.reps.select("rep", "copies"), "rep")
        alone = self.reps.where("copies > 1").select("rep", "copies").join(self.nodes, "rep", "left_anti")
        return near.select("rep", "comp", "copies").unionByName(alone.withColumn("comp", F.col("rep")))

    def clusters(self) -> DataFrame:
        """``rep, cluster, persistence, stability``: the selected clusters of the condensed hierarchy; cluster is the smallest key.

        Persistence is the density at which a record left its cluster less that at which the cluster began.
        """
        nodes = materialize(self.components(), "nodes")
        ends = self.forest.join(self.nodes.select(F.col("rep").alias("u"), F.col("comp").alias("tree")), "u")
        trees = materialize(ends.select("tree", F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"), "trees")
        leaves = nodes.select(F.col("comp").alias("tree"), F.col("rep").alias("leaf"), F.col("copies").alias("size"), (F.col("copies") / NEAREST).alias("alive"), F.lit(None).cast("double").alias("inner"), F.lit(False).alias("forced"))
        got = _hierarchies(trees, leaves, self.parts, self.min_size, 1 - self.min_similarity, self.epsilon)
        return got.where("label is not null").select(F.col("leaf").alias("rep"), F.col("label").alias("cluster"), (F.col("leave") - F.col("born")).alias("persistence"), "stability")

    def alike(self, clusters: DataFrame) -> DataFrame:
        """``rep, cluster`` of those clusters in which all are at least ``min_similarity`` alike.

        A cluster whose counted links are all there could be is one. Of the others, those with a member
        farther than that from the smallest are none, and the rest is compared in full, block by block.
        """
        comps = clusters.select("rep", F.col("cluster").alias("comp"))
        sizes = comps.join(self.links, "rep", "left").groupBy("comp").agg(F.count("*").alias("n"), F.sum(F.coalesce("links", F.lit(0))).alias("links"), F.min("rep").alias("first"))
        sizes = materialize(sizes, "sizes")
        full = sizes.where(F.col("links") >= F.col("n") * (F.col("n") - 1)).select("comp")
        open_ = sizes.where(F.col("links") < F.col("n") * (F.col("n") - 1))
        rows = materialize(comps.join(open_.select("comp", "n", "first"), "comp").join(self.reps.select("rep", "vec"), "rep").select("comp", "n", "first", "rep", "vec"), "open")
        firsts = rows.where("rep = first").select("comp", F.col("vec").alias("fvec"))
        far = _far(rows.join(firsts, "comp").select("comp", "vec", "fvec"), self.min_similarity)
        rows = rows.join(far.distinct(), "comp", "left_anti")
        blocks = F.ceil(F.col("n") / CHECK_ROWS).cast("int")
        rows = rows.select("comp", "rep", "vec", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("b"), blocks.alias("of"))
        tiles = rows.select("comp", "vec", "b", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o"))
        tiles = tiles.select("comp", "vec", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")
        bad = _unlike(tiles.repartition(self.parts, "comp", "i", "j"), self.min_similarity).distinct()
        fine = rows.select("comp").distinct().join(bad, "comp", "left_anti")
        return comps.join(full.union(fine), "comp", "left_semi").select("rep", F.col("comp").alias("cluster"))


def _far(pairs: DataFrame, min_similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cos = np.einsum("nd,nd->n", _ivf.unit(_ivf.matrix(batch.column(1))), _ivf.unit(_ivf.matrix(batch.column(2))))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(cos < min_similarity - 1e-12))], names=["comp"])

    return pairs.mapInArrow(run, "comp long")


def _unlike(tiles: DataFrame, min_similarity: float) -> DataFrame:
    """Components with a pair less alike than that, from ``comp, vec, i, j, b`` with both blocks of a tile in one task."""

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        comp, i, j, b = (t.column(c).to_numpy() for c in ("comp", "i", "j", "b"))
        vec = t.column("vec").combine_chunks()
        order = np.lexsort((b, j, i, comp))
        comp, i, j, b = comp[order], i[order], j[order], b[order]
        start = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        bad = set()
        for s, e in zip(start, np.r_[start[1:], len(comp)]):
            if comp[s] in bad:
                continue
            x = _ivf.unit(_ivf.matrix(vec.take(pa.array(order[s:e]))))
            m = s + int((b[s:e] == i[s]).sum())
            a, c = (x, x) if i[s] == j[s] else (x[: m - s], x[m - s :])
            if len(a) and len(c) and (a @ c.T).min() < min_similarity - 1e-12:
                bad.add(comp[s])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.int64())], names=["comp"])

    return tiles.mapInArrow(run, "comp long")


def grouped_vectors(vectors: DataFrame, instances: DataFrame, group: str = "lu_lemma", dim: int = 64) -> DataFrame:
    """``grp, name, key, vec``: usable vectors with the folded group of their instance; without one they are left out.

    ``grp`` is a 64-bit hash of the folded name: of ten million names two share one with a chance of about 3 in a million.
    """
    names = instances.select(F.col("id").cast("long").alias("key"), fold(group).alias("name")).where("key is not null and name is not null").groupBy("key").agg(F.min("name").alias("name"))
    return _ivf.usable_vectors(vectors, dim).join(names, "key").select(F.xxhash64("name").alias("grp"), "name", "key", "vec")


def mutual_clusters(vectors: DataFrame, instances: DataFrame, min_similarity: float = 0.9) -> DataFrame:
    """``cluster_key, instance_key``: sets of two or more in which all are alike and none is like a key outside.

    They are selected from the condensed hierarchy that reaches down to that similarity. As no set may have a similar key outside,
    parts give way to the cluster that holds them at every distance (``epsilon`` 1). With ``min_samples`` 2 (a record and its nearest) a distance is
    never less than the greater of the two core distances, so it is the mutual reachability and cores need not be
    computed. An exact check follows: clusters not all alike are left out.
    """
    rows = grouped_vectors(vectors, instances).select("grp", "key", "vec")
    model = Clustering(rows, min_similarity, min_samples=2, epsilon=1.0)
    found = materialize(model.clusters(), "clusters")
    keys = model.alike(found).join(model.members, "rep")
    return keys.select(F.col("cluster").alias("cluster_key"), F.col("key").alias("instance_key"))


def describe_clusters(vectors: DataFrame, instances: DataFrame, min_similarity: float = 0.8, min_samples: int = 3, exemplars: int = 3) -> DataFrame:
    """``lu_lemma, cluster_key, size, stability, exemplars``: the most stable clusters with their most persistent members.

    Of equally persistent members the smaller key comes first; copies of one vector are one exemplar.
    """
    named = grouped_vectors(vectors, instances)
    model = Clustering(named.select("grp", "key", "vec"), min_similarity, min_samples)
    got = materialize(model.clusters(), "clusters")
    order = Window.partitionBy("cluster").orderBy(F.desc("persistence"), "rep")
    best = got.withColumn("n", F.row_number().over(order)).where(F.col("n") <= exemplars)
    best = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("n", "rep"))).alias("best"))
    sizes = got.join(model.reps.select("rep", "copies", "grp"), "rep").groupBy("cluster", "grp").agg(F.sum("copies").alias("size"), F.max("stability").alias("stability"))
    names = instances.select(fold("lu_lemma").alias("lu_lemma")).where("lu_lemma is not null").distinct().withColumn("grp", F.xxhash64("lu_lemma"))
    return sizes.join(best, "cluster").join(names, "grp").select("lu_lemma", F.col("cluster").alias("cluster_key"), "size", F.round("stability", 6).alias("stability"), F.transform("best", lambda b: b["rep"]).alias("exemplars"))
