"""Nearest vectors and similarity clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _graph, _ivf, nearest_vectors, queries, similarity_clusters


def brute(cloud, k=5):
    keys = np.array(sorted(cloud))
    x = np.stack([cloud[i] for i in keys]).astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    best = {int(keys[i]): [int(keys[j]) for j in np.lexsort((keys, -s[i]))[:k]] for i in range(len(keys))}
    return keys, s, best


def test_usable_vectors_leave_out_what_cannot_be_compared(vector_table, cloud):
    got = {r.key for r in _ivf.usable_vectors(vector_table).collect()}
    assert got == set(cloud)


def test_nearest_equals_brute_force(vector_table, cloud):
    _, _, best = brute(cloud)
    got = {}
    for r in nearest_vectors.nearest(_ivf.usable_vectors(vector_table), 5, probes=64, margin=9.0).collect():
        got.setdefault(r.key, {})[r["rank"]] = r.neighbour
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == best
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())


def test_pairs_equal_brute_force(vector_table, cloud):
    keys, s, best = brute(cloud)
    at = {int(k): i for i, k in enumerate(keys)}
    want = {(min(a, b), max(a, b)) for a, bs in best.items() for b in bs if s[at[a], at[b]] >= 0.9}
    got = {tuple(r) for r in nearest_vectors.close_neighbour_pairs(vector_table).collect()}
    assert got == want and want


def test_large_group_of_copies_costs_its_size(spark):
    rows = [("unmasked", i, [1.0] + [0.0] * 63) for i in range(3000)] + [("unmasked", 5000, [0.0, 1.0] + [0.0] * 62)]
    df = spark.createDataFrame(rows, "masking string, key long, embedding array<float>")
    got = nearest_vectors.nearest(_ivf.usable_vectors(df), 5, 0.9)
    assert got.count() == 3000 * 5
    assert [r.neighbour for r in got.where("key = 2").orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def test_empty(spark, vector_table):
    none = vector_table.where("key = -1")
    assert nearest_vectors.nearest(_ivf.usable_vectors(none)).count() == 0
    assert nearest_vectors.close_neighbour_pairs(none).count() == 0
    inst = spark.createDataFrame([], "id long, lu_lemma string")
    assert similarity_clusters.mutual_clusters(none, inst).count() == 0
    assert similarity_clusters.describe_clusters(none, inst).count() == 0


def test_recall_of_the_index(data, spark):
    """At least 0.9 of the true five nearest, and nearly all at 0.9 or above, with several lists and groups."""
    old = _ivf.LIST_ROWS, _ivf.GROUP_ROWS
    _ivf.LIST_ROWS, _ivf.GROUP_ROWS = 16, 64
    try:
        usable = _ivf.usable_vectors(spark.read.parquet(f"{data}/instance_vectors.parquet"))
        cloud = {r.key: np.frombuffer(r.vec, "<f4") for r in usable.collect()}
        _, s, best = brute(cloud)
        got = {}
        for r in nearest_vectors.nearest(usable, 5, probes=16, margin=9.0).collect():
            got.setdefault(r.key, set()).add(r.neighbour)
        assert np.mean([len(got.get(k, set()) & set(b)) / 5 for k, b in best.items()]) >= 0.9
    finally:
        _ivf.LIST_ROWS, _ivf.GROUP_ROWS = old


@pytest.mark.parametrize("rows_of_list", [32, 128])
def test_recall_of_the_close_pairs_as_they_are_searched(spark, monkeypatch, rows_of_list):
    """With the probes and the margin of p3_found, over 30 to 120 lists in several groups."""
    monkeypatch.setattr(_ivf, "LIST_ROWS", rows_of_list)
    monkeypatch.setattr(_ivf, "GROUP_ROWS", 512)
    vectors = spark.read.parquet("/root/testdata/sf0.01/instance_vectors.parquet")
    cloud = {r.key: np.frombuffer(r.vec, "<f4") for r in _ivf.usable_vectors(vectors).collect()}
    keys, s, best = brute(cloud)
    at = {int(k): i for i, k in enumerate(keys)}
    want = {(min(int(a), int(b)), max(int(a), int(b))) for a, row in best.items() for b in row if s[at[int(a)], at[int(b)]] >= 0.9}
    got = {tuple(r) for r in nearest_vectors.close_neighbour_pairs(vectors).collect()}
    assert len(cloud) > 3000 and len(want) > 200 and len(got & want) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


@pytest.fixture(scope="module")
def instances(spark, cloud):
    rows = [(k, ("  Sagen" if k % 2 else "sagen ") if k % 3 else ("geben" if k % 5 else None), "x", 1) for k in cloud]
    return spark.createDataFrame(rows, "id long, lu_lemma string, key string, comp int")


def mutual(cloud, names, limit=0.9):
    keys, s, _ = brute(cloud)
    near = {}
    for i, a in enumerate(keys):
        near[int(a)] = frozenset([int(a)] + [int(b) for j, b in enumerate(keys) if names.get(int(a)) is not None and names.get(int(a)) == names.get(int(b)) and s[i, j] >= limit])
    return {(min(n), a) for a, n in near.items() if len(n) > 1 and all(near[b] == n for b in n)}


@pytest.mark.parametrize("whole", [4096, 8])
def test_mutual_clusters_equal_brute_force(vector_table, instances, cloud, whole):
    """With lists of their own for large groups too."""
    names = {r.id: r.lu_lemma.strip().lower() if r.lu_lemma else None for r in instances.collect()}
    old = similarity_clusters.WHOLE_ROWS
    similarity_clusters.WHOLE_ROWS = whole
    try:
        got = {tuple(r) for r in similarity_clusters.mutual_clusters(vector_table, instances).collect()}
    finally:
        similarity_clusters.WHOLE_ROWS = old
    want = mutual(cloud, names)
    assert got == want and want


def test_chain_is_no_mutual_cluster(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.93, 0.3676, 0.0], [0.7298, 0.6837, 0.0]  # a~b and b~c, but not a~c
    rows = [("unmasked", i + 1, v + [0.0] * 61) for i, v in enumerate([a, b, c])]
    df = spark.createDataFrame(rows, "masking string, key long, embedding array<float>")
    inst = spark.createDataFrame([(i, "x") for i in (1, 2, 3)], "id long, lu_lemma string")
    assert similarity_clusters.mutual_clusters(df, inst).count() == 0


def test_clusters_have_sizes_and_exemplars(vector_table, instances):
    rows = similarity_clusters.describe_clusters(vector_table, instances).collect()
    assert rows and all(r["size"] >= 2 and 1 <= len(r.exemplars) <= 3 and r.cluster_key is not None for r in rows)
    assert {r.lu_lemma for r in rows} <= {"sagen", "geben"}


def tree_rows(seed, n, digits):
    """A random tree with weights that are often equal, and its leaves with copies."""
    rng = np.random.default_rng(seed)
    ids = rng.permutation(1000)[:n]
    edges = [(0, int(min(a, b)), int(max(a, b)), int(min(a, b)), int(max(a, b)), float(round(w, digits))) for a, b, w in ((ids[i], ids[rng.integers(0, i)], rng.random()) for i in range(1, n))]
    return edges, [(0, int(i), int(rng.integers(1, 4)), None, False) for i in ids]


@pytest.mark.parametrize("n, digits, min_size, epsilon", [(60, 9, 2, 0.0), (60, 1, 5, 0.25)])
def test_divided_hierarchy_is_the_whole_one(spark, monkeypatch, n, digits, min_size, epsilon):
    """Clusters, persistence and stability do not depend on what a task can hold, also where many edges weigh the same."""
    edges, leaves = tree_rows(n + digits, n, digits)
    trees = spark.createDataFrame(edges, "tree long, a long, b long, u long, v long, w double")
    points = spark.createDataFrame(leaves, "tree long, leaf long, size long, inner double, forced boolean").withColumn("alive", F.col("size") / similarity_clusters.NEAREST)
    found = []
    for held in (1_000_000, 25):
        monkeypatch.setattr(similarity_clusters, "TASK_EDGES", held)
        rows = similarity_clusters._hierarchies(trees, points, 3, min_size, 1.0, epsilon).where("kind = 0").collect()
        assert len(rows) == n
        found.append({r.leaf: (r.label, r.label and round(r.leave - r.born, 4), r.label and round(r.stability, 2)) for r in rows})
    assert found[0] == found[1]
    assert any(x[0] is not None for x in found[0].values())


def test_large_groups_find_their_pairs_over_several_lists(spark, data, monkeypatch):
    """Of the pairs within a group at 0.8 or above, at least 0.99 are linked when the group is divided among lists."""
    monkeypatch.setattr(similarity_clusters, "WHOLE_ROWS", 16)
    monkeypatch.setattr(_ivf, "LIST_ROWS", 16)
    usable = _ivf.usable_vectors(spark.read.parquet(f"{data}/instance_vectors.parquet"))
    model = similarity_clusters.Clustering(usable.select(F.lit(1).cast("long").alias("grp"), "key", "vec"), 0.8)
    reps = {r.rep: np.frombuffer(r.vec, "<f4") for r in model.reps.collect()}
    _, s, _ = brute(reps)
    want = int((s >= 0.8).sum() - len(reps))
    assert len(reps) > 300 and model.links.agg(F.sum("links")).first()[0] >= 0.99 * want


def planted(spark, n_groups=6):
    """Groups of well separated tight clusters: vectors, instances and the clusters that must come out."""
    rng = np.random.default_rng(12)
    rows, names, want, key = [], [], set(), 0
    for g in range(n_groups):
        axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        for c in range(3):
            members = []
            for _ in range(4 + c + g):
                v = axes[c] + 0.03 * rng.normal(size=64) / 8
                rows.append(("unmasked", key, v.astype("f4").tolist()))
                names.append((key, f" Lemma{g}\t"))
                members.append(key)
                key += 1
            want.add((f"lemma{g}", members[0], len(members)))
        for c in range(3, 9):  # strangers
            rows.append(("unmasked", key, axes[c].astype("f4").tolist()))
            names.append((key, f"lemma{g}"))
            key += 1
    return spark.createDataFrame(rows, "masking string, key long, embedding array<float>"), spark.createDataFrame(names, "id long, lu_lemma string"), want


@pytest.mark.parametrize("whole", [4096, 8])
def test_planted_clusters_come_out(spark, monkeypatch, whole):
    monkeypatch.setattr(similarity_clusters, "WHOLE_ROWS", whole)
    vectors, instances, want = planted(spark)
    got = similarity_clusters.describe_clusters(vectors, instances).collect()
    assert {(r.lu_lemma, r.cluster_key, r["size"]) for r in got} == want
    assert all(len(r.exemplars) == 3 for r in got)


def kruskal(edges):
    up, out = {}, set()

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v, w in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        a, b = find(u), find(v)
        if a != b:
            up[a] = b
            out.add((min(u, v), max(u, v)))
    return out, {x: find(x) for x in list(up)}


@pytest.mark.parametrize("held", [1_000_000, 40, 0])
def test_spanning_forests_equal_kruskal(spark, monkeypatch, held):
    monkeypatch.setattr(_graph, "TASK_EDGES", held)
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)): float(round(w, 1)) for a, b, w in zip(rng.integers(0, 60, 150), rng.integers(0, 60, 150), rng.random(150)) if a < b}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    want, roots = kruskal(rows)
    u, v, w = (np.array(c) for c in zip(*rows))
    assert {(int(u[i]), int(v[i])) for i in _graph.spanning_forest(u, v, w)} == want
    forest, nodes = _graph.boruvka(spark.createDataFrame(rows + rows[:9], "u long, v long, w double"), jumps=1)
    assert {(r.u, r.v) for r in forest.collect()} == want
    comps = {r.node: r.comp for r in nodes.collect()}
    assert len(comps) == len(roots) and all(comps[c] == c and c <= x for x, c in comps.items())
    assert all((comps[a] == comps[b]) == (roots[a] == roots[b]) for a in roots for b in roots)


def test_hierarchy_finds_two_dense_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.05, (10, 8)) + np.eye(8)[0], rng.normal(0, 0.05, (10, 8)) + np.eye(8)[1] + 0.8 * np.eye(8)[0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    u, v = np.triu_indices(20, 1)
    keep = _graph.spanning_forest(u, v, s[u, v])
    w = s[u, v][keep]
    order = np.argsort(-w)
    ones = [1] * 20
    member, leave, _, label, born, *_ = similarity_clusters.condense(ones, [1e6] * 20, [None] * 20, [False] * 20, u[keep][order].tolist(), v[keep][order].tolist(), (1 / (1 - w[order])).tolist(), 5, 0.0)
    got = np.array(label)[member]
    assert len(set(got[:10]) - {-1}) == 1 and len(set(got[10:]) - {-1}) == 1 and set(got[:10]) != set(got[10:])
    assert all(d >= born[c] for d, c in zip(leave, member))


def test_mutual_reachability_equals_brute_force(vector_table, instances, cloud):
    """Components at 0.8 when a record needs two others as near, copies counted."""
    names = {r.id: r.lu_lemma.strip().lower() if r.lu_lemma else None for r in instances.collect()}
    keys, s, _ = brute(cloud)
    same = np.array([[names[int(a)] is not None and names[int(a)] == names[int(b)] for b in keys] for a in keys])
    s = np.where(same, s, -2)
    np.fill_diagonal(s, -2)
    core = -np.sort(-s, axis=1)[:, 1]  # itself is the first of three
    w = np.minimum(s, np.minimum(core[:, None], core[None]))
    edges = [(int(keys[i]), int(keys[j]), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w >= 0.8, 1)))]
    _, roots = kruskal(edges)
    rows = similarity_clusters.grouped_vectors(vector_table, instances).select("grp", "key", "vec")
    model = similarity_clusters.Clustering(rows, 0.8, min_samples=3)
    got = {r.key: r.comp for r in model.components().join(model.members, "rep").collect()}
    # copies of one vector are one node; two copies alone are too few for a core of three
    for a in roots:
        for b in roots:
            assert (got[a] == got[b]) == (roots[a] == roots[b])


def test_neighbours_of_any_similarity_with_many_lists(spark, monkeypatch):
    # 500 lists of strangers: the nearest are in lists all over the index
    monkeypatch.setattr(_ivf, "LIST_ROWS", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64)).astype("f4")
    rows = spark.createDataFrame([("unmasked", i, v.tolist()) for i, v in enumerate(x)], "masking string, key long, embedding array<float>")
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    got = {(r.key, r.neighbour) for r in queries.p3_neighbours(spark, "").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u[::20] @ u.T
    sims[np.arange(100), np.arange(0, 2000, 20)] = -2
    want = {(20 * i, int(j)) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for j in row}
    assert len(got) == 500 and len(got & want) >= 0.99 * len(want)
