import numpy as np
import pytest

from tessera.operators import clusterers
from tessera.operators.propagation import propagate_labels
from tessera.plans import experiments, pipeline


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(0, 0.05, (7, 8)) + np.eye(8)[0], rng.normal(0, 0.05, (7, 8)) + np.eye(8)[1]])


Y = ["A", "A"] + [None] * 5 + ["B"] + [None] * 6


@pytest.mark.parametrize("config", [{"type": "cw", "random_state": 3}, {"type": "cw", "knn": 3, "binarize": False, "random_state": 3}, {"type": "ha-constrained", "n_extra_clusters": 0, "random_state": 1}, "softmax"])
def test_constrained_clusterers_extend_labels(two, config):
    got = clusterers.create(config).fit_predict(two, Y)
    assert got == ["A"] * 7 + ["B"] * 7 and clusterers.respects(got, Y)


def test_softmax_on_standardised_features(two):
    got = clusterers.create({"type": "softmax", "standardise": True}).fit_predict(two, ["A"] * 5 + [None] * 2 + ["B"] * 5 + [None] * 2)
    assert got == ["A"] * 7 + ["B"] * 7


@pytest.mark.parametrize("config", [{"type": "ha"}, {"type": "ha", "linkage": "ward"}, {"type": "ha", "linkage": "complete", "metric": "cosine"}, {"type": "ha", "distance_threshold": 0.6}, "ha-silhouette", {"type": "unsup-cw", "random_state": 1}, {"type": "unsupervised", "clusterer": {"type": "ha"}}, {"type": "silhouette", "clusterings": {"type": "clusterer-list", "clusterers": [{"type": "ident"}, {"type": "ha"}]}}])
def test_unsupervised_clusterers_find_two(two, config):
    got = clusterers.create(config).fit_predict(two, None)
    assert len(set(got)) == 2 and len(set(got[:7])) == 1 == len(set(got[7:]))


def test_bridge_does_not_join_labels():
    """Two labelled rows with different labels and a bridge between them."""
    x = np.array([[1.0, 0], [0.9, 0.44], [0.7, 0.71], [0.3, 0.95]])
    for config in ({"type": "cw", "min_weight": 0.8, "random_state": 0}, {"type": "ha-constrained", "n_extra_clusters": 0}):
        got = clusterers.create(config).fit_predict(x, ["A", None, None, "B"])
        assert got[0] == "A" and got[3] == "B" and set(got) == {"A", "B"}


def test_simple_clusterers(two):
    assert clusterers.create("ident").fit_predict(two[:3], ["A", None, None]) == ["A", "1", "2"]
    assert clusterers.create("const").fit_predict(two[:3], ["A", None, None]) == ["A", "0", "0"]
    with pytest.raises(ValueError):
        clusterers.create("const").fit_predict(two[:2], ["0", None])
    assert clusterers.create({"type": "forward", "source": ["a", "b"]}).fit_predict(two[:2]) == ["a", "b"]
    assert clusterers.create({"type": "unsupervised", "discard_labelled": True, "clusterer": {"type": "const"}}).fit_predict(two[:3], ["A", None, None]) == ["A", "0", "0"]
    with pytest.raises(ValueError):
        clusterers.create("nothing")


@pytest.mark.parametrize("name", ["ident", "const", "cw", "ha", "ha-constrained", "xmeans", "softmax", "ha-silhouette", "ha-stopping"])
def test_one_row(name):
    assert len(clusterers.create(name).fit_predict(np.ones((1, 4)), [None])) == 1


def test_xmeans_splits_far_groups():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)) + c for c in ((0, 0), (5, 0), (0, 5))])
    got = clusterers.create({"type": "xmeans", "initial": 1, "random_state": 2}).fit_predict(x)
    assert len(set(got)) == 3 and all(len(set(got[i : i + 40])) == 1 for i in (0, 40, 80))


def test_pairs_ratio_stops_at_the_first_level_that_has_them(two):
    got = clusterers.create({"type": "ha-stopping", "stopping_ratio": 0.4}).fit_predict(two)
    sizes = np.unique(got, return_counts=True)[1]
    assert (sizes * (sizes - 1) / 2).sum() >= 0.4 * 14 * 13 / 2


def test_labels_are_resolved():
    assert clusterers.resolve_labels(["0", "0", "1"], ["A", None, None]) == ["A", "A", "1"]
    assert clusterers.resolve_labels(["0", "0", "0", "1"], ["A", "B", "B", None], violated=True, min_support=2, min_accuracy=0.6) == ["B", "B", "B", "1"]
    assert clusterers.resolve_labels(["0", "0"], ["A", "B"], violated=True, min_accuracy=0.9) == ["0", "0"]


def test_silhouette_matches_hand():
    s = clusterers.silhouette(np.array([[0.0], [1.0], [10.0]]), ["a", "a", "b"], "euclidean")
    assert np.allclose(s, [0.9, 8 / 9, 0])
    assert not clusterers.silhouette(np.ones((3, 1)), ["a", "b", "c"]).any()


def test_propagation_keeps_fixed_labels(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, None), (3, None), (4, "B"), (5, None), (6, None), (7, None)], "node long, fixed string")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (6, 7, 0.9)], "a long, b long, w double")
    got = {r.node: r.label for r in propagate_labels(nodes, edges).collect()}
    assert got[1] == got[2] == got[3] == "A" and got[4] == got[5] == "B" and got[6] == got[7]
    assert propagate_labels(nodes.limit(0), edges.limit(0)).count() == 0


ROWS = "instance_id long, lu_lemma string, split string, label string, vector array<double>"


@pytest.fixture(scope="module")
def instances(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        c = i % 4
        v = np.eye(8)[c] + rng.normal(0, 0.05, 8)
        rows.append((i, None if i == 119 else f"l{i % 3}", "train" if i % 5 else "test", "<unk>" if c == 3 else f"F{c}", v.tolist()))
    return spark.createDataFrame(rows, ROWS)


@pytest.mark.parametrize("mode", ["before_global", "after_global", "after_local", "never"])
def test_two_steps_recover_labels(instances, mode):
    config = experiments.with_defaults({"global": {"merge_knowns": mode}, "data": {"testsplits": ["test"]}})
    got = pipeline.two_step(instances, config, ["test"], dim=8).collect()
    assert len(got) == 120
    for r in got:
        if r.lu_lemma is not None and r.label_true != "<unk>":
            assert r.cluster_label == r.label_true or mode == "never" and r.cluster_label == f"{r.lu_lemma}::{r.label_true}"
        elif r.lu_lemma is not None:
            assert "F" not in r.cluster_label
    # the row without a lemma is a training row and stays unassigned
    assert [r.assigned_by for r in got if r.lu_lemma is None] == [None]
    assert pipeline.evaluate(pipeline.two_step(instances, config, ["test"], dim=8), ["test"]).first().bcubed_precision == 1


def test_large_lemmas_go_over_the_edge_table(instances):
    rows = instances.where("lu_lemma is not null").withColumn("fixed", pipeline.training_label("label", "split", ["test"]))
    plain = {r.instance_id: r.label for r in pipeline.local_labels(rows, {"type": "cw"}).collect()}
    old = pipeline.TASK_ROWS
    pipeline.TASK_ROWS = 10
    try:
        spread = {r.instance_id: r.label for r in pipeline.local_labels(rows, {"type": "cw"}).collect()}
        with pytest.raises(ValueError):
            pipeline.local_labels(rows, {"type": "ha"})
    finally:
        pipeline.TASK_ROWS = old
    known = {i for i, c in plain.items() if not c.startswith("#")}
    assert known == {i for i, c in spread.items() if not c.startswith("#")} and all(plain[i] == spread[i] for i in known)


def _both_paths(rows, config):
    """Labels of the task's clusterer and of the edge table, as groups of ids."""
    out, old = [], pipeline.TASK_ROWS
    for limit in (old, 5):
        pipeline.TASK_ROWS = limit
        try:
            groups = {}
            for r in pipeline.local_labels(rows, config).collect():
                groups.setdefault(r.label, set()).add(r.instance_id)
        finally:
            pipeline.TASK_ROWS = old
        out.append({frozenset(g) for g in groups.values()})
    return out


@pytest.mark.parametrize("options", [{}, {"knn": 10}, {"knn": 10, "binarize": False}, {"min_weight": 0.9}])
def test_both_paths_agree_on_unlabelled_rows(spark, options):
    # tight clouds at a cosine of about 0.65 to each other: one cluster at the default weight, apart by their nearest rows or at 0.9
    rng = np.random.default_rng(6)
    centres = np.full((3, 8), 0.25) + 0.6 * np.eye(8)[:3]
    rows = [(i, "l", None, (centres[i % 3] + rng.normal(0, 0.02, 8)).tolist()) for i in range(45)]
    rows = spark.createDataFrame(rows, "instance_id long, lu_lemma string, fixed string, vector array<double>")
    task, table = _both_paths(rows, {"type": "cw", "random_state": 2} | options)
    assert task == table and len(task) == (3 if options else 1)


def test_labels_travel_as_far_in_both_paths(spark):
    # a chain whose edges grow weaker: each node takes the label of the one before it, so the known label passes one node after another
    n = 20
    off = np.linspace(0.49, 0.40, n - 1)
    x = np.linalg.cholesky(np.eye(n) + np.diag(off, 1) + np.diag(off, -1))
    rows = spark.createDataFrame([(i, "l", "A" if i == 0 else None, x[i].tolist()) for i in range(n)], "instance_id long, lu_lemma string, fixed string, vector array<double>")
    task, table = _both_paths(rows.coalesce(1), {"type": "cw", "min_weight": 0.3, "binarize": False, "random_state": 1})
    assert task == table == {frozenset(range(n))}
    with pytest.warns(RuntimeWarning, match="not settled"):
        _both_paths(rows.coalesce(1), {"type": "cw", "min_weight": 0.3, "binarize": False, "max_iter": 1, "random_state": 1})


def test_rows_of_left_out_lemmas_get_the_nearest_cluster(spark, instances):
    more = spark.createDataFrame([(900, "rare", "test", "F1", [0.0, 1.0] + [0.0] * 6)], ROWS)
    config = experiments.with_defaults({"data": {"mincount": 2, "testsplits": ["test"]}})
    got = pipeline.two_step(instances.union(more), config, ["test"], dim=8).where("instance_id = 900").first()
    assert got.assigned_by == "nn" and got.cluster_label == "F1"


def test_grid_and_hashes():
    e = {"hyperparameters": [{"key": ["local", "alpha"], "values": [0.1, 0.2]}, {"key": ["local", "clusterer", "min_weight"], "values": [0.5, 0.6, 0.7]}], "base_run_settings": {"data": {"datasetsplit": "x"}}}
    runs = experiments.grid(e)
    assert len(runs) == 6 and len({experiments.run_identifier(r) for r in runs}) == 6
    assert experiments.experiment_hash(runs) == experiments.experiment_hash(runs[::-1])
    assert experiments.compare(runs[1:], runs)["missing"] == {experiments.run_identifier(runs[0])}
    merged = experiments.with_defaults({"local": {"clusterer": {"type": "ha"}}})
    assert merged["local"]["clusterer"] == {"type": "ha"} and merged["local"]["alpha"] == 0.5
    assert len(experiments.seeded(runs[0], [1, 2], [3, 4, 5])) == 6
    assert experiments.load('{"a": 1}') == {"a": 1}


def test_grid_runs_share_local_steps_and_are_scored(instances, monkeypatch):
    from tessera.plans import runner

    steps = []
    real = pipeline.local_step
    monkeypatch.setattr(pipeline, "local_step", lambda *a: steps.append(1) or real(*a))
    base = {"data": {"splits": ["train", "test"], "testsplits": ["test"]}}
    configs = experiments.grid({"hyperparameters": [{"key": ["global", "merge_knowns"], "values": ["before_global", "after_global"]}], "base_run_settings": base})
    configs += experiments.grid({"base_run_settings": {**base, "local": {"clusterer": {"type": "nothing"}}}})
    configs += experiments.grid({"base_run_settings": {"data": {"splits": ["train"], "testsplits": ["test"]}}})
    got = {r.identifier: r for r in runner.run_grid(lambda alpha: instances, configs, dim=8).collect()}
    assert len(got) == 4 and len(steps) == 2
    assert [got[experiments.run_identifier(c)].status for c in configs] == ["finished", "finished", "failed", "failed"]
    first = got[experiments.run_identifier(configs[0])]
    assert first.micro_f1__novelty_frame == 1 and first.bcubed_f1 == 1 and first.numclusters >= 4


def test_configurations_with_options():
    """Options may stand under a key of their own, and a criterion says which edges stay."""
    cw = clusterers.create({"type": "cw", "options": {"criterion": "minw_0.7", "cwargs": {"max_iter": 7}, "random_state": 3}})
    assert cw.min_weight == 0.7 and cw.criterion is None and cw.max_iter == 7
    for bad in ("maxw_1", "umap_3", "umap_kx"):
        with pytest.raises(ValueError):
            clusterers.create({"type": "cw", "options": {"criterion": bad}})


@pytest.mark.parametrize("criterion", ["minw_0.5", "lmc<=0.95", "umap_k4", "umap_optkv6_sym:max", "umap_optkw6_sym:mean"])
def test_criteria_separate_two_groups(two, criterion):
    x = two
    labels = clusterers.create({"type": "cw", "options": {"criterion": criterion, "random_state": 1}}).fit_predict(x)
    half = len(x) // 2
    assert not set(labels[:half]) & set(labels[half:])


def test_local_clustering_by_hand():
    """A triangle with a tail: coefficients 1, 1, 1/3 and 0."""
    a = np.zeros((4, 4), bool)
    for i, j in ((0, 1), (1, 2), (0, 2), (2, 3)):
        a[i, j] = a[j, i] = True
    assert clusterers.local_clustering(a) == pytest.approx((1 + 1 + 1 / 3) / 4)
    assert clusterers.prune(np.zeros((1, 1)), "umap_k3").shape == (1, 1)


def test_constrained_threshold_is_on_the_scaled_distances():
    """Unlabelled rows lie between 1 and 2, so a threshold of 1 joins only rows of one label and one of 2.5 all that labels allow."""
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(12, 5)))
    y = ["a", "a", "b", "b"] + [None] * 8
    apart = clusterers.create({"type": "ha-constrained", "distance_threshold": 0.9}).fit_predict(x, y)
    assert len(set(apart)) == 10 and apart[0] == apart[1] == "a" and apart[2] == apart[3] == "b"
    assert set(clusterers.create({"type": "ha-constrained", "distance_threshold": 2.5}).fit_predict(x, y)) == {"a", "b"}
    assert len(set(clusterers.create({"type": "ha-constrained", "n_extra_clusters": 2}).fit_predict(x, y))) == 4
    with pytest.raises(ValueError):
        clusterers.create({"type": "ha-constrained", "distance_threshold": 3.5})
