import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, text, vectors
from tessera.operators import evaluation, fingerprints, leaderboard, similarity


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 1.0])], "id int, a array<float>, b array<float>")


def test_vector_expressions(pairs):
    r = {x.id: x for x in pairs.select("id", vectors.dot("a", "b").alias("dot"), vectors.norm("a").alias("norm"), vectors.l2_normalize("a").alias("unit"), vectors.cosine("a", "b").alias("cos"), vectors.mix("a", "b", "0.5").alias("mix"), vectors.blend("a", "b", 0.25).alias("blend"), vectors.add("a", "b").alias("add"), vectors.scale("a", 2).alias("twice"), vectors.cosine_distance("a", "b").alias("far"), vectors.dims("b").alias("dims"), vectors.is_zero("a").alias("zero")).collect()}
    assert r[1].dot == 24 and r[1].norm == 5 and r[1].unit == [0.6, 0.8] and r[1].cos == pytest.approx(0.96) and r[1].add == [7, 7] and r[1].twice == [6, 8]
    assert np.allclose(r[1].mix, [0.5**0.5] * 2) and r[1].blend == [3.25, 3.75] and r[1].far == pytest.approx(0.04)
    assert r[2].unit == [0, 0] and r[2].cos is None and r[2].zero and r[1].dims == 2
    assert r[3].dot is None and r[3].unit is None
    assert pairs.select(vectors.constant(0.5, 3).alias("c")).first().c == [0.5] * 3


def test_array_predicates(spark):
    df = spark.createDataFrame([("test", ["a", "b"], ["b", "a", "a"]), ("dev", [], ["x"]), (None, None, ["x"])], "s string, a array<string>, b array<string>")
    r = df.select("s", arrays.differs_from_any("s", ["test"]).alias("one"), arrays.differs_from_any("s", ["test", "dev"]).alias("two"), arrays.any_of("s", []).alias("none"), arrays.same_set("a", "b").alias("same"), arrays.minus("b", "a").alias("minus"), arrays.length("a").alias("n"), arrays.subset("a", "b").alias("sub")).collect()
    assert [x.one for x in r] == [False, True, None] and [x.two for x in r] == [True, True, None]
    assert r[0].same and not r[1].same and r[0].minus == [] and r[1].minus == ["x"] and [x.n for x in r] == [2, None, None] and r[1].sub and not r[0].none


def test_unnest_lockstep_pads_with_null(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, [], []), (3, None, ["z"])], "id int, x array<int>, y array<string>")
    got = arrays.unnest_lockstep(df.withColumnsRenamed({"x": "xs", "y": "ys"}), n="xs", s="ys").select("id", "n", "s").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, "a"), (1, 2, None), (1, 3, None), (2, None, None), (3, None, "z")], key=str) or (3, None, None) in map(tuple, got)


def test_sentence_like_marks_null_tokens(spark):
    df = spark.createDataFrame([(["The", None, "Dog"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(arrays.sentence_like("t", "the * %dog")).collect()] == [True, None]


def test_fold(spark):
    df = spark.createDataFrame([(" \t Sagen ",), ("<UNK>",), ("  ",), (None,)], "w string")
    assert [tuple(r) for r in df.select(text.fold("w"), text.fold_term("w")).collect()] == [("sagen", "sagen"), ("<unk>", None), ("", None), (None, None)]


LABELS = "gold string, predicted string"


def test_induction_by_hand(spark):
    """Contingency [[2, 1], [0, 3]]: purity and inverse purity 5/6."""
    rows = [("a", "x")] * 2 + [("a", "y")] + [("b", "y")] * 3 + [(None, "x"), ("a", None)]
    r = evaluation.induction_scores(spark.createDataFrame(rows, LABELS), "gold", "predicted").first()
    assert r.purity == pytest.approx(5 / 6) and r.inverse_purity == pytest.approx(5 / 6)
    assert r.bcubed_precision == pytest.approx((2 * 1 + 1 * 0.25 + 3 * 0.75) / 6) and r.bcubed_recall == pytest.approx((2 * 2 / 3 + 1 / 3 + 3) / 6)
    assert r.fmi == pytest.approx(4 / ((1 + 6) * (3 + 3)) ** 0.5)


def test_report_counts_absent_labels_and_zero_divisions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], LABELS)
    known = spark.createDataFrame([("a",), ("b",), ("never",)], "label string")
    r = {x.label: x for x in evaluation.classification_report(df, "gold", "predicted", known).collect()}
    assert set(r) == {"a", "b", "never"} and r["a"].precision == 1 and r["a"].recall == 0.5 and r["never"].f1 == 0 and r["b"].precision == 0
    avg = {x.average: x for x in evaluation.averages(df, "gold", "predicted", known).collect()}
    assert avg["macro"].f1 == pytest.approx((2 / 3) / 3) and avg["micro"].precision == pytest.approx(0.5)


def test_evaluation_of_nothing(spark):
    df, known = spark.createDataFrame([], LABELS), spark.createDataFrame([], "label string")
    assert evaluation.classification_report(df, "gold", "predicted").count() == 0
    assert evaluation.averages(df, "gold", "predicted").count() == 0
    assert evaluation.novelty_detection(df, "gold", "predicted", known).count() == 0
    assert evaluation.induction_scores(df, "gold", "predicted").first().purity is None


def test_fingerprint_ignores_order_and_counts_repetition(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    f = lambda df: fingerprints.table_fingerprint(df, ["a", "b"]).first().fingerprint
    assert f(a) == f(a.orderBy(F.desc("a")).repartition(3)) != f(a.distinct())
    assert f(spark.createDataFrame([(1, "2|null")], "a int, b string")) != f(spark.createDataFrame([(12, None)], "a int, b string"))
    assert f(a.limit(0)) and fingerprints.config_hash({"b": 1, "a": 2}) == fingerprints.config_hash({"a": 2, "b": 1})


def test_leaderboard_ranks_null_last_and_keeps_ties(spark):
    df = spark.createDataFrame([("e", 1, 0.5), ("e", 2, 0.5), ("e", 3, None), ("e", 4, float("nan")), ("e", 5, 0.9), (None, 6, 0.1)], "e string, r int, m double")
    got = {x.r: x["rank"] for x in leaderboard.leaderboard(df, "e", "r", ["m"]).collect()}
    assert got == {5: 1, 1: 2, 2: 2, 3: 4, 4: 4, 6: 1}
    assert {x.r for x in leaderboard.leaderboard(df, "e", "r", ["m"], 2).collect()} == {5, 1, 2, 6}


def test_pairs_over_several_tiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6))
    rows = [(i, "g" if i < 80 else None, v.tolist()) for i, v in enumerate(x)]
    old = similarity.TILE_ROWS
    similarity.TILE_ROWS = 16
    try:
        got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, "i long, g string, v array<double>"), "g", "i", "v", 0.7).collect()}
    finally:
        similarity.TILE_ROWS = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if u[i] @ u[j] >= 0.7}


def test_nearest_in_several_blocks(spark):
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(40, 5)), rng.normal(size=(33, 5))
    qs, ts = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>") for m in (q, t))
    old = similarity.BROADCAST_ROWS
    similarity.BROADCAST_ROWS = 7
    try:
        got = {r.id: r.t for r in similarity.nearest(qs, ts.withColumnsRenamed({"id": "t", "v": "w"}), "id", "t", "v", "w").collect()}
    finally:
        similarity.BROADCAST_ROWS = old
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, t))
    assert got == dict(enumerate((u @ w.T).argmax(1).tolist()))


def test_silhouettes_of_one_cluster_and_singletons(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, c string, v array<double>")
    got = {r.i: r.silhouette for r in similarity.silhouettes(df, "i", "c", "v", 2).collect()}
    assert got[1] > 0.9 and got[3] == 0
    assert all(r.silhouette == 0 for r in similarity.silhouettes(df.where("c = 'a'"), "i", "c", "v", 2).collect())


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) as g", "case when id % 2 = 0 then '<unk>' else 'L' end as l")
    assert {r.id for r in similarity.sample(df, "id", 20, 4).collect()} == {r.id for r in similarity.sample(df.repartition(7), "id", 20, 4).collect()}
    got = similarity.group_sample(df, "g", "id", 10, "l").collect()
    assert len(got) == 30 and all(r.l == "L" for r in got)


def test_written_tables_are_read_back_and_cleared(spark):
    from tessera import storage

    storage.clear(spark)
    got = storage.materialize(spark.range(5).withColumnRenamed("id", "x y"), "t")
    assert got.count() == 5 and got.columns == ["x y"]
    assert storage.clear(spark) == 1 and storage.clear(spark) == 0


def test_silhouettes_in_several_blocks(spark, monkeypatch):
    """Blocks of means give what one broadcast gives, and what pairs give."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    rows = [(i, f"c{i % 11}", v.tolist(), 9) for i, v in enumerate(x)] + [(99, "alone", [1.0] * 6, 9), (100, None, [1.0] * 6, 9)]
    df = spark.createDataFrame(rows, "id long, c string, v array<double>, n int")
    one = {r.id: r.silhouette for r in similarity.silhouettes(df, "id", "c", "v", 6).collect()}
    monkeypatch.setattr(similarity, "BROADCAST_ROWS", 4)
    more = {r.id: r.silhouette for r in similarity.silhouettes(df, "id", "c", "v", 6).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, c = 1 - u @ u.T, np.arange(60) % 11
    far = 1 - u @ (np.ones(6) / 6**0.5)
    for i in range(60):
        a = d[i][(c == c[i]) & (np.arange(60) != i)].mean()
        b = min([far[i]] + [d[i][c == k].mean() for k in range(11) if k != c[i]])
        assert one[i] == pytest.approx((b - a) / max(a, b)) and more[i] == pytest.approx(one[i])
    assert one[99] == more[99] == 0 and len(one) == len(more) == 61
