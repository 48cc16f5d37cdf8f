import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.skew import balanced_join, per_key_results, plan_loads

SCHEMA = "k string, l string, r string, key string"


def brute(rows):
    out = {}
    for k, l, r, _ in rows:
        if k is not None:
            n, ls, rs = out.setdefault(k, [0, set(), set()])
            out[k][0] += 1
            ls.update([l] if l is not None else [])
            rs.update([r] if r is not None else [])
    return {(k, n, len(ls), len(rs)) for k, (n, ls, rs) in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["hot"] * 40 + ["warm"] * 10 + [f"k{i}" for i in range(30)] + [None, ""]
    return [(rng.choice(keys), rng.choice(["a", "b", "c", None]), rng.choice([f"r{i}" for i in range(60)] + [None]), "x") for _ in range(1500)]


def test_counts_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = per_key_results(df, F.col("k"), F.col("l"), F.col("r"), tasks=5).collect()
    assert {(r.key, r.n_rows, r.n_labels, r.n_records) for r in got} == brute(rows)
    assert {r.key for r in got if r.is_large} == {k for k, n, _, _ in brute(rows) if n > 0.025 * len(rows)}


def test_no_task_gets_more_than_its_share(spark, rows):
    plan = plan_loads(spark.createDataFrame(rows, SCHEMA), "k", 8)
    assert len(plan.heavy["hot"]) > 1
    assert max(plan.loads) <= 1.5 * sum(plan.loads) / 8


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert per_key_results(df, F.col("k"), F.col("l"), F.col("r"), tasks=3).count() == 0
    assert balanced_join(df, df, "k", "r", tasks=3).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_equals_plain_join(spark, rows, how):
    left = spark.createDataFrame(rows, SCHEMA)
    right = spark.createDataFrame([("hot", "z", 1), ("hot", "y", 2), ("k3", "z", 3), (None, "n", 4), ("gone", "g", 5)], "k string, l string, v int")
    got = balanced_join(left, right, "k", "r", tasks=6, how=how)
    assert got.columns == ["k", "l", "r", "key", "right_l", "v"]
    want = left.join(right.withColumnRenamed("l", "right_l"), "k", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_without_records_is_not_one_shard(spark):
    """Half of all rows have one key and no record: they are counted before they are sent."""
    rows = [("hot", "a", None, "x")] * 3000 + [("hot", None, None, "x")] * 500 + [("hot", "b", f"r{i}", "x") for i in range(300)] + [(f"k{i}", "a", f"r{i}", "x") for i in range(900)]
    got = {tuple(r)[:4] for r in per_key_results(spark.createDataFrame(rows, SCHEMA), F.col("k"), F.col("l"), F.col("r"), tasks=4).collect()}
    assert got == brute(rows)


def test_plan_does_not_grow_the_expression(spark):
    """The plan is joined as a table: the rows' plan is as long for a thousand tasks as for ten."""
    rows = spark.createDataFrame([("hot", "a", "r", "x")] * 50 + [(f"k{i}", "a", "r", "x") for i in range(50)], SCHEMA)
    short, long = (len(plan_loads(rows, "k", n).place(rows, "k", F.col("r"))._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 1000))
    assert long < 2 * short
