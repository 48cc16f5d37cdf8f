"""Runs of a grid of configurations over the same instances, and their scores."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import UNKNOWN
from tessera.operators import evaluation
from tessera.plans import experiments, pipeline

SCHEMA = "identifier string, local_identifier string, status string, micro_f1__novelty_frame double, bcubed_f1 double, purity double, numclusters long, error string"


def score(result: DataFrame, testsplits: list[str]) -> dict:
    """Micro F1 of known and new labels, B-cubed F1, purity and the number of clusters over the test rows with a label; None without any."""
    rows = result.where(F.col("split").isin(*testsplits) & (F.col("label_true") != UNKNOWN) & F.col("cluster_label").isNotNull())
    known = result.where(~F.col("split").isin(*testsplits) & (F.col("label_true") != UNKNOWN)).select(F.col("label_true").alias("label")).distinct()
    table = evaluation.with_known(rows, "label_true", "cluster_label", known)
    hit = (F.col("gold") == F.col("predicted")) | ~(F.col("gold_known") | F.col("predicted_known"))
    one = table.agg(F.try_divide(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("f1")).first()
    induced = evaluation.induction_scores(rows, "label_true", "cluster_label").first()
    return {"micro_f1__novelty_frame": one.f1, "bcubed_f1": induced.bcubed_f1, "purity": induced.purity, "numclusters": result.select("cluster_label").where("cluster_label is not null").distinct().count()}


def run_grid(rows_for, configs: list[dict], dim: int = 64, workers: int = 4) -> DataFrame:
    """A row for each configuration with its identifiers and scores; one that fails has its error and no scores.

    ``rows_for(alpha)`` gives the instances mixed with that weight, as :func:`pipeline.two_step` takes them. Runs go on side by side on the driver's
    threads; those with the same data and local settings share one local step. The test splits must be among the splits of the data.
    """
    lock, local, mixed = threading.Lock(), {}, {}

    def once(store: dict, key, make):
        with lock:
            entry = store.setdefault(key, {"lock": threading.Lock()})
        with entry["lock"]:
            if "value" not in entry:
                entry["value"] = make()
            return entry["value"]

    def run(config: dict) -> tuple:
        ids = experiments.run_identifier(config), experiments.local_identifier(config)
        try:
            tests = config["data"]["testsplits"]
            if not set(tests) <= set(config["data"]["splits"]):
                raise ValueError(f"test splits {tests} aren't among the splits {config['data']['splits']}")
            rows = once(mixed, float(config["local"]["alpha"]), lambda: pipeline.materialize(rows_for(float(config["local"]["alpha"])), "mixed"))
            labels = once(local, ids[1], lambda: pipeline.local_step(rows, config, tests))
            s = score(pipeline.materialize(pipeline.two_step(rows, config, tests, dim, labels), "result"), tests)
            return (*ids, "finished", s["micro_f1__novelty_frame"], s["bcubed_f1"], s["purity"], s["numclusters"], None)
        except Exception as e:
            return (*ids, "failed", None, None, None, None, f"{type(e).__name__}: {e}"[:500])

    with ThreadPoolExecutor(workers) as pool:
        done = list(pool.map(run, configs))
    spark = rows_for(0.5).sparkSession
    return spark.createDataFrame(done, SCHEMA)
