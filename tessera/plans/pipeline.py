"""Two-step clustering: within each lemma, then over the lemmas' clusters, and the nearest cluster for what is left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import UNKNOWN
from tessera.operators import clusterers, evaluation, similarity
from tessera.operators.blocks import matrix, unit
from tessera.operators.propagation import propagate_labels
from tessera.operators.views import filtered_lemmas
from tessera.storage import materialize

#: Rows of a lemma that one task clusters from a full similarity matrix (4,096 rows: 134 MB). Larger lemmas go over the edge table.
TASK_ROWS = 4096


def training_label(label: str, split: str, testsplits: list[str]):
    """The label that constrains a row: null for test rows and for rows without a label."""
    return F.when(~F.col(split).isin(*testsplits) & (F.col(label) != UNKNOWN), F.col(label))


def local_labels(rows: DataFrame, config: dict, sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """``instance_id, label`` from ``instance_id, lu_lemma, fixed, vector``: all lemmas in one job.

    ``forward`` takes the labels of another clustering, one of ``sources`` (``instance_id, label``) by the name given as its ``source``; rows that has no label for are
    clusters of their own.

    A lemma of up to ``TASK_ROWS`` rows is clustered in a task. A larger one is clustered over the table of its pairs by distributed label propagation,
    which the ``cw`` clusterers allow; ``ident`` and ``const`` need neither. Other clusterers hold a lemma in memory and refuse more rows.
    """
    kind = config["type"]
    if kind == "ident":
        return rows.select("instance_id", F.coalesce("fixed", F.concat(F.lit("#"), F.col("instance_id").cast("string"))).alias("label"))
    if kind == "const":
        return rows.select("instance_id", F.coalesce("fixed", F.lit("0")).alias("label"))
    if kind == "forward":
        name = (config.get("options") or config).get("source")
        if name not in (sources or {}):
            raise ValueError(f"no clustering is given under {name!r}")
        other = sources[name].select("instance_id", F.concat(F.lit("#"), F.col("label").cast("string")).alias("_l"))
        return rows.select("instance_id").join(other, "instance_id", "left").select("instance_id", F.coalesce("_l", F.concat(F.lit("#"), F.col("instance_id").cast("string"))).alias("label"))
    sizes = rows.groupBy("lu_lemma").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > TASK_ROWS).select("lu_lemma")
    small = rows.join(sizes.where(F.col("n") <= TASK_ROWS).select("lu_lemma"), "lu_lemma")

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("instance_id")
        labels = clusterers.create(config).fit_predict(unit(matrix(t.column("vector"))), t.column("fixed").to_pylist())
        known = set(t.column("fixed").to_pylist())
        return pa.table({"instance_id": t.column("instance_id"), "label": pa.array([c if c in known else f"#{c}" for c in map(str, labels)])})

    done = small.select("lu_lemma", "instance_id", "fixed", "vector").groupBy("lu_lemma").applyInArrow(one, "instance_id long, label string")
    if large.isEmpty():
        return done
    if kind not in ("cw", "unsup-cw"):
        raise ValueError(f"a lemma has more than {TASK_ROWS} rows; {kind} holds all pairs of a lemma in memory")
    rest = rows.join(large, "lu_lemma")
    # the graph, rounds and seed are those of the clusterer in a task
    cw = clusterers.create(config)
    if cw.criterion is not None:
        raise ValueError(f"a lemma has more than {TASK_ROWS} rows; {cw.criterion} needs all pairs of a lemma in memory")
    least = -1.1 if cw.knn is not None else float(cw.min_weight)
    edges = similarity.similar_pairs(rest, "lu_lemma", "instance_id", "vector", least, knn=cw.knn)
    edges = edges.where("cosine > 0" if cw.binarize or cw.knn is not None else "cosine <> 0")
    nodes = rest.select(F.col("instance_id").alias("node"), (F.col("fixed") if kind == "cw" else F.lit(None).cast("string")).alias("fixed"))
    spread = propagate_labels(nodes, edges.select("a", "b", F.col("cosine").alias("w")), cw.max_iter, not cw.binarize, cw.random_state or 0)
    return done.union(spread.select(F.col("node").alias("instance_id"), "label"))


def _clustered(rows: DataFrame, data: dict, testsplits: list[str]) -> DataFrame:
    lemmas = filtered_lemmas(rows.where("lu_lemma is not null"), testsplits, data["mincount"], data["maxcount"]).select("lu_lemma")
    return rows.join(lemmas, "lu_lemma")


def local_step(rows: DataFrame, config: dict, testsplits: list[str]) -> DataFrame:
    """``instance_id, label`` of the local step, written, to be shared by runs that differ in global settings only."""
    rows = rows.withColumn("fixed", training_label("label", "split", testsplits))
    return materialize(local_labels(_clustered(rows, config["data"], testsplits), config["local"]["clusterer"]), "local")


def two_step(rows: DataFrame, config: dict, testsplits: list[str], dim: int = 64, labels: DataFrame | None = None) -> DataFrame:
    """``instance_id, lu_lemma, split, label_true, local_cluster, cluster_label, assigned_by`` of every row.

    ``rows``: ``instance_id, lu_lemma, split, label, vector`` with each instance once. Lemmas that :func:`filtered_lemmas` leaves out, and rows without a
    lemma, are not clustered; of them the test rows get the nearest cluster (``nn``), the others none. A cluster with a training label is known and
    called by it, others by their lemma. ``merge_knowns`` of the global settings: ``before_global`` and ``after_local`` join known clusters of
    all lemmas before the global step, ``after_global`` by their common label after it, ``never`` keeps them apart by lemma.
    ``labels`` are :func:`local_step` of the same rows and settings, where they are at hand.
    """
    data, local, glob = config["data"], config["local"], config["global"]
    rows = materialize(rows.withColumn("fixed", training_label("label", "split", testsplits)), "instances")
    clustered = _clustered(rows, data, testsplits)
    labels = materialize(local_labels(clustered, local["clusterer"]), "local") if labels is None else labels
    known = ~F.col("label").startswith("#")
    named = clustered.select("instance_id", "lu_lemma", "vector").join(labels, "instance_id")
    together = glob["merge_knowns"] in ("before_global", "after_local")
    own = F.when(known & F.lit(together), F.concat(F.lit("known::"), "label")).otherwise(F.concat_ws("::", "lu_lemma", "label"))
    named = named.withColumn("local_cluster", own).withColumn("known_label", F.when(known, F.col("label")))
    named = materialize(named, "named")
    means = similarity.centroids(named, ["local_cluster", "known_label"], "vector", dim).withColumn("id", F.xxhash64("local_cluster"))
    means = materialize(means, "centroids")
    usable = means.where(F.col("known_label").isNotNull() | F.col("numaveraged").between(glob["min_size"], glob["max_size"]))
    # one group of all clusters: in a task if it is small enough, else over the edge table
    spread = local_labels(usable.select(F.col("id").alias("instance_id"), F.lit("all").alias("lu_lemma"), F.col("known_label").alias("fixed"), F.col("embedding").alias("vector")), glob["clusterer"]).withColumnRenamed("instance_id", "node")
    new = F.col("label").startswith("#")
    step2 = usable.join(spread, F.col("id") == F.col("node")).select("local_cluster", "embedding", "numaveraged", "known_label", F.when(new, F.concat(F.lit("g::"), F.substring("label", 2, 40))).otherwise(F.col("label")).alias("cluster_label"))
    if glob["merge_knowns"] == "never":
        step2 = step2.withColumn("cluster_label", F.when(F.col("known_label").isNotNull(), F.col("local_cluster")).otherwise(F.col("cluster_label")))
    step2 = materialize(step2.drop("known_label"), "global")
    assigned = named.join(step2.select("local_cluster", "cluster_label"), "local_cluster").select("instance_id", "local_cluster", "cluster_label", F.when(F.col("known_label").isNotNull(), "fixed").otherwise("global").alias("assigned_by"))
    final = similarity.centroids(step2.select("cluster_label", "embedding"), ["cluster_label"], "embedding", dim).withColumn("id", F.xxhash64("cluster_label"))
    left = rows.join(assigned.select("instance_id"), "instance_id", "left_anti").where(F.col("split").isin(*testsplits))
    near = similarity.nearest(left.select("instance_id", "vector"), final, "instance_id", "id", "vector", "embedding")
    filled = near.join(final.select("id", "cluster_label"), "id").select("instance_id", F.lit(None).cast("string").alias("local_cluster"), "cluster_label", F.lit("nn").alias("assigned_by"))
    return rows.select("instance_id", "lu_lemma", "split", F.col("label").alias("label_true")).join(assigned.union(filled), "instance_id", "left")


def merge_clusters(assignments: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters joined by transitive label, and the assignments moved to them: (clusters, assignments).

    A joined cluster has the sum of its parts' sizes; its id is a hash of clustering and label, so a second run gives the same.
    """
    merged_id = F.xxhash64("clusteringid", "transitive_label")
    merged = clusters.groupBy("clusteringid", "transitive_label").agg(F.bool_or("isknown").alias("isknown"), F.sum("numelems").alias("numelems"), F.count("*").alias("n_parts"))
    moved = assignments.join(clusters.select(F.col("id").alias("clusterid"), "clusteringid", "transitive_label"), "clusterid")
    return merged.select(merged_id.alias("id"), "clusteringid", F.col("transitive_label").alias("label"), "transitive_label", "isknown", "numelems", "n_parts"), moved.select("instanceid", merged_id.alias("clusterid"), F.col("clusterid").alias("local_cluster_id"))


def evaluate(result: DataFrame, testsplits: list[str]) -> DataFrame:
    """Induction scores of the test rows of :func:`two_step` that have a label and a cluster."""
    rows = result.where(F.col("split").isin(*testsplits) & (F.col("label_true") != UNKNOWN))
    return evaluation.induction_scores(rows, "label_true", "cluster_label")
