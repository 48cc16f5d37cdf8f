"""Derived tables the named queries share: usable vectors, labelled instances, and a clustering by lemma and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import UNKNOWN, fold
from tessera.functions.vectors import is_zero
from tessera.storage import table

DIM = 64


def vectors(spark: SparkSession, folder: str, masking: str) -> DataFrame:
    """``key, embedding``: usable vectors of one masking, each key once."""
    rows = table(spark, folder, "instance_vectors").where((F.col("masking") == masking) & (F.size("embedding") == DIM) & ~is_zero("embedding"))
    return rows.groupBy("key").agg(F.min("embedding").alias("embedding"))


def instances(spark: SparkSession, folder: str) -> DataFrame:
    """Instances with folded lemma and label; a blank one is null."""
    named = {c: F.nullif(fold(c), F.lit("")).alias(c) for c in ("lu_lemma", "frame_label")}
    return table(spark, folder, "frameinstances").select("id", "dataset_id", named["lu_lemma"], named["frame_label"], "global_id")


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Bridge rows with folded split, without repetition."""
    return table(spark, folder, "split_instances").select("datasetsplit_id", "instance_id", fold("split").alias("split")).distinct()


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """A cluster for each lemma and label, under clustering 1; the label is its transitive label."""
    rows = instances(spark, folder).where("lu_lemma is not null and frame_label is not null")
    name = F.concat_ws("::", "lu_lemma", "frame_label")
    grouped = rows.groupBy(name.alias("id"), "frame_label").agg(F.count("*").alias("numelems"))
    return grouped.select("id", F.lit(1).alias("clusteringid"), F.col("id").alias("label"), F.col("frame_label").alias("transitive_label"), (F.col("frame_label") != UNKNOWN).alias("isknown"), "numelems")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = instances(spark, folder).where("lu_lemma is not null and frame_label is not null")
    return rows.select(F.col("id").alias("instanceid"), F.concat_ws("::", "lu_lemma", "frame_label").alias("clusterid"), F.col("lu_lemma").alias("local_cluster_id"))


def clustering(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, ["train", "dev", "test"], ["test"], "localglobal")], "id int, datasetsplit_id long, splits array<string>, testsplits array<string>, type string")


def two_clusterings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusterings, clusters, assignments) with a second clustering beside the first: a cluster for each label, over all lemmas."""
    named = clustering(spark).union(spark.createDataFrame([(2, 1, ["train", "dev", "test"], ["dev"], "onestep")], clustering(spark).schema))
    rows = instances(spark, folder).where("frame_label is not null")
    label = F.col("frame_label")
    own = rows.groupBy(F.concat(F.lit("2::"), label).alias("id"), label.alias("label")).agg(F.count("*").alias("numelems"))
    own = own.select("id", F.lit(2).alias("clusteringid"), "label", F.col("label").alias("transitive_label"), (F.col("label") != UNKNOWN).alias("isknown"), "numelems")
    held = rows.select(F.col("id").alias("instanceid"), F.concat(F.lit("2::"), label).alias("clusterid"), F.lit(None).cast("string").alias("local_cluster_id"))
    return named, clusters(spark, folder).unionByName(own), assignments(spark, folder).unionByName(held)


def clusterings(spark: SparkSession, folder: str) -> DataFrame:
    """Clusterings as the runs report them: every global one, and the local ones they came from."""
    runs = table(spark, folder, "experiment_scores").where("clustering_id is not null")
    top = runs.groupBy(F.col("clustering_id").alias("id")).agg(F.max_by(F.struct("micro_f1__novelty_frame", "clusterer", "datasetsplit", "splits", "numclusters", "clustering_duration", "local_cid", "local_clusterer", "numclusters_local"), F.struct("reported_at", "micro_f1__novelty_frame", "experiment_run_id")).alias("r")).select("id", "r.*")
    names = table(spark, folder, "datasetsplits").select(F.col("id").alias("datasetsplit_id"), F.col("name").alias("datasetsplit"))
    top = top.join(names, "datasetsplit", "left")
    none = F.lit(None)
    out = top.select("id", F.lit("localglobal").alias("type"), F.col("micro_f1__novelty_frame").alias("micro_f1"), "clusterer", "datasetsplit_id", "splits", F.slice("splits", -1, 1).alias("testsplits"), "numclusters", F.col("clustering_duration").alias("duration"), F.col("local_cid").alias("clusteringid_local"))
    local = top.where("local_cid is not null").groupBy("local_cid").agg(F.min("local_clusterer").alias("clusterer"), F.min("numclusters_local").alias("numclusters"), F.min("datasetsplit_id").alias("datasetsplit_id"))
    local = local.select(F.col("local_cid").alias("id"), F.lit("local").alias("type"), none.cast("double").alias("micro_f1"), "clusterer", "datasetsplit_id", none.cast("array<string>").alias("splits"), none.cast("array<string>").alias("testsplits"), "numclusters", none.cast("double").alias("duration"), none.cast("long").alias("clusteringid_local"))
    return out.union(local)
