"""Relational views and table functions over instances, splits, clusterings and assignments.

Tables: ``datasets``(id, name), ``frameinstances``(id, dataset_id, lu_lemma, frame_label, global_id, extrainfo),
``datasetsplits``(id, dataset_id, name), ``split_instances``(datasetsplit_id, instance_id, split),
``clusterings``(id, datasetsplit_id, splits, testsplits, type, numclusters, clusteringid_local, micro_f1, ...),
``clusters``(id, clusteringid, label, transitive_label, isknown, numelems), ``assignments``(instanceid, clusterid, local_cluster_id).
Nulls in a join key match nothing; an empty table gives an empty view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import any_of, differs_from_any, minus, same_set, sentence_like


def instances_in_splits(split_instances: DataFrame, instances: DataFrame, datasetsplits: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every instance with its splits and the names of split and dataset. The two name tables are small and joined last."""
    named = datasetsplits.select(F.col("id").alias("datasetsplit_id"), F.col("name").alias("datasetsplit_name"))
    sets = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    rows = split_instances.join(instances.withColumnRenamed("id", "instance_id"), "instance_id")
    return rows.join(named, "datasetsplit_id").join(sets, "dataset_id").select("dataset_id", "dataset_name", "datasetsplit_id", "datasetsplit_name", "split", "instance_id", "lu_lemma", "frame_label", "global_id", *[c for c in ("extrainfo",) if c in instances.columns])


def in_splits(split_instances: DataFrame, instances: DataFrame, datasetsplit_id: int, splits: list[str]) -> DataFrame:
    """Instances of one split assignment whose split is any of ``splits``."""
    chosen = split_instances.where((F.col("datasetsplit_id") == datasetsplit_id) & any_of("split", splits))
    return chosen.join(instances.withColumnRenamed("id", "instance_id"), "instance_id")


def labels_of_dataset(instances: DataFrame, dataset_id: int) -> DataFrame:
    """``label, numinstances, first_instance, last_instance`` of a dataset; instances without a label are one row. Their members are :func:`members_of_dataset`."""
    rows = instances.where(F.col("dataset_id") == dataset_id)
    return rows.groupBy(F.col("frame_label").alias("label")).agg(F.count("*").alias("numinstances"), F.min("id").alias("first_instance"), F.max("id").alias("last_instance"))


def labels_of_splits(split_instances: DataFrame, instances: DataFrame, datasetsplit_id: int, splits: list[str]) -> DataFrame:
    """``label, support, first_instance, last_instance``; support counts instances that have a label, so it is 0 for the row without."""
    rows = in_splits(split_instances, instances, datasetsplit_id, splits)
    return rows.groupBy(F.col("frame_label").alias("label")).agg(F.count("frame_label").alias("support"), F.min("instance_id").alias("first_instance"), F.max("instance_id").alias("last_instance"))


def members_of_dataset(instances: DataFrame, dataset_id: int) -> DataFrame:
    """``label, instance_id``: whose instances :func:`labels_of_dataset` counts, as rows and not as one array for each label however large."""
    return instances.where(F.col("dataset_id") == dataset_id).select(F.col("frame_label").alias("label"), F.col("id").alias("instance_id"))


def members_of_splits(split_instances: DataFrame, instances: DataFrame, datasetsplit_id: int, splits: list[str]) -> DataFrame:
    """``label, instance_id`` of :func:`labels_of_splits`."""
    return in_splits(split_instances, instances, datasetsplit_id, splits).select(F.col("frame_label").alias("label"), "instance_id")


def members_of_lemmas(rows: DataFrame, mincount: int) -> DataFrame:
    """``lu_lemma, instance_id`` of :func:`lemma_groups`: rows of lemmas that have at least ``mincount``."""
    return rows.join(lemma_groups(rows, mincount).select("lu_lemma"), "lu_lemma").select("lu_lemma", "instance_id")


def known_labels(clusterings: DataFrame, clustering_id: int, split_instances: DataFrame, instances: DataFrame) -> DataFrame:
    """Labels of the training splits of a clustering: its splits without its test splits; none where nothing remains."""
    chosen = clusterings.where(F.col("id") == clustering_id).select("datasetsplit_id", F.explode(minus(F.col("splits"), F.col("testsplits"))).alias("split"))
    rows = split_instances.join(F.broadcast(chosen), ["datasetsplit_id", "split"]).join(instances.withColumnRenamed("id", "instance_id"), "instance_id")
    return rows.groupBy(F.col("frame_label").alias("label")).agg(F.count("frame_label").alias("support"))


def lemma_groups(rows: DataFrame, mincount: int) -> DataFrame:
    """``lu_lemma, numel`` of lemmas with at least ``mincount`` rows of :func:`in_splits`."""
    return rows.groupBy("lu_lemma").agg(F.count("*").alias("numel")).where(F.col("numel") >= mincount)


def filtered_lemmas(rows: DataFrame, testsplits: list[str], mincount: int, maxcount: int) -> DataFrame:
    """``lu_lemma, numel_filtered``: rows of a lemma in those of its splits that count.

    A split counts if it differs from any test split, or else has between ``mincount`` and ``maxcount`` rows. With two test splits
    every split differs from one of them, so nothing is filtered.
    """
    by_split = rows.groupBy("lu_lemma", "split").agg(F.count("*").alias("n"))
    kept = by_split.where(differs_from_any("split", testsplits) | F.col("n").between(mincount, maxcount))
    return kept.groupBy("lu_lemma").agg(F.sum("n").alias("numel_filtered"))


def cluster_sizes(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """For each cluster its labels and how many different local clusters and instances it has.

    ``label_unique``, ``label_transitive`` and ``numel_clustered`` are the same in all rows of a cluster; the least is given.
    """
    rows = assignments.join(clusters.withColumnRenamed("id", "clusterid"), "clusterid")
    return rows.groupBy("clusteringid", "clusterid").agg(
        F.min("label").alias("label_unique"), F.min("transitive_label").alias("label_transitive"), F.min("numelems").alias("numel_clustered"),
        F.count_distinct("local_cluster_id").alias("numel_localclusters"), F.count_distinct("instanceid").alias("numel_instances"),
    )


def cluster_sizes_by_transitive_label(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """The same by transitive label: clusters, and the sums of their different instances and local clusters.

    A cluster without any local cluster counts none; arrays of members are not built.
    """
    sizes = cluster_sizes(assignments, clusters)
    return sizes.groupBy("clusteringid", "label_transitive").agg(F.count("*").alias("num_unique_clusters"), F.sum("numel_instances").alias("numel_instances"), F.sum("numel_localclusters").alias("numel_localclusters"))


def cluster_members(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """``clusteringid, clusterid, label_transitive, local_cluster_id, instance_id``, each once: whose members :func:`cluster_sizes` counts."""
    rows = assignments.join(clusters.select(F.col("id").alias("clusterid"), "clusteringid", F.col("transitive_label").alias("label_transitive")), "clusterid")
    return rows.select("clusteringid", "clusterid", "label_transitive", "local_cluster_id", F.col("instanceid").alias("instance_id")).distinct()


def clusters_with_vectors(clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Clusters with their ``embedding`` and ``numaveraged``, null where they have none; ``vectors`` is ``clusterid, embedding, numaveraged``."""
    return clusters.join(vectors.withColumnRenamed("clusterid", "id"), "id", "left")


def assigned_or_not(instances: DataFrame, assignments: DataFrame, clusters: DataFrame, clustering_id: int) -> DataFrame:
    """Every instance with its cluster in one clustering, ``clusterid, label, transitive_label``, null where it is in none."""
    own = clusters.where(F.col("clusteringid") == clustering_id).select(F.col("id").alias("clusterid"), "label", "transitive_label")
    held = assignments.join(own, "clusterid").select(F.col("instanceid").alias("id"), "clusterid", "label", "transitive_label")
    return instances.join(held, "id", "left")


def scored_clusterings(clusterings: DataFrame, datasetsplits: DataFrame) -> DataFrame:
    """Every clustering with its score and, where there is one, the local clustering it came from.

    The condition on the type belongs to the join, so a clustering without a local one is kept.
    """
    cl, lcl = clusterings.alias("cl"), clusterings.alias("lcl")
    on = (F.col("lcl.id") == F.col("cl.clusteringid_local")) & (F.col("lcl.type") == "local")
    names = datasetsplits.select(F.col("id").alias("_ds"), F.col("name").alias("datasetsplit"))
    joined = cl.join(lcl, on, "left").join(names, F.col("cl.datasetsplit_id") == F.col("_ds"), "left")
    return joined.select(
        F.col("cl.id").alias("cid"), F.col("cl.micro_f1").alias("micro_f1__novelty_frame"), F.coalesce("cl.clusterer", "lcl.clusterer").alias("clusterer"), F.col("cl.type").alias("type"),
        F.col("lcl.clusterer").alias("local_clusterer"), F.col("cl.datasetsplit_id").alias("datasetsplit_id"), "datasetsplit", F.col("cl.splits").alias("splits"), F.col("cl.testsplits").alias("testsplits"),
        F.col("cl.numclusters").alias("numclusters"), F.col("lcl.numclusters").alias("numclusters_local"), F.col("cl.duration").alias("duration"), F.col("lcl.id").alias("local_cid"),
    )


def scores_for(scored: DataFrame, datasetsplit: str, testsplits: list[str]) -> DataFrame:
    """Scored clusterings of a split assignment with exactly these test splits, in any order."""
    return scored.where((F.col("datasetsplit") == datasetsplit) & same_set(F.col("testsplits"), F.array(*[F.lit(s) for s in testsplits])))


def experiment_scores(experiments: DataFrame, runs: DataFrame, scored: DataFrame) -> DataFrame:
    """Runs of experiments with the score of their clustering."""
    ex = experiments.select(F.col("id").alias("experiment_id"), "name")
    return runs.withColumnRenamed("id", "experiment_run_id").join(ex, "experiment_id").join(scored, F.col("clustering_id") == F.col("cid"))


def instance_assignments(split_instances: DataFrame, instances: DataFrame, datasetsplits: DataFrame, datasets: DataFrame, assignments: DataFrame, clusters: DataFrame, clusterings: DataFrame) -> DataFrame:
    """Instances with their splits, names and the cluster they are in, for clusterings of the same split assignment."""
    rows = instances_in_splits(split_instances, instances, datasetsplits, datasets)
    of = clusterings.select(F.col("id").alias("clusteringid"), "datasetsplit_id", F.col("type").alias("clusteringtype"))
    named = clusters.select(F.col("id").alias("clusterid"), "clusteringid", F.col("label").alias("clusterlabel"), F.col("transitive_label").alias("tclusterlabel")).join(of, "clusteringid")
    return rows.join(assignments.withColumnRenamed("instanceid", "instance_id"), "instance_id").join(named, ["clusterid", "datasetsplit_id"])


def evaluation_table(split_instances: DataFrame, instances: DataFrame, assignments: DataFrame, clusters: DataFrame, clustering_id: int, datasetsplit_id: int, testsplits: list[str]) -> DataFrame:
    """Test instances with the cluster they are in, or with null where they are in none: ``instanceid, split, label_true, lu_lemma, cid, clabel, transitive_label``."""
    test = in_splits(split_instances, instances, datasetsplit_id, testsplits)
    own = clusters.where(F.col("clusteringid") == clustering_id).select(F.col("id").alias("cid"), F.col("label").alias("clabel"), "transitive_label")
    assigned = assignments.join(own, F.col("clusterid") == F.col("cid")).select(F.col("instanceid").alias("instance_id"), "cid", "clabel", "transitive_label")
    return test.join(assigned, "instance_id", "left").select(F.col("instance_id").alias("instanceid"), "split", F.col("frame_label").alias("label_true"), "lu_lemma", "cid", "clabel", "transitive_label")


def evaluation_table_of(clusterings: DataFrame, clustering_id: int, split_instances: DataFrame, instances: DataFrame, assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """:func:`evaluation_table` with the split assignment and test splits of the clustering itself; empty for an unknown one."""
    row = clusterings.where(F.col("id") == clustering_id).select("datasetsplit_id", "testsplits").head()
    split_id, tests = (row["datasetsplit_id"], row["testsplits"]) if row else (-1, [])
    return evaluation_table(split_instances, instances, assignments, clusters, clustering_id, split_id, tests)


def sentence_matches(instances: DataFrame, pattern: str, dataset_id: int | None = None) -> DataFrame:
    """Instances whose sentence matches a LIKE pattern in lower case."""
    rows = instances if dataset_id is None else instances.where(F.col("dataset_id") == dataset_id)
    return rows.where(sentence_like(F.col("extrainfo.tokens"), pattern))


def unassigned(evaluation: DataFrame) -> DataFrame:
    """``n``: how many test instances are in no cluster."""
    return evaluation.where("cid is null").agg(F.count("*").alias("n"))


def usable_clusters(clusters: DataFrame, smallest: int, largest: int) -> DataFrame:
    """Clusters with a known label, and of the others those of ``smallest`` to ``largest`` members."""
    return clusters.where(F.col("isknown") | F.col("numelems").between(smallest, largest))


def delete_clustering(clustering_id: int, clusterings: DataFrame, clusters: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(deleted clusterings, remaining clusterings, clusters, assignments): a clustering goes with its clusters and their assignments."""
    gone = clusters.where(F.col("clusteringid") == clustering_id).select(F.col("id").alias("clusterid"))
    kept = assignments.join(gone, "clusterid", "left_anti")
    other = ~F.col("clusteringid").eqNullSafe(clustering_id)
    return clusterings.where(F.col("id") == clustering_id), clusterings.where(~F.col("id").eqNullSafe(clustering_id)), clusters.where(other), kept


def delete_all_clusterings(clusterings: DataFrame, clusters: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(deleted clusterings, remaining clusterings, clusters, assignments): what belongs to no clustering of the table is left."""
    gone = clusterings.select(F.col("id").alias("clusteringid"))
    kept = clusters.join(gone, "clusteringid", "left_anti").select(*clusters.columns)
    dead = clusters.join(gone, "clusteringid", "left_semi").select(F.col("id").alias("clusterid"))
    return clusterings, clusterings.where(F.lit(False)), kept, assignments.join(dead, "clusterid", "left_anti").select(*assignments.columns)


def delete_experiments(runs: DataFrame, ids: list[int] | None = None, experiment: str = "experiment_id") -> DataFrame:
    """Runs that are left after some experiments went, or all of them; runs of no experiment stay."""
    mine = F.col(experiment).isNotNull() if ids is None else F.coalesce(F.col(experiment).isin(*ids), F.lit(False))
    return runs.where(~mine)


def copy_experiment(runs: DataFrame, source: int, target: int, run: str = "experiment_run_id", experiment: str = "experiment_id") -> DataFrame:
    """The runs of an experiment as those of a new one: under ids above all others, in their order, with neither status nor results yet."""
    last = runs.agg(F.max(run))
    own = runs.where(F.col(experiment) == source).select(run, "setting").groupBy(run).agg(F.min("setting").alias("setting"))
    # one experiment's runs are numbered; they come from one grid
    number = F.row_number().over(Window.orderBy(run))
    return own.select(F.lit(target).cast("long").alias(experiment), (last.scalar() + number).alias(run), F.col(run).alias("copied_from"), "setting")
