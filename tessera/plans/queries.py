"""Named queries: name to (spark, folder) -> DataFrame. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays, json, times, vectors
from tessera.functions.text import UNKNOWN, fold, fold_term
from tessera.operators import evaluation, fingerprints, leaderboard, similarity, skew, views
from tessera.plans import experiments, pipeline, tables
from tessera.sources import corpora, encoders, stores
from tessera.storage import table
from tessera.streaming import imports

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- a few keys holding most records


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_lemma_results(spark, folder).where("is_large").select("lu_lemma")


@query
def p7_lemma_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, labels and distinct instances of every folded lemma, the large ones named."""
    rows = table(spark, folder, "frameinstances")
    got = skew.per_key_results(rows, fold("lu_lemma"), fold_term("frame_label"), F.col("global_id"))
    return got.select(F.col("key").alias("lu_lemma"), "n_rows", "n_labels", F.col("n_records").alias("n_instances"), "is_large")


@query
def p7_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """For every lemma the rows that carry its most frequent label: instances joined to their lemma's label without skew."""
    rows = table(spark, folder, "frameinstances").select("id", fold("lu_lemma").alias("lu_lemma"), fold_term("frame_label").alias("label"))
    known = rows.where("lu_lemma is not null and label is not null")
    counts = known.groupBy("lu_lemma", "label").count()
    top = counts.groupBy("lu_lemma").agg(F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("top_label"))
    joined = skew.balanced_join(known, top, "lu_lemma", "id")
    return joined.groupBy("lu_lemma").agg(F.first("top_label").alias("top_label"), F.count_if(F.col("label") == F.col("top_label")).alias("n_agree"), F.count("*").alias("n_labelled"))


# -- views and table functions


def _in_train(spark: SparkSession, folder: str) -> DataFrame:
    return views.in_splits(tables.splits(spark, folder), tables.instances(spark, folder), 1, ["train", "dev"])


@query
def instances_in_splits(spark: SparkSession, folder: str) -> DataFrame:
    return views.instances_in_splits(tables.splits(spark, folder), tables.instances(spark, folder), table(spark, folder, "datasetsplits"), table(spark, folder, "datasets"))


@query
def labels_of_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return views.labels_of_dataset(tables.instances(spark, folder), 1)


@query
def labels_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    return views.labels_of_splits(tables.splits(spark, folder), tables.instances(spark, folder), 1, ["train", "dev"])


@query
def known_labels(spark: SparkSession, folder: str) -> DataFrame:
    return views.known_labels(tables.clustering(spark), 1, tables.splits(spark, folder), tables.instances(spark, folder))


@query
def lemma_groups(spark: SparkSession, folder: str) -> DataFrame:
    return views.lemma_groups(_in_train(spark, folder), 5)


@query
def filtered_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """One test split: only groups of 3 to 100 of its rows count."""
    return views.filtered_lemmas(_in_train(spark, folder), ["dev"], 3, 100)


@query
def filtered_lemmas_two_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Two test splits: each split differs from one of them, so all count."""
    return views.filtered_lemmas(_in_train(spark, folder), ["dev", "test"], 3, 100)


@query
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return views.cluster_sizes(tables.assignments(spark, folder), tables.clusters(spark, folder))


@query
def cluster_sizes_by_transitive_label(spark: SparkSession, folder: str) -> DataFrame:
    return views.cluster_sizes_by_transitive_label(tables.assignments(spark, folder), tables.clusters(spark, folder))


@query
def merged_clusters(spark: SparkSession, folder: str) -> DataFrame:
    clusters, _ = pipeline.merge_clusters(tables.assignments(spark, folder), tables.clusters(spark, folder))
    return clusters.select("clusteringid", "transitive_label", "isknown", "numelems", "n_parts")


@query
def usable_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Known clusters, and unknown ones of 2 to 10 members."""
    return views.usable_clusters(tables.clusters(spark, folder), 2, 10).select("label", "isknown", "numelems")


@query
def instance_assignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.instance_assignments(tables.splits(spark, folder), tables.instances(spark, folder), table(spark, folder, "datasetsplits"), table(spark, folder, "datasets"), tables.assignments(spark, folder), tables.clusters(spark, folder), tables.clustering(spark))
    return rows.select("instance_id", "dataset_name", "datasetsplit_name", "split", "clusterlabel", "tclusterlabel", "clusteringtype", "global_id")


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return views.evaluation_table_of(tables.clustering(spark), 1, tables.splits(spark, folder), tables.instances(spark, folder), tables.assignments(spark, folder), tables.clusters(spark, folder))


@query
def evaluation_table(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluation(spark, folder)


@query
def unassigned_instances(spark: SparkSession, folder: str) -> DataFrame:
    return views.unassigned(_evaluation(spark, folder))


@query
def delete_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and assignments that are left, cluster by cluster, after the first of two clusterings went."""
    _, _, clusters, kept = views.delete_clustering(1, *tables.two_clusterings(spark, folder))
    n = kept.groupBy(F.col("clusterid").alias("id")).agg(F.count("*").alias("n_assignments"))
    return clusters.join(n, "id", "left").select("id", "clusteringid", "label", "numelems", "n_assignments")


@query
def scored_clusterings(spark: SparkSession, folder: str) -> DataFrame:
    got = views.scored_clusterings(tables.clusterings(spark, folder), table(spark, folder, "datasetsplits"))
    return got.select("cid", "micro_f1__novelty_frame", "clusterer", "type", "local_clusterer", "datasetsplit", "numclusters", "numclusters_local", "duration", "local_cid")


@query
def scores_for_test_splits(spark: SparkSession, folder: str) -> DataFrame:
    scored = views.scored_clusterings(tables.clusterings(spark, folder), table(spark, folder, "datasetsplits"))
    return views.scores_for(scored, "salsa2.0-default", ["test"]).select("cid", "micro_f1__novelty_frame")


@query
def experiment_scores_view(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "experiment_scores").where("experiment_id is not null")
    names = runs.groupBy(F.col("experiment_id").alias("id")).agg(F.min("name").alias("name"))
    one = runs.select(F.col("experiment_run_id").alias("id"), "experiment_id", "clustering_id", "status").distinct()
    scored = views.scored_clusterings(tables.clusterings(spark, folder), table(spark, folder, "datasetsplits"))
    return views.experiment_scores(names, one, scored).select("experiment_id", "name", "experiment_run_id", "status", "clustering_id", "micro_f1__novelty_frame", "clusterer", "numclusters_local")


@query
def sentence_matches(spark: SparkSession, folder: str) -> DataFrame:
    return views.sentence_matches(table(spark, folder, "frameinstances"), "%director%the%near%", 2).select("id", "global_id")


@query
def differs_from_any(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.splits(spark, folder)
    one, two = arrays.differs_from_any("split", ["test"]), arrays.differs_from_any("split", ["test", "dev"])
    return rows.groupBy("split").agg(F.count_if(one).alias("n_one"), F.count_if(two).alias("n_two"), F.count_if(arrays.any_of("split", ["test", "dev"])).alias("n_any"))


@query
def lockstep_unnest(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and target indexes of each sentence unnested side by side, the shorter padded with null."""
    rows = table(spark, folder, "frameinstances").select("id", F.col("extrainfo.tokens").alias("tokens"), F.col("extrainfo.lu_index").alias("lu_index")).where("tokens is not null")
    out = arrays.unnest_lockstep(rows, token="tokens", target="lu_index")
    return out.groupBy("id").agg(F.count("*").alias("n"), F.count("token").alias("n_tokens"), F.count("target").alias("n_targets"))


@query
def label_members_of_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return views.members_of_dataset(tables.instances(spark, folder), 1)


@query
def label_members_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    return views.members_of_splits(tables.splits(spark, folder), tables.instances(spark, folder), 1, ["train", "dev"])


@query
def lemma_group_members(spark: SparkSession, folder: str) -> DataFrame:
    return views.members_of_lemmas(_in_train(spark, folder), 5)


@query
def cluster_members(spark: SparkSession, folder: str) -> DataFrame:
    return views.cluster_members(tables.assignments(spark, folder), tables.clusters(spark, folder))


@query
def clusters_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with how many vectors their mean is of, null where no member has one."""
    rows = tables.assignments(spark, folder).join(tables.vectors(spark, folder, "unmasked").withColumnRenamed("key", "instanceid"), "instanceid")
    means = similarity.centroids(rows, ["clusterid"], "embedding", tables.DIM)
    got = views.clusters_with_vectors(tables.clusters(spark, folder), means)
    return got.select("id", "numelems", "numaveraged", F.round(F.get("embedding", F.lit(0)), 6).alias("first_entry"))


@query
def all_instances_with_assignment(spark: SparkSession, folder: str) -> DataFrame:
    got = views.assigned_or_not(tables.instances(spark, folder), tables.assignments(spark, folder), tables.clusters(spark, folder), 1)
    return got.select("id", "global_id", "clusterid", "transitive_label")


@query
def delete_all_clusterings(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and assignments that are left when all clusterings of the table go and one that isn't in it stays: counts by clustering."""
    clusterings, clusters, assignments = tables.two_clusterings(spark, folder)
    gone, rest, clusters, kept = views.delete_all_clusterings(clusterings.where("id = 1"), clusters, assignments)
    n = kept.join(clusters.select(F.col("id").alias("clusterid"), "clusteringid"), "clusterid").groupBy("clusteringid").agg(F.count("*").alias("n_assignments"))
    return clusters.groupBy("clusteringid").agg(F.count("*").alias("n_clusters")).join(n, "clusteringid")


@query
def delete_experiment(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every experiment that are left after two experiments went, those of none included."""
    left = views.delete_experiments(table(spark, folder, "experiment_scores"), [1003, 1055])
    return left.groupBy("experiment_id").agg(F.count("*").alias("n"))


@query
def delete_all_experiments(spark: SparkSession, folder: str) -> DataFrame:
    return views.delete_experiments(table(spark, folder, "experiment_scores")).select("experiment_run_id", "reported_at")


@query
def copied_experiment(spark: SparkSession, folder: str) -> DataFrame:
    return views.copy_experiment(table(spark, folder, "experiment_scores"), 1003, 9000)


@query
def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.list_datasets(table(spark, folder, "datasets"), table(spark, folder, "datasetsplits"), tables.splits(spark, folder))


@query
def list_experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Every experiment with its name, its runs and the time of its last report."""
    runs = table(spark, folder, "experiment_scores").where("experiment_id is not null")
    return runs.groupBy("experiment_id").agg(F.min("name").alias("name"), F.count_distinct("experiment_run_id").alias("n_runs"), times.to_char(F.max("reported_at")).alias("last_report"))


# -- evaluation: the lemma's most frequent training label as prediction


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows of the first split assignment with their label and their lemma's most frequent training label."""
    rows = views.in_splits(tables.splits(spark, folder), tables.instances(spark, folder), 1, ["train", "dev", "test"]).where((F.col("frame_label") != UNKNOWN) & F.col("lu_lemma").isNotNull())
    counts = rows.where("split = 'train'").groupBy("lu_lemma", "frame_label").count()
    top = counts.groupBy("lu_lemma").agg(F.min_by("frame_label", F.struct(-F.col("count"), F.col("frame_label"))).alias("predicted"))
    test = rows.where("split <> 'train'").join(top, "lu_lemma", "left")
    return test.select("instance_id", "lu_lemma", F.col("frame_label").alias("gold"), F.coalesce("predicted", F.concat(F.lit("new::"), "lu_lemma")).alias("predicted"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return views.in_splits(tables.splits(spark, folder), tables.instances(spark, folder), 1, ["train"]).where(F.col("frame_label") != UNKNOWN).select(F.col("frame_label").alias("label")).distinct()


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.classification_report(_predicted(spark, folder), "gold", "predicted"))


@query
def classification_averages(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.averages(_predicted(spark, folder), "gold", "predicted"))


@query
def novelty_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.novelty_detection(_predicted(spark, folder), "gold", "predicted", _known(spark, folder)))


@query
def known_label_identification(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.known_label_identification(_predicted(spark, folder), "gold", "predicted", _known(spark, folder)))


@query
def novelty_and_label_identification(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.novelty_and_label_identification(_predicted(spark, folder), "gold", "predicted", _known(spark, folder)))


@query
def majority_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.majority_fallback(_predicted(spark, folder), "predicted", _known(spark, folder)).groupBy("predicted").agg(F.count("*").alias("n"))


@query
def induction_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.induction_scores(_predicted(spark, folder), "gold", "predicted"))


@query
def unknown_induction_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.unknown_induction_scores(_predicted(spark, folder), "gold", "predicted", _known(spark, folder)))


@query
def label_set_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.label_set_sizes(_predicted(spark, folder), "gold", "predicted", _known(spark, folder))


@query
def evaluation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics of an evaluated clustering but the silhouette, which needs vectors."""
    return _rounded(evaluation.metrics(_predicted(spark, folder), "gold", "predicted", _known(spark, folder)).drop("silhouette"))


# -- vectors


@query
def mixed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    mixed = similarity.mixed_vectors(tables.vectors(spark, folder, "unmasked"), tables.vectors(spark, folder, "masked"), "0.3")
    return mixed.select("key", F.posexplode("vector").alias("i", "x")).select("key", "i", F.round("x", 6).alias("x"))


@query
def blended_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The same weights without normalising: length and first entry."""
    mixed = similarity.blended_vectors(tables.vectors(spark, folder, "unmasked"), tables.vectors(spark, folder, "masked"), 0.3)
    return mixed.select("key", vectors.dims("vector").alias("dims"), F.round(vectors.norm("vector"), 6).alias("length"))


@query
def cosine_to_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each instance's two vectors."""
    b = tables.vectors(spark, folder, "masked").withColumnRenamed("embedding", "m")
    return tables.vectors(spark, folder, "unmasked").join(b, "key").select("key", F.round(vectors.cosine("embedding", "m"), 6).alias("cosine"))


@query
def centroids(spark: SparkSession, folder: str) -> DataFrame:
    got = similarity.centroids(table(spark, folder, "embeddings"), ["label"], "embedding", 64)
    return got.select("label", "numaveraged", F.posexplode("embedding").alias("i", "x")).select("label", "numaveraged", "i", F.round("x", 6).alias("x"))


@query
def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar label centroid of every vector."""
    rows = table(spark, folder, "embeddings")
    means = similarity.centroids(rows, ["label"], "embedding", 64).withColumnRenamed("embedding", "mean")
    got = similarity.nearest(rows, means, "vec_id", "label", "embedding", "mean")
    return got.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@query
def similar_pairs_of_lemma(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a lemma's vectors with a cosine of at least 0.9."""
    rows = tables.vectors(spark, folder, "unmasked").join(tables.instances(spark, folder).select(F.col("id").alias("key"), "lu_lemma"), "key")
    got = similarity.similar_pairs(rows, "lu_lemma", "key", "embedding", 0.9)
    return got.select(F.col("grp").alias("lu_lemma"), "a", "b", F.round("cosine", 6).alias("cosine"))


@query
def silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    got = similarity.silhouettes(table(spark, folder, "embeddings"), "vec_id", "label", "embedding", 64)
    return got.select("vec_id", "label", F.round("silhouette", 6).alias("silhouette"))


def clustering_rows(spark: SparkSession, folder: str, alpha: float | str) -> DataFrame:
    """Instances with both vectors, mixed with that weight, in the default splits of their datasets: what :func:`pipeline.two_step` takes."""
    mixed = similarity.mixed_vectors(tables.vectors(spark, folder, "unmasked"), tables.vectors(spark, folder, "masked"), alpha)
    split = tables.splits(spark, folder).where("datasetsplit_id <= 3").groupBy(F.col("instance_id").alias("key")).agg(F.min("split").alias("split"))
    rows = tables.instances(spark, folder).select(F.col("id").alias("key"), "lu_lemma", F.coalesce("frame_label", F.lit(UNKNOWN)).alias("label"))
    return mixed.join(split, "key").join(rows, "key").select(F.col("key").alias("instance_id"), "lu_lemma", "split", "label", "vector")


@query
def two_step_clustering(spark: SparkSession, folder: str, config: dict | None = None) -> DataFrame:
    """The two-step clustering of all instances with both vectors, in the default splits of their datasets."""
    config = experiments.with_defaults(config or {"data": {"testsplits": ["dev", "test"]}, "local": {"clusterer": {"type": "cw", "min_weight": 0.5, "random_state": 1}}})
    return pipeline.two_step(clustering_rows(spark, folder, config["local"]["alpha"]), config, config["data"]["testsplits"])


@query
def two_step_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any two-step clustering: rows, training rows with a label, those of them whose cluster is called otherwise, and test rows in no cluster."""
    rows = two_step_clustering(spark, folder)
    labelled = (F.col("split") == "train") & (F.col("label_true") != UNKNOWN)
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(labelled).alias("n_labelled"), F.count_if(labelled & F.col("lu_lemma").isNotNull() & ~F.col("cluster_label").eqNullSafe(F.col("label_true"))).alias("moved"),
        F.count_if((F.col("split") != "train") & F.col("cluster_label").isNull()).alias("unassigned"),
    )


# -- experiments


@query
def run_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of each experiment ranked by score and by number of clusters, then by the average of both ranks: the best ten."""
    runs = table(spark, folder, "experiment_scores").where("experiment_id is not null").groupBy("experiment_id", "experiment_run_id").agg(F.max(F.nanvl("micro_f1__novelty_frame", F.lit(None).cast("double"))).alias("score"), F.max("numclusters").cast("double").alias("clusters"))
    return leaderboard.leaderboard(runs, "experiment_id", "experiment_run_id", ["score", "clusters"], 10)


@query
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(leaderboard.summary(table(spark, folder, "experiment_scores"), "clusterer", "clustering_duration"), 6)


@query
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.status_counts(table(spark, folder, "experiment_scores"), "name")


@query
def latest_finished_run(spark: SparkSession, folder: str) -> DataFrame:
    """Of every clustering identity (split and clusterer) the finished run reported last."""
    runs = table(spark, folder, "experiment_scores").select(F.concat_ws("/", "datasetsplit", "clusterer").alias("identity"), "reported_at", (F.col("status") == "finished").alias("ok"), "experiment_run_id")
    return leaderboard.latest_successful(runs, "identity", "reported_at", "ok").select("identity", "experiment_run_id")


@query
def scores_by_setting(spark: SparkSession, folder: str) -> DataFrame:
    """Runs and mean score by the settings stored as JSON."""
    v = F.parse_json("setting")
    rows = table(spark, folder, "experiment_scores").where("setting is not null").select(F.try_variant_get(v, "$.alpha", "double").alias("alpha"), F.try_variant_get(v, "$.seed", "int").alias("seed"), F.nanvl("micro_f1__novelty_frame", F.lit(None).cast("double")).alias("s"))
    return rows.groupBy("alpha", "seed").agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("mean"))


@query
def best_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Of every experiment the weight with the best mean score over seeds."""
    runs = table(spark, folder, "experiment_scores").withColumn("alpha", F.try_variant_get(F.parse_json("setting"), "$.alpha", "double"))
    return _rounded(leaderboard.best_settings(runs, "experiment_id", "alpha", "micro_f1__novelty_frame"))


@query
def merged_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Settings overlaid by others and with a key set: how often each result occurs."""
    rows = table(spark, folder, "experiment_scores").where("setting is not null").select(json.set_key(json.merge("setting", F.lit('{"seed":0,"note":"again"}')), "dim", F.lit(64)).alias("s"))
    v = F.parse_json("s")
    got = rows.select(F.try_variant_get(v, "$.alpha", "double").alias("alpha"), F.try_variant_get(v, "$.seed", "int").alias("seed"), F.try_variant_get(v, "$.note", "string").alias("note"), F.try_variant_get(v, "$.dim", "int").alias("dim"))
    return got.groupBy("alpha", "seed", "note", "dim").agg(F.count("*").alias("n"))


@query
def split_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Splits of all runs written as a JSON array with one appended, and unnested again: how often each occurs."""
    rows = table(spark, folder, "experiment_scores").select(F.explode(json.texts(F.to_json(arrays.appended("splits", "all")))).alias("split"))
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query
def experiment_ages(spark: SparkSession, folder: str) -> DataFrame:
    """How long every experiment went on, from its first to its last report."""
    spans = table(spark, folder, "experiment_scores").where("experiment_id is not null").groupBy("experiment_id").agg(F.min("reported_at").alias("a"), F.max("reported_at").alias("b"))
    spans = spans.withColumn("seconds", times.seconds_between("a", "b"))
    return spans.select("experiment_id", times.to_char("a").alias("began"), "seconds", times.age(F.col("seconds")).alias("age"))


@query
def split_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.split_fingerprints(tables.splits(spark, folder), tables.instances(spark, folder), table(spark, folder, "datasetsplits"))


@query
def vector_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.vector_fingerprints(tables.vectors(spark, folder, "unmasked"), tables.splits(spark, folder), tables.instances(spark, folder), table(spark, folder, "datasetsplits"))


@query
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.table_fingerprint(tables.splits(spark, folder), ["datasetsplit_id", "instance_id", "split"])


@query
def group_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.group_fingerprints(tables.instances(spark, folder), "dataset_id", ["global_id", "lu_lemma", "frame_label"])


@query
def label_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of training and test rows: in both, in either, in one only."""
    s, i = tables.splits(spark, folder), tables.instances(spark, folder)
    a = views.in_splits(s, i, 1, ["train"]).select("frame_label").where("frame_label is not null")
    b = views.in_splits(s, i, 1, ["test"]).select("frame_label").where("frame_label is not null")
    return a.union(b).distinct().withColumn("part", F.lit("union")).union(a.intersect(b).withColumn("part", F.lit("both"))).union(a.exceptAll(b).distinct().withColumn("part", F.lit("except_all"))).union(b.subtract(a).withColumn("part", F.lit("test_only")))


@query
def development_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Instances, lexical units and pairs of instances within a unit."""
    rows = tables.instances(spark, folder).where("lu_lemma is not null and frame_label is not null")
    units = rows.groupBy("lu_lemma", "frame_label").agg(F.count_distinct("id").alias("n"))
    return units.agg(F.sum("n").alias("n"), F.count("*").alias("n_units"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))


# -- sources and sinks


@query
def corpus_without_proto_frames(spark: SparkSession, folder: str) -> DataFrame:
    got = corpora.prepare_salsa(table(spark, folder, "salsa"))
    return got.select("i", "frame_id", "split", "fixed_label", "lu_index_part")


@query
def unified_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.unified(corpora.prepare_salsa(table(spark, folder, "salsa")), "salsa2.0").select("i", "lu_lemma", "frame_label", "global_id")


@query
def alternative_split(spark: SparkSession, folder: str) -> DataFrame:
    """Test and dev sources reassigned, all others in training."""
    rows = table(spark, folder, "salsa").select("i", "data_source", "split")
    wide = spark.createDataFrame([("SALSA2-ADD", "dev"), ("SALSA2-WEB", "test")], "data_source string, `0` string")
    return corpora.alternative_split(rows, wide, "0")


@query
def alternative_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Three alternative split assignments at once."""
    wide = spark.createDataFrame([("SALSA2-ADD", "dev", "test", "train"), ("SALSA2-WEB", "test", "dev", "dev")], "data_source string, `0` string, `1` string, `2` string")
    return corpora.alternative_splits(table(spark, folder, "salsa"), wide, "salsa2.0")


@query
def forwarded_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A local step that takes the labels of another clustering: sizes of its clusters."""
    rows = tables.instances(spark, folder).where("lu_lemma is not null").select(F.col("id").alias("instance_id"), "lu_lemma", F.lit(None).cast("string").alias("fixed"))
    other = tables.assignments(spark, folder).select(F.col("instanceid").alias("instance_id"), F.col("clusterid").alias("label"))
    got = pipeline.local_labels(rows, {"type": "forward", "options": {"source": "by label"}}, {"by label": other})
    return got.groupBy("label").agg(F.count("*").alias("n"))


@query
def import_new_instances(spark: SparkSession, folder: str) -> DataFrame:
    """An import of all instances into a store that has dataset 1: rows with a new global_id, each once."""
    rows = tables.instances(spark, folder)
    return stores.new_rows(rows, rows.where("dataset_id = 1"), "global_id", "id").select("id", "global_id")


@query
def update_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Labels overlaid by those of later imports of the same instance."""
    rows = tables.instances(spark, folder)
    first = rows.groupBy("global_id").agg(F.min_by("frame_label", "id").alias("frame_label"), F.min("id").alias("id"))
    last = rows.groupBy("global_id").agg(F.max_by("frame_label", "id").alias("frame_label"), F.max("id").alias("id"))
    return stores.overlay(first, last, "global_id", ["frame_label", "id"])


@query
def missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Instances without a usable vector."""
    keys = tables.instances(spark, folder).select(F.col("id").alias("key"))
    return stores.missing(keys, tables.vectors(spark, folder, "unmasked"), "key")


@query
def copied_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Masked vectors copied to the first import of the same instance, found through global_id; lengths of the copies."""
    rows = tables.instances(spark, folder)
    target = rows.groupBy("global_id").agg(F.min("id").alias("id"))
    got = stores.copy_by_global_id(tables.vectors(spark, folder, "masked"), rows, target)
    return got.select("key", F.round(vectors.norm("embedding"), 5).alias("length"))


@query
def instances_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Instances with the dimensions of both vectors, null where there is none."""
    keys = tables.instances(spark, folder).select(F.col("id").alias("key"), "global_id")
    got = stores.with_vectors(keys, {"unmasked": tables.vectors(spark, folder, "unmasked"), "masked": tables.vectors(spark, folder, "masked")})
    return got.select("key", "global_id", F.when(F.col("unmasked").isNotNull(), F.size("unmasked")).alias("dim_unmasked"), F.when(F.col("masked").isNotNull(), F.size("masked")).alias("dim_masked"))


@query
def extracted_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the target words of all sentences by the hash encoder, with the target masked; their lengths."""
    rows = table(spark, folder, "frameinstances").select("id", "extrainfo.tokens", "extrainfo.lu_index", "extrainfo.lu_index_part")
    got = encoders.extract(rows, encoders.hash_encoder(), masked=True)
    return got.select("key", vectors.dims("embedding").alias("dims"), F.round(vectors.norm("embedding"), 4).alias("length"))


@query
def masked_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "frameinstances").select("id", "extrainfo.tokens", "extrainfo.lu_index").where("tokens is not null and lu_index is not null")
    return rows.select("id", F.array_join(encoders.masked_tokens("tokens", "lu_index"), " ", "*").alias("sentence"))


@query
def sampled_silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    """Mean silhouette of three samples of a hundred vectors: sampling is what this operator does."""
    return _rounded(similarity.sampled_silhouettes(table(spark, folder, "embeddings"), "vec_id", "label", "embedding", 64, 100, 3))


@query
def merge_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The tenth largest distance between label centroids."""
    means = similarity.centroids(table(spark, folder, "embeddings"), ["label"], "embedding", 64)
    return _rounded(similarity.kth_largest_distance(means, "label", "embedding", 10), 6)


@query
def vector_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return stores.count_and_dims(stores.open_store(spark, f"model:{folder}/instance_vectors.parquet?masking=unmasked"))


@query
def events_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type in windows of a day: the batch form of the windowed stream."""
    return imports.windowed_counts(table(spark, folder, "events"), "ts", "event_type", "1 day")
