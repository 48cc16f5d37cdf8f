"""Queries of this subpackage: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.llm import _ivf, _tokens, abuse, group_splits, mixing, nearest_vectors, packing, similarity_clusters, split_overlap, term_frequency, topn_groups
from tessera.storage import materialize, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_clusters.mutual_clusters(table(spark, folder, "instance_vectors"), table(spark, folder, "frameinstances"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_clusters.describe_clusters(table(spark, folder, "instance_vectors"), table(spark, folder, "frameinstances"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "experiment_scores")
    best = topn_groups.top_n(runs, "experiment_id", "experiment_run_id", "micro_f1__novelty_frame", 5, version="reported_at")
    return best.select(F.col("grp").alias("experiment_id"), F.col("item").alias("experiment_run_id"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors.close_neighbour_pairs(table(spark, folder, "instance_vectors"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar of every key divisible by 20, whatever their similarity."""
    usable = _ivf.usable_vectors(table(spark, folder, "instance_vectors"))
    # neighbours of low similarity may be in any list, so all are searched
    near = nearest_vectors.nearest(usable, 5, probes=None, margin=9.0, every=20)
    return near.withColumn("similarity", F.round("similarity", 6))


def p4_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its counts and mark."""
    return term_frequency.marked_terms(table(spark, folder, "frameinstances"), ["frame_label", "lu_lemma"], "global_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_terms(spark, folder).where("mark is not null").select("field_name", "term", "mark")


def _overlaps(spark: SparkSession, folder: str) -> split_overlap.Overlaps:
    """Sentences with the split their instances have in the default split of their dataset."""
    rows = table(spark, folder, "salsa").select(fold("global_sentence_id").alias("id"), "tokenized_sentence", fold("data_source").alias("source"), "instance_id").where("id is not null")
    splits = table(spark, folder, "split_instances").where("datasetsplit_id = 1").groupBy("instance_id").agg(F.max(fold("split")).alias("split"))
    # rows without an instance take no part in the join: their nulls would all meet in one task
    known = rows.where("instance_id is not null").select("id", "instance_id").distinct().join(splits, "instance_id").groupBy("id").agg(F.max("split").alias("split"))
    texts = rows.groupBy("id").agg(F.max("tokenized_sentence").alias("text"), F.collect_set("source").alias("sources")).join(known, "id")
    return split_overlap.Overlaps(texts.select("id", "text", "split", F.explode_outer("sources").alias("source")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).pairs().select(F.col("id_a").alias("sentence_a"), F.col("id_b").alias("sentence_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping sentences of dev and test by split and data source."""
    return _overlaps(spark, folder).report()


_SPLITS = {"train": 0.7, "dev": 0.1, "test": 0.2}


def _sentences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(Cells of sentence, data source and old split with their rows; the component of each sentence). Sentences of the same text are one component."""
    rows = table(spark, folder, "salsa").select(fold("global_sentence_id").alias("sentence"), fold("data_source").alias("source"), fold("split").alias("old"), F.md5(fold("tokenized_sentence")).alias("text")).where("sentence is not null")
    cells = materialize(rows.groupBy("sentence", "source", "old").agg(F.count("*").alias("n"), F.max("text").alias("text")), "sentences")
    texts = cells.groupBy("sentence").agg(F.max("text").alias("text"))
    return cells, group_splits.components(texts.withColumn("id", F.col("sentence")), "id", ["sentence", "text"])


def _assigned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(Sentences with their component and old splits; components with their new split.)"""
    cells, comps = _sentences(spark, folder)
    cells = materialize(cells.join(comps.withColumnRenamed("id", "sentence"), "sentence"), "cells")
    got = group_splits.assign(cells, F.col("comp"), F.col("source"), F.col("old"), _SPLITS, n_rows=F.col("n"))
    return cells.groupBy("sentence", "comp").agg(F.sum("n").alias("n_rows"), F.count_distinct("old").alias("n_old_splits")), got


def p6_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence with its rows, the number of splits it is in and the one it should be in."""
    sentences, got = _assigned(spark, folder)
    return sentences.join(got.select("comp", "split"), "comp").select(F.col("sentence").alias("global_sentence_id"), "n_rows", "n_old_splits", "split")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_assignment(spark, folder).where("n_old_splits >= 2").select("global_sentence_id")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and shares that the new splits reach, of all rows and of each data source."""
    return group_splits.report(_assigned(spark, folder)[1], _SPLITS)


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the new splits: rows and sentences assigned, sentences and texts that lie in several splits, and whether all shares are within half a percent."""
    sentences, got = _assigned(spark, folder)
    shares = group_splits.report(got, _SPLITS).where("label is null").agg(F.max(F.abs("deviation")).alias("d"))
    rows = table(spark, folder, "salsa").select(fold("global_sentence_id").alias("sentence"), F.md5(fold("tokenized_sentence")).alias("text")).where("sentence is not null")
    rows = rows.join(sentences.join(got.select("comp", "split"), "comp").select("sentence", "split"), "sentence")
    several = lambda c: rows.groupBy(c).agg(F.count_distinct("split").alias("k")).where(F.col(c).isNotNull() & (F.col("k") > 1)).agg(F.count("*")).scalar()
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("sentence").alias("n_sentences")).select("n_rows", "n_sentences", several("sentence").alias("divided_sentences"), several("text").alias("divided_texts"), (shares.scalar() <= 0.005).alias("on_target"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_tokens.token_counts(table(spark, folder, "documents")), 2048)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or of every part of a text above 2,048 tokens."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(_packed(spark, folder), 2048)


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: texts packed, of them divided ones of up to 2,048 tokens, texts with tokens lost or doubled, containers too full, and whether 0.99 of the space is used."""
    counts = materialize(_tokens.token_counts(table(spark, folder, "documents")), "counts")
    packed = materialize(packing.pack(counts, 2048), "packed")
    of = packed.groupBy("id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("held")).join(counts, "id", "full")
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("load")).where("load > 2048").agg(F.count("*"))
    kept = of.agg(F.count("*").alias("n_texts"), F.count_if(F.expr("n_tokens <= 2048 and parts > 1")).alias("divided"), F.count_if(F.expr("not (held <=> n_tokens)")).alias("changed"))
    return kept.select("*", over.scalar().alias("too_full"), (packing.fill_report(packed, 2048).select("fill").scalar() >= 0.99).alias("filled"))


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    texts = _tokens.token_counts(table(spark, folder, "documents"), extra=["source"])
    return mixing.Mixture(texts, table(spark, folder, "source_targets"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often each text is used."""
    return _mixture(spark, folder).copies.withColumnRenamed("id", "doc_id")


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that every named source reaches."""
    return _mixture(spark, folder).report()


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any mixture: sources that have texts and a target, copies beyond a cap, texts of no target, and whether every share is within half a percent of the whole."""
    mixture = _mixture(spark, folder)
    copies, told = materialize(mixture.copies, "copies"), materialize(mixture.report(), "report")
    named = told.select("source", "max_repeats")
    there = told.where("n_tokens > 0")
    off = F.max(F.abs(F.col("share") - F.col("target_share") / there.agg(F.sum("target_share")).scalar()))
    beyond = copies.join(named, "source").where("copies > max_repeats").agg(F.count("*"))
    strange = copies.join(named, "source", "left_anti").agg(F.count("*"))
    return there.agg(F.count("*").alias("n_sources"), (off <= 0.005).alias("on_target")).select("n_sources", beyond.scalar().alias("beyond_cap"), strange.scalar().alias("of_no_target"), "on_target")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Abusive documents and their rate by source."""
    return abuse.rates(p10_scores(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p3_found, p3_neighbours, p4_found, p4_terms, p5_found, p5_report, p6_found, p6_assignment, p6_report, p6_kept, p8_containers, p8_fill, p8_kept, p9_mixture, p9_report, p9_kept, p10_found, p10_scores, p10_rates)}
