"""Scores of a labelling against a gold labelling, as aggregations over the contingency table.

Input rows are one for each instance with a gold and a predicted label. The contingency table (gold, predicted, n) is built once by
a map-side combined count; everything else works on it. Rows with a null in either label are left out. A precision or recall without
a denominator is 0. An empty table gives no rows from per-label reports and nulls from single scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``gold, predicted, n``."""
    rows = rows.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull())
    return rows.groupBy(F.col(gold).cast("string").alias("gold"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def label_counts(table: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``label, tp, n_predicted, n_gold`` of every label of the gold or the predicted side, or of ``labels`` (label) if given."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(zero)
    gold = table.select(F.col("gold").alias("label"), hit.alias("tp"), zero.alias("p"), F.col("n").alias("g"))
    pred = table.select(F.col("predicted").alias("label"), zero.alias("tp"), F.col("n").alias("p"), zero.alias("g"))
    counts = gold.union(pred).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_predicted"), F.sum("g").alias("n_gold"))
    if labels is None:
        return counts
    return labels.select("label").distinct().join(counts, "label", "left").na.fill(0, ["tp", "n_predicted", "n_gold"])


def classification_report(rows: DataFrame, gold: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    """``label, precision, recall, f1, support`` for each label."""
    c = label_counts(contingency(rows, gold, predicted), labels)
    p, r = _ratio(F.col("tp"), F.col("n_predicted")), _ratio(F.col("tp"), F.col("n_gold"))
    return c.select("label", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("n_gold").alias("support"))


def averages(rows: DataFrame, gold: str, predicted: str, labels: DataFrame | None = None) -> DataFrame:
    """``average, precision, recall, f1, support`` for micro, macro and weighted; macro divides by all listed labels, those that don't occur included."""
    c = label_counts(contingency(rows, gold, predicted), labels)
    p, r = _ratio(F.col("tp"), F.col("n_predicted")), _ratio(F.col("tp"), F.col("n_gold"))
    c = c.select("*", p.alias("p"), r.alias("r"), _f1(p, r).alias("f"))
    s = c.agg(*[F.sum(x).alias(x) for x in ("tp", "n_predicted", "n_gold")], *[F.avg(x).alias(f"m{x}") for x in "prf"], *[F.sum(F.col(x) * F.col("n_gold")).alias(f"w{x}") for x in "prf"]).where("tp is not null")
    mp, mr = _ratio(F.col("tp"), F.col("n_predicted")), _ratio(F.col("tp"), F.col("n_gold"))
    row = lambda name, a, b, f: F.struct(F.lit(name).alias("average"), a.alias("precision"), b.alias("recall"), f.alias("f1"), F.col("n_gold").alias("support"))
    return s.select(F.explode(F.array(row("micro", mp, mr, _f1(mp, mr)), row("macro", F.col("mp"), F.col("mr"), F.col("mf")), row("weighted", *[_ratio(F.col(f"w{x}"), F.col("n_gold")) for x in "prf"]))).alias("r")).select("r.*")


def with_known(rows: DataFrame, gold: str, predicted: str, known: DataFrame) -> DataFrame:
    """``gold, predicted, gold_known, predicted_known``; ``known`` has the known labels in ``label``."""
    k = known.select("label").where("label is not null").distinct()
    a = k.select(F.col("label").alias("gold"), F.lit(True).alias("gold_known"))
    b = k.select(F.col("label").alias("predicted"), F.lit(True).alias("predicted_known"))
    # labels are joined to the contingency table, which has a row for each pair of labels only
    table = contingency(rows, gold, predicted).join(a, "gold", "left").join(b, "predicted", "left")
    return table.na.fill(False, ["gold_known", "predicted_known"])


def _expand(table: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    return table.groupBy(gold.alias("gold"), predicted.alias("predicted")).agg(F.sum("n").alias("n"))


def _report_of(table: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    c = label_counts(table, labels)
    p, r = _ratio(F.col("tp"), F.col("n_predicted")), _ratio(F.col("tp"), F.col("n_gold"))
    return c.select("label", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("n_gold").alias("support"))


def novelty_detection(rows: DataFrame, gold: str, predicted: str, known: DataFrame) -> DataFrame:
    """Report for ``known`` against ``novel``: is an instance with a new label recognised as one."""
    name = lambda c: F.when(F.col(c), "known").otherwise("novel")
    return _report_of(_expand(with_known(rows, gold, predicted, known), name("gold_known"), name("predicted_known")))


def known_label_identification(rows: DataFrame, gold: str, predicted: str, known: DataFrame) -> DataFrame:
    """Report over instances whose gold label is known, for the labels that occur in gold."""
    table = with_known(rows, gold, predicted, known).where("gold_known").select("gold", "predicted", "n")
    return _report_of(table).where("support > 0")


def novelty_and_label_identification(rows: DataFrame, gold: str, predicted: str, known: DataFrame, outlier: str = "outlier") -> DataFrame:
    """Report over the known labels and one more for all new ones, on both sides."""
    name = lambda c, k: F.when(F.col(k), F.col(c)).otherwise(outlier)
    table = _expand(with_known(rows, gold, predicted, known), name("gold", "gold_known"), name("predicted", "predicted_known"))
    labels = known.select("label").where("label is not null").union(known.sparkSession.createDataFrame([(outlier,)], "label string"))
    return _report_of(table, labels)


def majority_fallback(rows: DataFrame, predicted: str, known: DataFrame) -> DataFrame:
    """``rows`` with a prediction that isn't a known label replaced by the most frequent known prediction, of equal ones the smallest."""
    k = known.select(F.col("label").alias(predicted)).where(F.col(predicted).isNotNull()).distinct()
    counts = rows.groupBy(predicted).agg(F.count("*").alias("n")).join(k, predicted)
    best = counts.agg(F.min_by(predicted, F.struct(-F.col("n"), F.col(predicted))))
    marked = rows.join(k.withColumn("_known", F.lit(True)), predicted, "left")
    return marked.withColumn(predicted, F.when(F.col("_known"), F.col(predicted)).otherwise(best.scalar())).drop("_known")


def induction_scores(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: purity, inverse purity and their F1, B-cubed precision, recall and F1, and the Fowlkes-Mallows index."""
    return _induction_of(contingency(rows, gold, predicted))


def unknown_induction_scores(rows: DataFrame, gold: str, predicted: str, known: DataFrame) -> DataFrame:
    """The same over instances whose gold label isn't known."""
    return _induction_of(with_known(rows, gold, predicted, known).where("not gold_known").select("gold", "predicted", "n"))


def _induction_of(table: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    # sums by cluster and by class; a row for each pair of labels, so windows here are over labels and not over instances
    t = table.withColumn("c", F.sum("n").over(Window.partitionBy("predicted"))).withColumn("g", F.sum("n").over(Window.partitionBy("gold")))
    cells = t.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") / F.col("c")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("g")).alias("br"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    cluster = table.groupBy("predicted").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg(F.sum("m").alias("best_c"), F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("pairs_c"))
    klass = table.groupBy("gold").agg(F.max("n").alias("m"), F.sum("n").alias("s")).agg(F.sum("m").alias("best_g"), F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("pairs_g"))
    one = cells.select("*", F.lit(1).alias("_1")).join(cluster.select("*", F.lit(1).alias("_1")), "_1").join(klass.select("*", F.lit(1).alias("_1")), "_1")
    pu, ipu, bp, br = (F.try_divide(F.col(c), F.col("total")) for c in ("best_c", "best_g", "bp", "br"))
    f1 = lambda a, b: F.try_divide(2 * a * b, a + b)
    fmi = F.try_divide(F.col("pairs"), F.sqrt(F.col("pairs_c") * F.col("pairs_g")))
    return one.select(pu.alias("purity"), ipu.alias("inverse_purity"), f1(pu, ipu).alias("purity_f1"), bp.alias("bcubed_precision"), br.alias("bcubed_recall"), f1(bp, br).alias("bcubed_f1"), F.coalesce(fmi, F.lit(0.0)).alias("fmi"))


def label_set_sizes(rows: DataFrame, gold: str, predicted: str, known: DataFrame) -> DataFrame:
    """One row: how many different labels are gold, predicted, known, and in their unions, intersections and differences."""
    k = known.select("label").where("label is not null").distinct().withColumn("k", F.lit(True))
    g = rows.select(F.col(gold).cast("string").alias("label")).where("label is not null").distinct().withColumn("g", F.lit(True))
    p = rows.select(F.col(predicted).cast("string").alias("label")).where("label is not null").distinct().withColumn("p", F.lit(True))
    every = g.join(p, "label", "full").join(k, "label", "full").na.fill(False, ["g", "p", "k"])
    return every.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("n_gold", "g"), ("n_predicted", "p"), ("n_known", "k"), ("n_any", "g or p"), ("n_both", "g and p"), ("n_gold_only", "g and not p"), ("n_predicted_only", "p and not g"), ("n_gold_known", "g and k"), ("n_gold_new", "g and not k"), ("n_predicted_known", "p and k"))])


#: Metrics of an evaluated clustering, by name.
METRICS = ("micro_f1", "precision", "recall", "macro_f1", "purity", "inverse_purity", "purity_f1", "bcubed_precision", "bcubed_recall", "bcubed_f1", "silhouette")


def metrics(rows: DataFrame, gold: str, predicted: str, known: DataFrame, silhouettes: DataFrame | None = None) -> DataFrame:
    """One row with all of ``METRICS``: of known and new labels the micro F1 and the macro averages, of all labels purity and B-cubed scores, and the mean silhouette.

    ``silhouettes`` has a column ``silhouette``; without it, and where there is nothing to divide by, a metric is null.
    """
    told = novelty_and_label_identification(rows, gold, predicted, known)
    one = told.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("micro_f1"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("macro_f1"))
    mean = F.lit(None).cast("double") if silhouettes is None else silhouettes.agg(F.avg("silhouette")).scalar()
    return one.crossJoin(induction_scores(rows, gold, predicted).drop("fmi")).withColumn("silhouette", mean).select(*METRICS)
