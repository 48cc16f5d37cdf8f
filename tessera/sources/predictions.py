"""Labels predicted elsewhere, matched to instances by the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.corpora import prediction_key

UNKNOWN_TOKEN = "[UNK]"


def read_predictions(spark, path: str) -> DataFrame:
    """``tokens, lu_index, predicted`` from blocks of ``index, form, ..., frame, tag`` lines (plain or gzip); the target is the row whose frame isn't ``_``."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    cells = F.transform(F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#")), lambda x: F.split(x, "\t"))
    frame = lambda c: F.get(c, F.size(c) - 2)
    out = raw.select(cells.alias("cells")).select(
        F.transform("cells", lambda c: F.get(c, F.lit(1))).alias("tokens"),
        F.filter(F.transform("cells", lambda c, i: F.when(frame(c) != "_", i)), lambda i: i.isNotNull()).alias("lu_index"),
        F.get(F.filter(F.transform("cells", frame), lambda f: f != "_"), F.lit(0)).alias("predicted"),
    )
    return out.where("predicted is not null")


def match(instances: DataFrame, predictions: DataFrame, label_map: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """``id, label, matched_by`` of every instance (``id, tokens, lu_index``).

    First by tokens and target positions; then by target positions where the prediction has unknown tokens and all its other tokens agree; else the default.
    Labels are renamed by the map (``predicted, label``). Of several predictions for one instance the smallest label is taken; an instance without tokens gets the default.
    """
    inst = instances.select("id", "tokens", "lu_index").withColumn("k", prediction_key(F.col("tokens"), F.col("lu_index")))
    pred = predictions.select("tokens", "lu_index", "predicted").withColumn("k", prediction_key(F.col("tokens"), F.col("lu_index")))
    exact = inst.join(pred.groupBy("k").agg(F.min("predicted").alias("exact")), "k", "left")
    blurred = pred.where(F.array_contains("tokens", UNKNOWN_TOKEN)).select(F.col("tokens").alias("pt"), F.col("lu_index").alias("pi"), "predicted")
    rest = exact.where("exact is null and tokens is not null")
    agrees = F.forall(F.zip_with("tokens", "pt", lambda a, b: (b == UNKNOWN_TOKEN) | (F.lower(a) == F.lower(b))), lambda x: x)
    same = (F.size("tokens") == F.size("pt")) & F.col("lu_index").eqNullSafe(F.col("pi"))
    near = rest.join(blurred, same & agrees).groupBy("id").agg(F.min("predicted").alias("near"))
    out = exact.join(near, "id", "left").select("id", F.coalesce("exact", "near").alias("predicted"), F.when(F.col("exact").isNotNull(), "text").when(F.col("near").isNotNull(), "unknown tokens").otherwise("default").alias("matched_by"))
    if label_map is not None:
        out = out.join(label_map.groupBy("predicted").agg(F.min("label").alias("label")), "predicted", "left").withColumn("label", F.coalesce("label", "predicted"))
    else:
        out = out.withColumn("label", F.col("predicted"))
    return out.select("id", F.coalesce("label", F.lit(default)).alias("label"), "matched_by")
