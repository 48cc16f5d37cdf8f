"""Readers of annotated corpora, and the form they are unified to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import UNKNOWN, fold
from tessera.storage import materialize

#: Columns of the block format, in order; a block is a sentence with one target, blocks are separated by blank lines.
BLOCK_FIELDS = ("id", "form", "lemma", "plemma", "pos", "ppos", "feat", "pfeat", "head", "phead", "deprel", "pdeprel", "fillpred_lu", "pred_frame", "apreds")
#: Suffix of frames that were made up for one predicate.
PROTO = "-salsa"


def integers(text: Column) -> Column:
    """Integers of a comma-separated list, written as integers or floats; an empty or null list is empty."""
    t = F.coalesce(F.trim(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(t, ","), lambda x: F.trim(x).cast("double").cast("int")))


def read_tsv(spark: SparkSession, path: str, split: str | None = None, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """The tab-separated corpus: tokens at blanks, indexes as integers, a blank part lemma as ''. Column names come out in lower case.

    With ``split`` all rows get that split. ``rows`` reads so many rows at most.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    if rows is not None:
        raw = raw.limit(rows)
    out = raw.withColumns({"tokenized_sentence": F.split("tokenized_sentence", " "), "lu_index": integers(F.col("lu_index")), "lu_index_part": integers(F.col("lu_index_part")), "lu_lemma_part": F.coalesce("lu_lemma_part", F.lit(""))})
    if split is not None:
        out = out.withColumn("split", F.lit(split))
    return out.select(*columns) if columns else out


def write_tsv(rows: DataFrame, path: str) -> None:
    """The inverse: tokens joined by blanks, indexes by commas."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    flat = [F.array_join(F.col(c).cast("array<string>"), " " if kinds[c] == "array<string>" else ",").alias(c) if kinds[c].startswith("array") else F.col(c) for c in rows.columns]
    rows.select(*flat).write.csv(path, sep="\t", header=True, quote='"', escape='"')


def numbered(rows: DataFrame, order: str, name: str = "c") -> DataFrame:
    """Rows with a running number from 0 by ``order``; positions within ranges are added to the sizes of those before, so no task sorts all rows."""
    # written, so that both uses see the same ranges
    ranged = materialize(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_r", inner).join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def prepare_salsa(rows: DataFrame, proto_only_in_train: bool = False) -> DataFrame:
    """Rows without proto frames (all, or only those in training), with ``fixed_label`` in training rows and indexes as integers.

    The split comes out folded. A null frame is no proto frame; a null split gets no fixed label.
    """
    rows = rows.withColumn("split", fold("split"))
    proto = F.coalesce(F.col("frame_id").endswith(PROTO), F.lit(False))
    if proto_only_in_train:
        proto = proto & (F.coalesce(F.col("split"), F.lit("")) == "train")
    kept = rows.where(~proto)
    fixed = F.when(F.col("split") == "train", F.concat(F.lit("F"), "frame_id"))
    return kept.withColumns({"fixed_label": fixed, "lu_index_part": F.array_join(integers(F.col("lu_index_part")).cast("array<string>"), ",")})


def with_train_only_frames_in_eval(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Of the frames that occur in training only, half (by a hash of frame and seed) are moved to test, so that evaluation has new frames."""
    seen = rows.where(F.col("split") != "train").select("frame_id").distinct()
    only = rows.where("split = 'train'").select("frame_id").distinct().join(seen, "frame_id", "left_anti")
    moved = only.where(F.pmod(F.xxhash64(F.lit(seed), "frame_id"), F.lit(2)) == 0).withColumn("_moved", F.lit(True))
    return rows.join(moved, "frame_id", "left").withColumn("split", F.when(F.col("_moved"), "test").otherwise(F.col("split"))).drop("_moved")


def unified(rows: DataFrame, corpus: str) -> DataFrame:
    """Rows with ``frame_label`` and ``global_id``: corpus, sentence, target indexes, the start of the sentence, lemma and frame, joined by ``::``.

    A row without a frame has the label ``<unk>``. The lemma is that of the whole unit where there is one.
    """
    frame = F.when(F.col("frame_id").isNull(), UNKNOWN).otherwise(F.concat_ws("::", F.lit(corpus), "frame_id"))
    tokens = F.split(F.coalesce("tokenized_sentence", F.lit("")), r"\s+")
    start = F.substring(F.concat(F.lit("['"), F.array_join(tokens, "','"), F.lit("']")), 1, 20)
    lemma = F.replace(F.coalesce("lu_lemma_full", "lu_lemma"), F.lit(" "), F.lit("_"))
    where = F.concat(F.lit("["), F.coalesce("lu_index", F.lit("")), F.lit("]"))
    out = rows.withColumns({"frame_label": frame, "_g": F.concat_ws("::", F.lit(corpus), "global_sentence_id", where, start, lemma, frame)})
    return out.withColumnRenamed("_g", "global_id")


def alternative_split(rows: DataFrame, wide: DataFrame, number: str, remove: bool = False) -> DataFrame:
    """Splits reassigned by data source: those named dev or test in column ``number`` of the wide table, all others train. Dev wins over test.

    With ``remove`` rows of sources the table doesn't name are left out.
    """
    named = wide.where(F.col(number).isin("dev", "test")).groupBy("data_source").agg(F.min(number).alias("_new"))
    out = rows.join(named, "data_source", "inner" if remove else "left")
    return out.withColumn("split", F.coalesce("_new", F.lit("train"))).drop("_new")


def alternative_splits(rows: DataFrame, wide: DataFrame, corpus: str) -> DataFrame:
    """``datasetsplit, i, split``: every numbered column of the wide table as one split assignment, named ``<corpus>-altsplit-<number>``; all in one pass over the rows.

    Sources a column names dev or test get that split, dev before test, all others train.
    """
    numbers = [c for c in wide.columns if c.isdigit()]
    long = wide.unpivot(["data_source"], numbers, "number", "new").where(F.col("new").isin("dev", "test")).groupBy("data_source", "number").agg(F.min("new").alias("new"))
    by_source = long.groupBy("data_source").agg(F.map_from_entries(F.collect_list(F.struct("number", "new"))).alias("_m"))
    each = rows.select("i", "data_source").join(by_source, "data_source", "left").select("i", "_m", F.explode(F.array(*[F.lit(n) for n in numbers])).alias("number"))
    return each.select(F.concat(F.lit(f"{corpus}-altsplit-"), "number").alias("datasetsplit"), "i", F.coalesce(F.col("_m")[F.col("number")], F.lit("train")).alias("split"))


def read_split_list(spark: SparkSession, path: str) -> DataFrame:
    """``name, id`` from lines of ``name: id id id``."""
    parts = F.split("value", ":", 2)
    lines = spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("ids"))
    return lines.select("name", F.explode(F.split("ids", r"\s+")).alias("id")).where("id <> ''")


def read_blocks(spark: SparkSession, path: str, rows: int | None = None, suffix: str = ".v") -> DataFrame:
    """Sentences with one target each from the block format: metadata, tokens, target positions.

    A form may be written as a bytes literal ``b'...'``. Only blocks whose lexical unit ends in ``suffix`` are kept.
    """
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    if rows is not None:
        raw = raw.limit(rows)
    lines = F.split("value", "\n")
    meta = lambda k: F.nullif(F.regexp_extract("value", rf"(?:^|\s){k}=(.*?)(?=\s[A-Z]+=|\n|$)", 1), F.lit(""))
    cells = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), lambda x: F.split(x, "\t"))
    form = lambda c: F.regexp_replace(F.get(c, F.lit(1)), r"^b(['\"])(.*)\1$", "$2")
    target = lambda c: F.get(c, F.lit(BLOCK_FIELDS.index("pred_frame"))) != "_"
    out = raw.select(*[meta(k).alias(k.lower()) for k in ("SOURCE", "SID", "LU", "LUID", "FRAMENAME", "FRAMEID")], cells.alias("cells"))
    out = out.select("*", F.transform("cells", form).alias("tokens"), F.filter(F.transform("cells", lambda c, i: F.when(target(c), i)), lambda i: i.isNotNull()).alias("lu_index"))
    return out.drop("cells").where(F.col("lu").endswith(suffix))


def read_conllu_verbs(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, tokens, lu_index, lu_lemma, frame_label`` for every token tagged VERB; multiword ranges and empty nodes are no tokens."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    cells = F.filter(F.transform(F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#")), lambda x: F.split(x, "\t")), lambda c: F.get(c, F.lit(0)).rlike(r"^\d+$"))
    out = raw.select(F.regexp_extract("value", r"(?m)^# sent_id\s*=\s*(.*)$", 1).alias("sent_id"), cells.alias("cells"))
    out = out.select("sent_id", F.transform("cells", lambda c: F.get(c, F.lit(1))).alias("tokens"), F.posexplode("cells").alias("i", "cell"))
    return out.where(F.get("cell", F.lit(3)) == "VERB").select("sent_id", "tokens", F.array("i").alias("lu_index"), F.get("cell", F.lit(2)).alias("lu_lemma"), F.lit(UNKNOWN).alias("frame_label"))


def prediction_key(tokens: Column, index: Column) -> Column:
    """Key of a prediction: md5 of the tokens in lower case and the target's positions."""
    return F.md5(F.to_json(F.struct(F.transform(tokens, lambda t: F.lower(t)).alias("t"), index.alias("i"))))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``predicted, label, support`` from a table without header."""
    return spark.read.csv(path, sep="\t", schema="predicted string, label string, support long")


def read_saved_clusterings(spark: SparkSession, path: str) -> DataFrame:
    """Saved clusterings, one JSON object a line, plain or gzip."""
    return spark.read.json(path)


def read_sentences_xml(spark: SparkSession, path: str, row_tag: str = "sentence") -> DataFrame:
    """``id, text, target_start, target_end, frame, lu`` from corpus XML: each annotation set's target labels, without repetition.

    Annotation sets that aren't annotated (status ``UNANN``) and those without a target are left out.
    """
    schema = "_ID long, text string, annotationSet array<struct<_ID:long,_frameName:string,_luName:string,_status:string,layer:array<struct<_name:string,label:array<struct<_name:string,_start:int,_end:int>>>>>>"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    sets = raw.select(F.col("_ID").alias("id"), "text", F.explode("annotationSet").alias("a")).where("a._status <> 'UNANN' and a._frameName is not null")
    layers = sets.select("id", "text", F.col("a._frameName").alias("frame"), F.col("a._luName").alias("lu"), F.explode("a.layer").alias("l")).where("l._name = 'Target'")
    return layers.select("id", "text", "frame", "lu", F.explode("l.label").alias("t")).select("id", "text", F.col("t._start").alias("target_start"), F.col("t._end").alias("target_end"), "frame", "lu").dropDuplicates(["id", "frame", "lu", "target_start", "target_end"])


#: Layers that hold the parts of speech, and so the tokens, of a sentence.
TOKEN_LAYERS = ("PENN", "BNC")


def read_annotations_xml(spark: SparkSession, path: str, row_tag: str = "sentence", exclude: DataFrame | None = None) -> DataFrame:
    """``id, annotation_id, text, tokens, lu_index, bios, frame, lu`` from corpus XML or from the exemplars of lexical units: a row for each annotated set with a target.

    Tokens are the spans of the part-of-speech layer that has most of them; ``lu_index`` are those a target label touches, and ``bios`` marks every token
    by the role it is in: ``B-`` at its first token, ``I-`` after it, ``O`` outside. Sets whose ``annotation_id`` is in ``exclude`` (those of evaluation splits, say)
    are left out, as are sets that aren't annotated.
    """
    label = "array<struct<_name:string,_start:int,_end:int>>"
    schema = f"_ID long, text string, annotationSet array<struct<_ID:long,_frameName:string,_luName:string,_status:string,layer:array<struct<_name:string,label:{label}>>>>"
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    none = F.array().cast(label)
    of = lambda layers, *names: F.flatten(F.transform(F.filter(layers, lambda x: x["_name"].isin(*names)), lambda x: F.coalesce(x["label"], none)))
    spans = lambda name: F.array_sort(F.array_distinct(F.transform(of(F.flatten("annotationSet.layer"), name), lambda x: F.named_struct(F.lit("a"), x["_start"], F.lit("b"), x["_end"]))))
    most = spans(TOKEN_LAYERS[0])
    for name in TOKEN_LAYERS[1:]:
        most = F.when(F.coalesce(F.size(spans(name)), F.lit(0)) > F.coalesce(F.size(most), F.lit(0)), spans(name)).otherwise(most)
    sets = raw.select(F.col("_ID").alias("id"), "text", F.filter(most, lambda s: s["a"].isNotNull()).alias("spans"), F.explode("annotationSet").alias("s"))
    sets = sets.where("s._frameName is not null and coalesce(s._status, '') <> 'UNANN'").withColumns({"target": of(F.col("s.layer"), "Target"), "roles": F.filter(of(F.col("s.layer"), "FE"), lambda x: x["_start"].isNotNull())})
    touches = lambda t, s: (t["_start"] <= s["b"]) & (t["_end"] >= s["a"])
    at = F.filter(F.transform("spans", lambda s, i: F.when(F.exists("target", lambda t: touches(t, s)), i)), lambda i: i.isNotNull())
    role = lambda s: F.get(F.filter("roles", lambda t: touches(t, s)), F.lit(0))
    bios = F.transform("spans", lambda s: F.coalesce(F.concat(F.when(s["a"] <= role(s)["_start"], "B-").otherwise("I-"), role(s)["_name"]), F.lit("O")))
    tokens = F.transform("spans", lambda s: F.substring(F.col("text"), s["a"] + 1, s["b"] - s["a"] + 1))
    out = sets.where(F.size("target") > 0).select("id", F.col("s._ID").alias("annotation_id"), "text", tokens.alias("tokens"), at.alias("lu_index"), bios.alias("bios"), F.col("s._frameName").alias("frame"), F.col("s._luName").alias("lu"))
    return out if exclude is None else out.join(exclude.select("annotation_id"), "annotation_id", "left_anti").select(*out.columns)


READERS = {"tsv": read_tsv, "blocks": read_blocks, "conllu": read_conllu_verbs, "xml": read_sentences_xml, "annotations": read_annotations_xml, "clusterings": read_saved_clusterings, "labelmap": read_label_map, "splits": read_split_list}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Dispatch by the kind of file."""
    if kind not in READERS:
        raise ValueError(f"no reader is named {kind!r}; there are {', '.join(READERS)}")
    return READERS[kind](spark, path, **options)


def read_parts(spark: SparkSession, kind: str, paths: dict[str, str], **options) -> DataFrame:
    """Several files of one kind as one table, each under its split's name; columns that some lack are null there."""
    out = None
    for split, path in paths.items():
        part = read(spark, kind, path, **options).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dataset_names(corpora: dict[str, str], alternatives: dict[str, int]) -> dict[str, str]:
    """Names of all split assignments with their language: the default of each corpus, and its numbered alternatives."""
    names = {f"{corpus}-default": language for corpus, language in corpora.items()}
    return names | {f"{corpus}-altsplit-{n}": corpora[corpus] for corpus, many in alternatives.items() for n in range(many)}


def list_datasets(datasets: DataFrame, datasetsplits: DataFrame, split_instances: DataFrame) -> DataFrame:
    """``dataset, language, datasetsplit, n_instances`` of every split assignment, also of those without instances."""
    n = split_instances.groupBy(F.col("datasetsplit_id").alias("id")).agg(F.count_distinct("instance_id").alias("n"))
    named = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"), "language")
    return datasetsplits.join(named, "dataset_id").join(n, "id", "left").select("dataset", "language", F.col("name").alias("datasetsplit"), F.coalesce("n", F.lit(0)).alias("n_instances"))
