"""Frame annotation on syntax graphs in XML, and its conversion to the tab-separated corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
_id string,
graph struct<terminals: struct<t: array<struct<_id: string, _word: string, _lemma: string, _pos: string>>>,
             nonterminals: struct<nt: array<struct<_id: string, edge: array<struct<_idref: string>>>>>>,
sem struct<frames: struct<frame: array<struct<_id: string, _name: string, target: struct<_lemma: string, fenode: array<struct<_idref: string>>>>>>>
"""
#: Part-of-speech tags that begin a verb, and that of a separated particle.
VERB, PARTICLE = "V", "PTKVZ"


def read_graphs(spark: SparkSession, path: str, row_tag: str = "s") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(SCHEMA).load(path)


def targets(graphs: DataFrame) -> DataFrame:
    """``sentence_id, frame, tokens, lu_index, lu_index_part, lu_lemma, lu``: a row for each frame target.

    Target nodes are followed down to the words under them; of those the verbs are the target and a separated particle its part. A target
    without a verb keeps all its words. Frames without a target and references to missing nodes give nothing.
    """
    rows = graphs.select(F.col("_id").alias("sid"), F.col("graph.terminals.t").alias("t"), F.col("graph.nonterminals.nt").alias("nt"), F.explode("sem.frames.frame").alias("f"))
    rows = rows.select("sid", F.col("f._name").alias("frame"), F.col("f.target._lemma").alias("lemma"), F.col("f.target.fenode._idref").alias("refs"), F.col("t._id").alias("ids"), F.col("t._word").alias("words"), F.col("t._pos").alias("pos"), F.col("nt._id").alias("nids"), F.transform("nt", lambda n: n["edge"]["_idref"]).alias("kids"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                at = {w: i for i, w in enumerate(r["ids"] or [])}
                kids = dict(zip(r["nids"] or [], r["kids"] or []))
                found, stack, seen = set(), list(r["refs"] or []), set()
                while stack:
                    node = stack.pop()
                    if node in at:
                        found.add(at[node])
                    elif node not in seen:
                        seen.add(node)
                        stack += kids.get(node) or []
                if not found:
                    continue
                pos = r["pos"]
                parts = sorted(i for i in found if pos[i] == PARTICLE)
                verbs = sorted(i for i in found if (pos[i] or "").startswith(VERB)) or sorted(found - set(parts))
                out.append((r["sid"], r["frame"], r["words"], verbs, parts, r["lemma"], " ".join(r["words"][i] for i in verbs + parts)))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sentence_id", "frame", "tokens", "lu_index", "lu_index_part", "lu_lemma", "lu"])

    return rows.mapInArrow(run, "sentence_id string, frame string, tokens array<string>, lu_index array<int>, lu_index_part array<int>, lu_lemma string, lu string")
