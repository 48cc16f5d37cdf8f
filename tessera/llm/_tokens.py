"""Text lengths in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import spread

#: The vocabulary is a file on every machine; its place can be given by environment or parameter.
VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a file of base64 tokens and ranks, special strings taken as ordinary text."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", text: str = "text", extra: list[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, n_tokens, <extra>`` for every text that isn't null or blank; whole texts are counted."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"), *extra)
    rows = spread(rows.where("id is not null and t is not null").where(F.col("t").rlike(r"(?U)\S")))
    kept = [c for c in rows.columns if c != "t"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, n_tokens long").where("n_tokens > 0").select("id", "n_tokens", *[c for c in kept if c != "id"])
