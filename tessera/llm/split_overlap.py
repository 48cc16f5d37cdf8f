"""Same or near-same records across splits.

Method: bit fingerprints. Every text has a fingerprint of 128 bits and an ordered code of its tokens. Segments of the code are joined
across splits as blocks; of the texts that meet in a block those within a Hamming radius of each other are kept, and their
token edit distance is verified. Overlaps are counted by split and source.

Both steps before the verification are exact, not likely: with at most k edits,

* a bit of the fingerprint is the parity of the tokens (with their number of occurrence) that fall on it, so that an insertion or deletion turns one bit and
  a replacement two: the radius is 2k, less the difference in length;
* an edit touches at most three of a text's segments of three tokens, so that two such texts share all but 3k of the longer one's. The rarest 3k + 1
  segments of either, in one order for all texts, then have one in common; more frequent ones, boilerplate above all, are not joined at all.

Blocks of a similarity hash by the signs of token sums would not do: see the README for how many pairs they miss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Tokens of a segment.
RUN = 3
#: Texts from which the frequency of segments is estimated, at most; it guides the choice of blocks and not what is found.
FREQUENCY_ROWS = 65_536
#: Expected rows of one block in a task; a more frequent block is divided.
BLOCK_ROWS = 50_000
EDITS = 5  # one edit for each so many tokens of the longer text


def tokens(text: Column) -> Column:
    """Tokens at white space, lower case, umlauts and ß written out, without those that have no letter or digit; of null or blank text one empty token."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for x, y in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(x), F.lit(y))
    # whole words of other characters go in one pass over the text, and not by a test of each token
    t = F.regexp_replace(t, r"(?U)(?<!\S)[^\p{L}\p{N}\s]+(?!\S)", "")
    return F.split(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")


def edit_distance(a: list, b: list) -> int:
    """Least number of insertions, deletions and replacements, by the bit-parallel columns of the matrix."""
    if not a or not b:
        return len(a) or len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(level | up) & mask, up & level
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus, minus = (plus << 1 | 1) & mask, minus << 1 & mask
        eq |= down
        up, down = (minus | ~(eq | plus)) & mask, plus & eq
    return score


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each different token, and the position of each token among them."""
    d = words.dictionary_encode()
    different = d.dictionary.to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in different), "u8", len(different)), d.indices.to_numpy(zero_copy_only=False)


def _runs(code: np.ndarray) -> np.ndarray:
    """A code for each run of tokens, by its first token; runs over the end of a text mean nothing."""
    a, b, c = code[:-2], code[1:-1], code[2:]
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9) + c
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _parity(code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """128 bits for each row as two longs: each is the parity of the row's tokens that fall on it, the second occurrence of a token being another token."""
    order = np.lexsort((code, row))
    c, r = code[order], row[order]
    new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]) if len(c) else np.zeros(0, int)
    again = np.arange(len(c)) - np.repeat(new, np.diff(np.r_[new, len(c)]))
    with np.errstate(over="ignore"):
        x = (c + again.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    bit = ((x >> np.uint64(57)) & np.uint64(127)).astype("i8")
    odd = np.bincount(r * 128 + bit, minlength=rows * 128).reshape(rows, 128) & 1
    return np.packbits(odd.astype("u1"), axis=1).copy().view("<i8")


def fewest_shared(n: np.ndarray) -> np.ndarray:
    """Segments at least shared by a text of n tokens and any as long or longer within the allowed edits; of six tokens or more it is never none.

    A text of L tokens has L - 2 segments, of which L // 5 edits touch three each. That falls at every multiple of five only, so it is least
    for L = n or for the next multiple of five, where a text that long is within reach.
    """
    here = n - RUN + 1 - RUN * (n // EDITS)
    fives = -(-n // EDITS)
    return np.where((EDITS - 1) * fives <= n, np.minimum(here, EDITS * fives - RUN + 1 - RUN * fives), here)


def _frequent(texts: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that several texts of a bounded sample share, sorted, and the share of texts that have them."""
    part = min(1.0, FREQUENCY_ROWS / max(rows, 1))
    chosen = texts.where(F.pmod(F.xxhash64(F.lit(3), "tid"), F.lit(1_000_000)) < int(1_000_000 * part) + 1).select("toks").limit(2 * FREQUENCY_ROWS)

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            codes, at = _codes(lists.flatten())
            if len(at) >= RUN:
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                inside = _places(n)[: len(at) - 2] < np.repeat(n, n)[: len(at) - 2] - 2
                yield pa.RecordBatch.from_arrays([pa.array(_runs(codes[at])[inside].view("i8"))], names=["run"])

    counts = chosen.mapInArrow(run, "run long").groupBy("run").count().where("count > 2").toArrow()
    order = np.argsort(run_codes := counts.column("run").to_numpy().view("u8"))
    return run_codes[order], counts.column("count").to_numpy()[order] / max(1.0, part * rows)


def _places(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def blocks(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], rows: int, copies: bool) -> DataFrame:
    """``block, part, tid, n, at, s1, s2``: the blocks a text is found by, with where they begin in it and its fingerprint.

    A block that is expected in more than ``BLOCK_ROWS`` texts is divided into parts: one side sends a row to one of them, the other (``copies``) to all.
    """
    known, often = frequent

    def run(batches):
        for batch in batches:
            lists = batch.column("toks")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
            if not n.sum():
                continue
            codes, at = _codes(lists.flatten())
            place, row = _places(n), np.repeat(np.arange(len(n)), n)
            prints = _parity(codes[at], row, len(n))
            runs = np.zeros(len(at), "u8")
            runs[: max(0, len(at) - 2)] = _runs(codes[at])
            whole = place + RUN <= n[row]
            runs, place, row = runs[whole], place[whole], row[whole]
            hit = np.searchsorted(known, runs).clip(0, max(0, len(known) - 1))
            share = np.where(known[hit] == runs, often[hit], 0.0) if len(known) else np.zeros(len(runs))
            # the rarest of a text, in an order that is the same for all texts
            order = np.lexsort((place, runs, share, row))
            has = np.bincount(row, minlength=len(n))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(has) - has, has)
            order = order[rank <= (n - RUN + 1 - np.maximum(1, fewest_shared(n)))[row[order]]]
            tid = batch.column("tid").to_numpy()
            parts = 1 + (share[order] * rows / BLOCK_ROWS).astype("i8")
            if copies:
                order, part = np.repeat(order, parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            else:
                part = tid[row[order]] % parts
            r = row[order]
            columns = (runs[order].view("i8"), part.astype("i4"), tid[r], n[r].astype("i4"), place[order].astype("i4"), prints[r, 0], prints[r, 1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "part", "tid", "n", "at", "s1", "s2"])

    return texts.select("tid", "toks").mapInArrow(run, "block long, part int, tid long, n int, at int, s1 long, s2 long")


def near_texts(texts: DataFrame, min_tokens: int = 8) -> DataFrame:
    """``a, b, distance``: all pairs of different texts, one in train and one in another split, within the allowed edits.

    ``texts`` is ``tid, toks, train, other``, each text once. The distance may be at most a fifth of the longer one's tokens. Texts of
    fewer than six tokens have no segment that is sure to be shared; they are left out here and only found where they are equal.
    """
    texts = texts.where(F.size("toks") >= max(min_tokens, 2 * RUN))
    rows = texts.count()
    frequent = _frequent(texts, rows)
    name = lambda df, x: df.withColumnsRenamed({c: c + x for c in ("tid", "n", "at", "s1", "s2")})
    left = name(blocks(texts.where("train"), frequent, rows, False), "a")
    right = name(blocks(texts.where("other"), frequent, rows, True), "b")
    k = F.floor(F.greatest("na", "nb") / EDITS)
    apart = F.abs(F.col("na") - F.col("nb"))
    differ = F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b"))) + F.bit_count(F.col("s2a").bitwiseXOR(F.col("s2b")))
    near = (F.col("tida") != F.col("tidb")) & (apart <= k) & (F.abs(F.col("ata") - F.col("atb")) <= k) & (differ <= 2 * k - apart)
    pairs = left.join(right, ["block", "part"]).where(near).select(F.col("tida").alias("a"), F.col("tidb").alias("b")).distinct()
    # the texts themselves come in only for what is left
    pairs = materialize(pairs, "near")
    held = texts.select("tid", "toks")
    close = pairs.join(held.withColumnsRenamed({"tid": "a", "toks": "x"}), "a").join(held.withColumnsRenamed({"tid": "b", "toks": "y"}), "b").select("a", "b", "x", "y")

    def verify(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            d = np.array([edit_distance(p, q) for p, q in zip(x, y)], "i4")
            keep = pa.array(d * EDITS <= np.array([max(len(p), len(q)) for p, q in zip(x, y)], "i4"))
            columns = (pa.array(np.minimum(*(batch.column(c).to_numpy() for c in (0, 1)))), pa.array(np.maximum(*(batch.column(c).to_numpy() for c in (0, 1)))), pa.array(d))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "distance"])

    # a pair of texts that both are in both kinds of split is found from either side
    return close.mapInArrow(verify, "a long, b long, distance int").distinct()


class Overlaps:
    """Overlaps between the train split and the others.

    ``records`` is ``id, text, split, source``: one row for each record and source, the same text and split in all rows of an
    id. Rows without id, text or split, of other splits, or with fewer than ``min_tokens`` tokens are left out. Equal texts are
    one text with members, so a group of copies costs its size; ``pairs`` alone lists every pair of records.
    """

    def __init__(self, records: DataFrame, train: str = "train", others: tuple[str, ...] = ("dev", "test"), min_tokens: int = 8):
        kept = records.where("id is not null and text is not null").where(F.col("split").isin(train, *others))
        one = kept.groupBy("id").agg(F.max("text").alias("text"), F.max("split").alias("split"), F.array_sort(F.collect_set("source")).alias("sources"))
        # short texts are left out after the writing: before it their tokens would be made twice
        one = materialize(one.select("id", "split", "sources", tokens(F.col("text")).alias("toks")), "records")
        # texts are numbered by a 64-bit hash of all their tokens
        self.members = one.where(F.size("toks") >= min_tokens).withColumn("tid", F.xxhash64("toks"))
        texts = self.members.groupBy("tid").agg(F.first("toks").alias("toks"), F.bool_or(F.col("split") == train).alias("train"), F.bool_or(F.col("split") != train).alias("other"))
        self.texts = materialize(texts, "texts")
        near = near_texts(self.texts, min_tokens)
        same = self.texts.where("train and other").select(F.col("tid").alias("a"), F.col("tid").alias("b"), F.lit(0).alias("distance"))
        self.links = materialize(near.union(same), "links")
        self.train = train

    def _directed(self) -> DataFrame:
        there = self.links.select(F.col("a").alias("t"), F.col("b").alias("o"))
        back = self.links.where("a != b").select(F.col("b").alias("t"), F.col("a").alias("o"))
        return there.union(back)

    def pairs(self) -> DataFrame:
        """``id_a, id_b``: every pair of a train record and another, the smaller id first."""
        own = self.members.where(F.col("split") == self.train).select(F.col("tid").alias("t"), F.col("id").alias("x"))
        other = self.members.where(F.col("split") != self.train).select(F.col("tid").alias("o"), F.col("id").alias("y"))
        both = self._directed().join(own, "t").join(other, "o")
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def report(self) -> DataFrame:
        """``split, source, n_records, n_overlapping, n_exact``: records of the other splits found in train, by split and source."""
        trained = self.texts.where("train").select(F.col("tid").alias("t"))
        found = self._directed().join(trained, "t").groupBy(F.col("o").alias("tid")).agg(F.bool_or(F.col("t") == F.col("o")).alias("exact"))
        rows = self.members.where(F.col("split") != self.train).join(found, "tid", "left").withColumn("source", F.explode_outer("sources"))
        return rows.groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("exact").alias("n_overlapping"), F.count_if("exact").alias("n_exact"))
