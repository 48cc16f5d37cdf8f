"""Mixing sources to target weights.

Method: entropy balancing. Among all rates of use that give each source its target number of tokens and exceed nobody's cap,
those nearest to using every text once (in relative entropy) are exponentially tilted in the text's length. The tilt of each source solves a
convex dual, by Newton steps over the counts of all its texts by length, all sources side by side. The rates are rounded into copies so that the tokens of
each source stay on target.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _ranking
from tessera.storage import materialize

#: Relative error of a source's tokens at which Newton's steps end, and steps at most.
PRECISION, STEPS = 1e-9, 60


def tilt(lengths: np.ndarray, counts: np.ndarray, cap: float, goal: float) -> float:
    """The tilt at which copies at the rate ``min(cap, exp(tilt * length))`` have ``goal`` tokens together: the root of the dual's slope, by Newton's steps.

    A step beyond what is known to hold the root is replaced by halving. ``inf`` where the goal is all that the cap allows.
    """
    if goal >= cap * float(counts @ lengths) * (1 - 1e-12):
        return math.inf
    at, low, high = 0.0, -math.inf, math.inf
    for _ in range(STEPS):
        rate = np.minimum(cap, np.exp(np.minimum(600.0, at * lengths)))
        weight = counts * rate * lengths
        g = float(weight.sum()) - goal
        if abs(g) <= PRECISION * goal:
            break
        low, high = (max(low, at), high) if g < 0 else (low, min(high, at))
        h = float((weight * lengths)[rate < cap].sum())
        step = at - g / h if h > 0 else at + (1.0 if g < 0 else -1.0)
        if not low < step < high:
            step = (low + high) / 2 if math.isfinite(low + high) else (2 * at + 1 if g < 0 else 2 * at - 1)
        if step == at:
            break
        at = step
    return at


def round_cells(lengths: np.ndarray, counts: np.ndarray, rates: np.ndarray, cap: int) -> np.ndarray:
    """Copies in all of each cell of equally long texts: from the longest on, each as near as can be to the tokens wanted so far."""
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(lengths), "i8")
    wanted = given = 0.0
    for c in order:
        wanted += counts[c] * rates[c] * lengths[c]
        out[c] = int(min(max(0, math.floor((wanted - given) / lengths[c] + 0.5)), counts[c] * cap))
        given += out[c] * lengths[c]
    return out


class Mixture:
    """Copies of every text of a mixture, and the shares reached.

    Without ``total`` the mixture is the largest in which every source that has texts reaches its share within its cap; any number of sources may be
    named. Of several targets of a source the shares add up and the greatest cap counts; null or negative ones are left out.

    ``texts`` is ``id, source, n_tokens`` with each id once; ``targets`` ``source, target_share, max_repeats``. Texts of sources
    that aren't named, of none, or without tokens don't take part. A named source without texts reaches nothing, and its share
    is divided among the others in proportion. Empty tables give an empty mixture.
    """

    def __init__(self, texts: DataFrame, targets: DataFrame, total: float | None = None):
        spark = texts.sparkSession
        self.targets = targets
        named = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
        texts = texts.where("id is not null and source is not null and n_tokens > 0").join(named.select("source"), "source", "left_semi")
        self.texts = materialize(texts.select("id", "source", F.col("n_tokens").cast("long").alias("n_tokens")), "texts")
        cells = materialize(self.texts.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "cells")
        totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("texts"))
        there = materialize(named.join(totals, "source"), "sources")
        # the largest mixture in which every source reaches its share within its cap, and the mean length, which tilts refer to
        whole = there.agg(F.sum("share").alias("shares"), F.min(F.col("cap") * F.col("tokens") / F.col("share")).alias("least"), (F.sum("tokens") / F.sum("texts")).alias("scale")).first()
        if whole.shares is None:
            self.size, self.copies = 0.0, self.texts.where(F.lit(False)).withColumn("copies", F.lit(1).cast("int"))
            return
        self.size, scale = float(total if total is not None else whole.least * whole.shares), float(whole.scale)
        goal = F.least(self.size * F.col("share") / whole.shares, F.col("cap") * F.col("tokens").cast("double"))

        def solved(t: pa.Table) -> pa.Table:
            n, length = (t.column(c).to_numpy() for c in ("n", "n_tokens"))
            cap, wanted = t.column("cap")[0].as_py(), t.column("goal")[0].as_py()
            at = tilt(length / scale, n.astype("f8"), cap, wanted / scale)
            rate = np.full(len(n), float(cap)) if at == math.inf else np.minimum(cap, np.exp(np.minimum(600.0, at * length / scale)))
            return pa.table({"source": t.column("source"), "n_tokens": t.column("n_tokens"), "n": t.column("n"), "given": pa.array(round_cells(length, n, rate, cap))})

        # constraints of different sources share nothing but the size, so each source's dual is solved by itself, all in one job; a source has a cell
        # for each different length, however many texts it has
        given = cells.join(there.select("source", "cap", goal.alias("goal")), "source").groupBy("source").applyInArrow(solved, "source string, n_tokens long, n long, given long").where("given > 0")
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranked = _ranking.with_rank(self.texts, ["source", "n_tokens"], ["id"], buckets).join(given, ["source", "n_tokens"])
        copies = F.floor(F.col("given") / F.col("n")) + F.when(F.col("rank") < F.col("given") % F.col("n"), 1).otherwise(0)
        self.copies = ranked.withColumn("copies", copies.cast("int")).where("copies > 0").select("id", "source", "n_tokens", "copies")

    def report(self) -> DataFrame:
        """``source, target_share, max_repeats, n_texts, n_copies, most_copies, n_tokens, share``: the share of all tokens that each named source reached."""
        used = self.copies.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
        used = materialize(used, "used")
        named = self.targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        zero = F.lit(0).cast("long")
        got = named.join(used, "source", "left").select("source", "target_share", "max_repeats", *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("n_texts", "n_copies", "most_copies", "n_tokens")])
        whole = used.agg(F.sum("n_tokens").alias("t")).scalar()
        return got.withColumn("share", F.coalesce(F.try_divide(F.col("n_tokens"), whole), F.lit(0.0)))
