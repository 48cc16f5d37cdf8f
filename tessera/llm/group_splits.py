"""Splits that keep related records together.

Method: component swap search. Records that share a value of any given column form a component; components start
in splits by hash, and are moved and exchanged whole to reduce the deviation of sizes and labels from the targets.
The search is annealed in parallel, one block of components to a task, several times from different seeds, and the
best of each block is kept. Components that are large beside a block are placed first, against the targets of the whole;
blocks share what is left of the targets, and a last block takes up what all others leave open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _graph
from tessera.storage import materialize

#: Components of a block, its annealing steps for each component, and starts.
BLOCK, STEPS, STARTS = 4096, 6, 2
#: A component with more than this part of a block's smallest share is placed before the blocks; so many labels of such components are balanced.
LARGE, LARGE_LABELS = 0.25, 1000
#: Components placed before the blocks, at most: the largest. Of more, the rest goes into blocks, and the last block makes up for them.
MOST_LARGE = 65_536


def components(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """``row_id, comp``: rows that share a non-null value of any key, directly or through others, have one component.

    Values of the first key are components as they are; only those that a value of another key joins are searched, each value as a star
    of its members, so that a value of many rows costs its size. A row without any key is one by itself.
    """
    alone = F.concat(F.lit("row "), F.col(row_id).cast("string"))
    ids = rows.select(row_id, F.coalesce(F.col(keys[0]).cast("string"), alone).alias("comp"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys[1:])])
    if len(keys) == 1:
        return ids
    ids = ids.withColumn("_n", F.xxhash64("comp"))
    links = None
    for i in range(len(keys) - 1):
        pairs = ids.where(F.col(f"_k{i}").isNotNull()).select("_n", F.col(f"_k{i}").alias("_k")).distinct()
        middle = pairs.groupBy("_k").agg(F.min("_n").alias("u"), F.count("*").alias("_c")).where("_c > 1").select("_k", "u")
        star = pairs.join(middle, "_k").where("u <> _n").select("u", F.col("_n").alias("v"), F.lit(1.0).alias("w"))
        links = star if links is None else links.union(star)
    _, nodes = _graph.boruvka(links)
    got = ids.join(nodes.select(F.col("node").alias("_n"), F.col("comp").alias("_j")), "_n", "left")
    return got.select(row_id, F.coalesce(F.concat(F.lit("joined "), F.col("_j").cast("string")), "comp").alias("comp"))


def anneal(loads: list[list[tuple[int, float]]], start: list[int], wanted: np.ndarray, weight: float, seed: int, steps: int) -> tuple[list[int], float]:
    """Splits of components after annealing, and their squared deviation: of sizes, plus ``weight`` times that of the labels on average.

    ``loads``: of each component its rows (column 0) and its rows of each label it has (columns from 1), however many labels there are.
    ``wanted``: rows wanted in each split, by column. The last state is given: the heat falls to a millionth, so the end is a descent.
    """
    rng = np.random.default_rng(seed)
    n, (k, columns) = len(loads), wanted.shape
    total = np.zeros(columns)
    for load in loads:
        for c, v in load:
            total[c] += v
    scale = np.sqrt(np.r_[1.0, np.full(columns - 1, weight / max(columns - 1, 1))]) / np.maximum(total, 1e-9)
    gap = (-wanted * scale).tolist()
    scale = scale.tolist()
    loads = [[(c, v * scale[c]) for c, v in load] for load in loads]
    split = list(start)
    for x, load in zip(split, loads):
        for c, v in load:
            gap[x][c] += v
    cost = sum(g * g for row in gap for g in row)
    picks, others, tos = (rng.integers(0, m, steps).tolist() for m in (n, n, k))
    swap = (rng.random(steps) < 0.5).tolist()
    # a step that costs more than its threshold is not taken
    heat = max(cost, 1e-9) / 4 * (1e-6) ** (np.arange(1, steps + 1) / max(steps, 1))
    most = (-heat * np.log(np.maximum(rng.random(steps), 1e-300))).tolist()
    for a, b, y, both, limit in zip(picks, others, tos, swap, most):
        x = split[a]
        if both:
            y = split[b]
        if x == y:
            continue
        step = {c: -v for c, v in loads[a]}
        if both:
            for c, v in loads[b]:
                step[c] = step.get(c, 0.0) + v
        gx, gy = gap[x], gap[y]
        change = 0.0
        for c, d in step.items():
            change += 2 * d * (gx[c] - gy[c] + d)
        if change <= limit:
            for c, d in step.items():
                gx[c] += d
                gy[c] -= d
            split[a] = y
            if both:
                split[b] = x
            cost += change
    return split, cost


def _place_large(large: list, rows: int, by_label: dict[str, int], shares: np.ndarray, weight: float) -> tuple[list[int], np.ndarray, dict[str, np.ndarray]]:
    """The split of each large component, greatest first, where it raises the deviation of the whole least; and the shares that are left for all other rows, in all and by label."""
    names = sorted(by_label)
    at = {x: i for i, x in enumerate(names)}
    total = np.array([rows, *(by_label[x] for x in names)], dtype=float)
    scale = np.sqrt(np.r_[1.0, np.full(len(names), weight / max(len(names), 1))]) / total
    gap = -shares[:, None] * total
    placed, used = [], np.zeros(len(total))
    for c in large:
        load = np.zeros(len(total))
        load[0] = c.n_rows
        for x in c.labels:
            if x.label in at:
                load[1 + at[x.label]] += x.n
        k = int(np.argmin([float((load * scale) @ ((2 * g + load) * scale)) for g in gap]))
        gap[k] += load
        used += load
        placed.append(k)
    left = np.maximum(-gap, 0)
    sums = left.sum(0)
    left = np.where((sums > 0) & (total > used), left / np.maximum(sums, 1e-9), shares[:, None])
    return placed, left[:, 0], {x: left[:, 1 + i] for x, i in at.items()}


def assign(
    rows: DataFrame,
    component: Column,
    label: Column,
    old_split: Column,
    splits: dict[str, float],
    weight: float = 0.3,
    seed: int = 11,
    n_rows: Column | None = None,
) -> DataFrame:
    """``comp, n_rows, n_old_splits, old_splits, labels, split``: a row for each component with its new split; ``labels`` are its rows by label.

    ``n_rows`` says how many rows a row stands for, else each is one. ``splits`` are names and shares of the rows. A component is never divided: one larger than every share makes its split as much
    too large. Null components are left out, a null label is a label of its own, null old splits don't count; an empty table
    gives no rows. The result depends on the rows and the seed only, not on their order.
    """
    names, shares = list(splits), np.array(list(splits.values()), dtype=float)
    shares = shares / shares.sum()
    cells = rows.select(component.cast("string").alias("comp"), F.coalesce(label.cast("string"), F.lit("")).alias("label"), old_split.cast("string").alias("old"), (F.lit(1) if n_rows is None else n_rows).cast("long").alias("n")).where("comp is not null")
    # rows are merged by (component, label, split) before anything is gathered
    cells = cells.groupBy("comp", "label", "old").agg(F.sum("n").alias("n"))
    comps = cells.groupBy("comp").agg(F.sum("n").alias("n_rows"), F.collect_set("old").alias("old"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"))
    comps = materialize(comps.select("comp", "n_rows", F.array_sort("old").alias("old"), "labels"), "components")
    total = comps.count()
    blocks = max(1, -(-total // BLOCK))
    # where a component starts is settled by its hash, so that others don't move it
    luck = F.pmod(F.xxhash64(F.lit(seed + 1), "comp"), F.lit(1 << 30)) / (1 << 30)
    sent = comps.select("comp", "n_rows", "old", "labels", F.pmod(F.xxhash64(F.lit(seed), "comp"), F.lit(blocks)).cast("int").alias("block"), luck.alias("luck"))
    rest, rest_of, done = shares, {}, None
    if blocks > 1:
        n_all = comps.agg(F.sum("n_rows")).first()[0]
        large = comps.where(F.col("n_rows") > LARGE * shares[shares > 0].min() * n_all / blocks).orderBy(F.desc("n_rows"), "comp").limit(MOST_LARGE).select("comp", "n_rows", "labels").collect()
        if large:
            often: dict[str, int] = {}
            for c in large:
                for x in c.labels:
                    often[x.label] = often.get(x.label, 0) + x.n
            chosen = sorted(often, key=lambda x: (-often[x], x))[:LARGE_LABELS]
            counts = comps.select(F.explode("labels").alias("l")).where(F.col("l.label").isin(*chosen)).groupBy("l.label").agg(F.sum("l.n").alias("n")).collect()
            placed, rest, rest_of = _place_large(large, n_all, {r.label: r.n for r in counts}, shares, weight)
            first = comps.sparkSession.createDataFrame([(c.comp, names[k]) for c, k in zip(large, placed)], "comp string, split string")
            done = comps.join(F.broadcast(first), "comp").select("comp", "n_rows", "old", "labels", "split")
            sent = sent.join(F.broadcast(first.select("comp")), "comp", "left_anti")

    def search(batches, wanted=None):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        t = t.sort_by("comp")
        block = t.column("block").to_numpy()
        split = np.zeros(t.num_rows, "i4")
        sizes = t.column("n_rows").to_numpy().astype(float)
        lists = t.column("labels").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        flat = lists.flatten()
        codes = flat.field("label").dictionary_encode()
        share_of = np.array([rest_of.get(x, rest) for x in codes.dictionary.to_pylist()]).reshape(-1, len(shares))
        counts, codes = flat.field("n").to_numpy().astype(float), codes.indices.to_numpy()
        start = np.searchsorted(np.cumsum(rest), t.column("luck").to_numpy(), side="right").clip(0, len(shares) - 1)
        for b in np.unique(block):
            here = np.flatnonzero(block == b)
            mine = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in here])
            have, column = np.unique(codes[mine], return_inverse=True)
            target = np.zeros((len(shares), 1 + len(have)))
            target[:, 0] = rest * sizes[here].sum() if wanted is None else wanted
            target[:, 1:] = (np.bincount(column, weights=counts[mine])[:, None] * share_of[have]).T
            cells = list(zip((column + 1).tolist(), counts[mine].tolist()))
            at = np.r_[0, np.cumsum(ends[here + 1] - ends[here])].tolist()
            loads = [[(0, v), *cells[i:j]] for v, i, j in zip(sizes[here].tolist(), at, at[1:])]
            tries = [anneal(loads, start[here].tolist(), target, weight, seed + s, STEPS * len(here) + 500) for s in range(STARTS)]
            split[here] = min(tries, key=lambda x: x[1])[0]
        out = pa.array(names).take(pa.array(split))
        yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("comp"), t.column("n_rows"), t.column("old"), t.column("labels"), out)], names=["comp", "n_rows", "old", "labels", "split"])

    kind = "comp string, n_rows long, old array<string>, labels array<struct<label:string,n:long>>, split string"
    wanted = None
    if blocks > 1:
        found = sent.where("block > 0").repartitionById(blocks, "block").mapInArrow(search, kind)
        done = materialize(found if done is None else found.union(done), "splits")
        # the last block makes up for what the others and the large components leave open
        held = {r["split"]: r.n for r in done.groupBy("split").agg(F.sum("n_rows").alias("n")).collect()}
        wanted = shares * n_all - np.array([held.get(x, 0) for x in names], dtype=float)
    found = sent.where("block = 0").repartitionById(1, "block").mapInArrow(lambda batches: search(batches, wanted), kind)
    found = found if done is None else found.union(done)
    return found.select("comp", "n_rows", F.size("old").alias("n_old_splits"), F.col("old").alias("old_splits"), "labels", "split")


def report(assigned: DataFrame, splits: dict[str, float]) -> DataFrame:
    """``split, label, n_rows, share, target, deviation``: rows of each split that were reached, of all (label null) and of each label, beside the wanted share.

    Every split and label has a row, also where it got nothing; an empty table gives none.
    """
    whole = sum(splits.values())
    wanted = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(v / whole).alias("target")) for k, v in splits.items()])
    cells = assigned.select("split", F.explode("labels").alias("l")).select("split", "l.label", "l.n")
    cells = cells.groupBy("label", "split").agg(F.sum("n").alias("n"))
    cells = materialize(cells.union(cells.groupBy(F.lit(None).cast("string").alias("label"), "split").agg(F.sum("n").alias("n"))), "cells")
    all_ = cells.groupBy("label").agg(F.sum("n").alias("of")).select("label", "of", F.explode(wanted).alias("w")).select("label", "of", "w.*")
    held = cells.select(F.col("label").alias("_l"), F.col("split").alias("_s"), "n")
    got = all_.join(held, F.col("label").eqNullSafe(F.col("_l")) & (F.col("split") == F.col("_s")), "left").withColumn("n_rows", F.coalesce("n", F.lit(0)))
    share = F.col("n_rows") / F.col("of")
    return got.select("split", "label", "n_rows", share.alias("share"), "target", (share - F.col("target")).alias("deviation"))
