"""Inverted lists over vectors: coarse quantiser, probing, and the scan of the lists.

Every vector has one home list, that of its nearest centroid, and probes the lists whose
centroids are nearly as near. Lists are gathered into groups of neighbouring lists, one
group to a task; a vector is sent once to every group that holds a list it probes. The
centroids are fitted on a bounded sample, all vectors are indexed.

Within a list partial distances over blocks of rotated dimensions are tested first: a
candidate is abandoned as soon as its estimated full distance exceeds the limit by more
than the estimate's error allows (``confidence`` standard errors), so that most candidates
cost one block of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows the centroids are fitted on, at most, and rows for each centroid.
SAMPLE_ROWS, ROWS_PER_CENTROID = 65_536, 32
#: Mean length of a list, and rows whose home is in one group.
LIST_ROWS, GROUP_ROWS = 512, 32_768
#: The quantiser is broadcast: 16,384 centroids of 64 dimensions are 4 MB.
MAX_LISTS = 16_384
PROBES, MARGIN = 12, 0.35
BLOCKS, CONFIDENCE = (16, 32), 2.5
#: Squared distance from which the first block is all dimensions: at so wide a limit hardly a candidate would be abandoned before.
WIDE = 0.8


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors held as bytes, as one float32 matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1) if rows else np.zeros((0, 1), "f4")


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(vectors: DataFrame, dim: int = 64, key: str = "key", embedding: str = "embedding", masking: str | None = "unmasked") -> DataFrame:
    """``key, vec``: the vectors that can be compared, as float32 bytes, one for each key.

    Left out are other maskings, null keys, vectors that are null, of another length or all
    zero, and those with a null, infinite or NaN entry. A key with several different vectors
    keeps the one whose bytes come first.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<float>").alias("e"), *([F.col("masking").alias("m")] if masking else []))
    if masking:
        rows = rows.where(F.col("m") == masking)
    rows = rows.where(F.col("key").isNotNull() & (F.size("e") == dim)).select("key", "e")

    def encode(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype("<f4", copy=False).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            keys = batch.column(0).filter(pa.array(good))
            x = np.ascontiguousarray(x[good])
            data = pa.Array.from_buffers(pa.binary(dim * 4), len(x), [None, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([keys, data.cast(pa.binary())], names=["key", "vec"])

    return rows.mapInArrow(encode, "key long, vec binary").groupBy("key").agg(F.min("vec").alias("vec"))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on unit vectors; an emptied centroid restarts at a random row."""
    rng = np.random.default_rng(seed)
    x = x.astype("f4")
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        have, start = np.unique(near[order], return_index=True)
        c[have] = np.add.reduceat(x[order], start, axis=0)
        lost = np.setdiff1d(np.arange(k), have)
        c[lost] = x[rng.choice(len(x), len(lost))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def bisect(c: np.ndarray, load: np.ndarray, groups: int) -> np.ndarray:
    """Group of each centroid: halved along the widest direction until there are ``groups`` of like load."""
    out = np.zeros(len(c), dtype="i4")

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n <= 1 or len(rows) <= 1:
            out[rows] = first
            return
        centred = c[rows] - c[rows].mean(0)
        order = rows[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
        left = n // 2
        cut = int(np.searchsorted(np.cumsum(load[order]), load[order].sum() * left / n)) + 1
        cut = min(max(cut, 1), len(order) - 1)
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, n - left)

    halve(np.arange(len(c)), 0, groups)
    return out


@dataclass
class Quantiser:
    centroids: np.ndarray
    group: np.ndarray
    groups: int
    rotation: np.ndarray

    def probe(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each unit vector, and its ``probes`` nearest lists; -1 where one is farther than ``margin`` in cosine."""
        k = min(probes, len(self.centroids))
        s = x.astype("f4") @ self.centroids.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(s), 1))
        sims = np.take_along_axis(s, top, axis=1)
        best = sims.argmax(1)
        home = top[np.arange(len(x)), best]
        return home, np.where(sims >= sims.max(1, keepdims=True) - margin, top, -1)


def fit(vectors: DataFrame, rows: int, dim: int = 64, id_col: str = "rep", seed: int = 7) -> Quantiser:
    """The quantiser, fitted on rows chosen by the hash of their id: at most ``SAMPLE_ROWS`` of them."""
    lists = int(min(MAX_LISTS, max(1, -(-rows // LIST_ROWS))))
    wanted = min(SAMPLE_ROWS, lists * ROWS_PER_CENTROID)
    chosen = vectors.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(1_000_000 * wanted / max(rows, 1)) + 1)
    x = matrix(chosen.select("vec").limit(2 * wanted).toArrow().column(0))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    if not len(x):
        return Quantiser(np.zeros((1, dim), "f4"), np.zeros(1, "i4"), 1, rotation)
    x = unit(x)
    c = kmeans(x, min(lists, len(x)), seed=seed)
    load = np.bincount(np.concatenate([(x[i : i + 8192].astype("f4") @ c.T).argmax(1) for i in range(0, len(x), 8192)]), minlength=len(c)) + 0.5
    groups = int(max(1, min(len(c), -(-rows // GROUP_ROWS))))
    return Quantiser(c, bisect(c, load, groups), groups, rotation)


def close_pairs(q: np.ndarray, x: np.ndarray, q_unit: np.ndarray, x_unit: np.ndarray, limit: np.ndarray, blocks=BLOCKS, confidence: float = CONFIDENCE):
    """Pairs (query row, member row, cosine) whose squared distance is within ``limit`` of the query.

    ``q``, ``x``: rotated unit vectors in float32, for the partial distances; ``q_unit``, ``x_unit``: unit
    vectors in float64, for the cosine of what is left. The estimate from d of D dimensions has a relative
    error of about 1/sqrt(d); a candidate is dropped if its estimate exceeds limit * (1 + confidence/sqrt(d))^2.
    """
    dim = q.shape[1]
    first = dim if len(limit) and np.median(limit) > WIDE else min(blocks[0], dim)
    factor = lambda d: (1 + confidence / np.sqrt(d)) ** 2 * d / dim if d < dim else 1.0
    a, b = q[:, :first], x[:, :first]
    half = ((a * a).sum(1) - (limit * factor(first) + 1e-5).astype("f4")) / 2
    partial = a @ b.T
    partial -= (b * b).sum(1) / 2
    i, j = np.nonzero(partial >= half[:, None])
    done = first
    dist = None
    for upto in [*[d for d in blocks[1:] if first < d < dim], dim]:
        if not len(i):
            break
        if upto == dim:
            break
        step = np.empty(len(i), "f4")
        for k in range(0, len(i), 65_536):
            step[k : k + 65_536] = ((q[i[k : k + 65_536], done:upto] - x[j[k : k + 65_536], done:upto]) ** 2).sum(1)
        if dist is None:
            dist = (a * a).sum(1)[i] + (b * b).sum(1)[j] - 2 * (partial[i, j] + ((b * b).sum(1) / 2)[j])
        dist = dist + step
        keep = dist <= limit[i] * factor(upto) + 1e-5
        i, j, dist, done = i[keep], j[keep], dist[keep], upto
    cos = np.empty(len(i), "f8")
    for k in range(0, len(i), 65_536):
        cos[k : k + 65_536] = np.einsum("nd,nd->n", q_unit[i[k : k + 65_536]], x_unit[j[k : k + 65_536]])
    keep = 2 - 2 * cos <= limit[i] + 1e-12
    return i[keep], j[keep], cos[keep]


def place(vectors: DataFrame, quantiser: Quantiser, probes: int = PROBES, margin: float = MARGIN, where=None) -> DataFrame:
    """``grp, home, probes, rep, vec``: a row for each group that holds a list the vector lives in or probes.

    ``home`` is the list the vector is a member of in that group, or -1; ``probes`` the lists there that it
    searches. ``where(rep)``, an optional test on the ids as a numpy array, says which vectors search at all.
    """
    names = ["grp", "home", "probes", "rep", "vec"]

    def send(batches):
        for batch in batches:
            rep, vec = batch.column(0), batch.column(1)
            x = matrix(vec)
            if not len(x):
                continue
            x = unit(x)
            asks = np.ones(len(x), bool) if where is None else where(rep.to_numpy())
            for at in range(0, len(x), 4096):
                part = slice(at, at + 4096)
                home, lists = quantiser.probe(x[part], probes, margin)
                lists[~asks[part]] = -1
                row, _ = np.nonzero(lists >= 0)
                lst = lists[lists >= 0]
                row, lst = np.concatenate([row, np.arange(len(home))]), np.concatenate([lst, home])
                own = np.arange(len(row)) >= len(row) - len(home)
                grp = quantiser.group[lst]
                order = np.lexsort((own, grp, row))
                row, lst, own, grp = row[order], lst[order], own[order], grp[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (grp[1:] != grp[:-1])])
                of = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (grp[1:] != grp[:-1])]) - 1
                homes = np.full(len(first), -1)
                homes[of[own]] = lst[own]
                counts = np.bincount(of[~own], minlength=len(first))
                asked = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(lst[~own], pa.int32()))
                rows = pa.array(at + row[first])
                yield pa.RecordBatch.from_arrays([pa.array(grp[first], pa.int32()), pa.array(homes, pa.int32()), asked, rep.take(rows), vec.take(rows)], names=names)

    return vectors.select("rep", "vec").mapInArrow(send, "grp int, home int, probes array<int>, rep long, vec binary").repartitionById(quantiser.groups, "grp")


def grown(runs: np.ndarray) -> np.ndarray:
    """0..n-1 within each of the runs of the given lengths."""
    return np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)


class Scan:
    """The rows of one group in memory, and the close pairs of its lists one after the other."""

    def __init__(self, batches, rotation: np.ndarray):
        t = pa.Table.from_batches(batches)
        self.table = t
        self.n = t.num_rows
        self.rep = t.column("rep").to_numpy()
        self.home = t.column("home").to_numpy()
        probes = t.column("probes").combine_chunks()
        probes = probes.chunk(0) if isinstance(probes, pa.ChunkedArray) else probes
        lengths = probes.value_lengths().to_numpy(zero_copy_only=False)
        asked = probes.flatten().to_numpy(zero_copy_only=False)
        who = np.repeat(np.arange(self.n), lengths)
        order = np.argsort(asked, kind="stable")
        self.asked, self.who = asked[order], who[order]
        order = np.argsort(self.home, kind="stable")
        order = order[self.home[order] >= 0]
        self.members, self.of = order, self.home[order]
        self.unit = unit(matrix(t.column("vec")))
        self.turned = (self.unit @ rotation).astype("f4")

    def lists(self):
        """Members and visitors of each list."""
        for lst in np.unique(self.of):
            a, b = np.searchsorted(self.of, [lst, lst + 1])
            c, d = np.searchsorted(self.asked, [lst, lst + 1])
            if d > c:
                yield self.members[a:b], self.who[c:d]

    def pairs(self, limit: np.ndarray, confidence: float = CONFIDENCE, chunk: int = 1 << 21):
        """(visitor row, member row, cosine), of different vectors; ``limit`` is read anew for each part of a list."""
        for members, visitors in self.lists():
            x, xu = self.turned[members], self.unit[members]
            step = max(1, chunk // len(members))
            for at in range(0, len(visitors), step):
                v = visitors[at : at + step]
                i, j, cos = close_pairs(self.turned[v], x, self.unit[v], xu, limit[v], confidence=confidence)
                i, j = v[i], members[j]
                keep = self.rep[i] != self.rep[j]
                yield i[keep], j[keep], cos[keep]
