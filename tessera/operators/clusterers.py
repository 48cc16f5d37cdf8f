"""Clusterers of one group held in memory, and their registry.

``fit_predict(x, y)`` takes unit vectors (or any features) and for each row a known label or None, and gives a label for each row. Known labels are hard constraints
for constrained clusterers: a labelled row keeps its label, and rows of different labels never share a cluster.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

REGISTRY: dict[str, type] = {}


def register(name: str):
    def mark(cls):
        cls.name = name
        REGISTRY[name] = cls
        return cls

    return mark


def create(config: dict | str):
    """A clusterer from ``{"type": name, ...options}`` or ``{"type": name, "options": {...}}``; options that are such configurations are created too."""
    if isinstance(config, str):
        config = {"type": config}
    options = {k: v for k, v in config.items() if k not in ("type", "options")} | (config.get("options") or {})
    options |= options.pop("cwargs", {})
    for k, v in options.items():
        if isinstance(v, dict) and "type" in v:
            options[k] = create(v)
        elif isinstance(v, list) and v and all(isinstance(e, dict) and "type" in e for e in v):
            options[k] = [create(e) for e in v]
    if config["type"] not in REGISTRY:
        raise ValueError(f"no clusterer is named {config['type']!r}")
    return REGISTRY[config["type"]](**options)


def cosine_matrix(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, length, out=np.zeros_like(x, dtype=float), where=length > 0)
    return u @ u.T


def respects(labels: list, y: list) -> bool:
    """Equal known labels share a cluster, different ones don't."""
    pairs = {(k, c) for k, c in zip(y, labels) if k is not None}
    return len(pairs) == len({k for k, _ in pairs}) == len({c for _, c in pairs})


def resolve_labels(labels: list, y: list, violated: bool = False, min_support: int = 1, min_accuracy: float = 0.0) -> list:
    """Cluster labels renamed to the known label of their members; with ``violated`` constraints to the most frequent one.

    Of equally frequent labels the smaller is taken. A cluster whose most frequent label has less support or a smaller share of its labelled members
    than asked for keeps its own name.
    """
    counts: dict = {}
    for c, k in zip(labels, y):
        if k is not None:
            counts.setdefault(c, {}).setdefault(k, 0)
            counts[c][k] += 1
    names = {}
    for c, by in counts.items():
        label, n = min(by.items(), key=lambda e: (-e[1], str(e[0])))
        if not violated or (n >= min_support and n / sum(by.values()) >= min_accuracy):
            names[c] = label
    return [names.get(c, c) for c in labels]


@register("ident")
@dataclass
class Identity:
    """Every row its own cluster, labelled rows under their label."""

    def fit_predict(self, x, y=None):
        y = y or [None] * len(x)
        return [k if k is not None else str(i) for i, k in enumerate(y)]


@register("const")
@dataclass
class Constant:
    """All rows without a label in cluster ``0``."""

    def fit_predict(self, x, y=None):
        y = y or [None] * len(x)
        if "0" in y:
            raise ValueError("'0' is the constant cluster and can't be a known label")
        return [k if k is not None else "0" for k in y]


@register("forward")
@dataclass
class Forward:
    """The labels of another clustering, given as a mapping of row position or as a list."""

    source: list | None = None

    def fit_predict(self, x, y=None):
        if self.source is None or len(self.source) != len(x):
            raise ValueError("forwarded labels must match the rows")
        return [str(s) for s in self.source]


def local_clustering(edges: np.ndarray) -> float:
    """Mean local clustering coefficient of a graph given by its yes/no matrix: of the pairs of a row's neighbours, how many are linked; 0 for rows with fewer than two."""
    a = edges.astype(float)
    degree = a.sum(1)
    closed = ((a @ a) * a).sum(1)
    return float(np.divide(closed, degree * (degree - 1), out=np.zeros(len(a)), where=degree > 1).mean()) if len(a) else 0.0


def prune(w: np.ndarray, criterion: str) -> np.ndarray:
    """The similarity matrix with the edges a criterion keeps, others 0.

    ``minw_t``: of at least that weight. ``lmc<=t``: the strongest, added a twentieth of all at a time while the mean local clustering coefficient is at most t.
    ``umap_k<k>``: to the k nearest, weighted by how much farther than the nearest they are, both directions joined; ``optkv`` and ``optkw`` in place of ``k``
    keep a row's neighbours up to the widest gap in their distances or weights, and ``_sym:max``, ``min`` or ``mean`` join the
    directions otherwise than by a + b - ab.
    """
    n = len(w)
    if criterion.startswith("minw_"):
        return np.where(w >= float(criterion[5:]), w, 0)
    if criterion.startswith("lmc<="):
        most = float(criterion[5:])
        upper = np.triu_indices(n, 1)
        order = np.argsort(-w[upper], kind="stable")
        kept = np.zeros((n, n), dtype=bool)
        for k in range(1, 21):
            more = np.zeros((n, n), dtype=bool)
            first = order[: len(order) * k // 20]
            more[upper[0][first], upper[1][first]] = True
            more |= more.T
            if local_clustering(more) > most:
                break
            kept = more
        return np.where(kept, np.maximum(w, 0), 0)
    m = re.fullmatch(r"umap_(k|optkv|optkw)(\d+)(?:_sym:(max|min|mean))?", criterion)
    if not m:
        raise ValueError(f"no criterion reads {criterion!r}")
    k = min(int(m[2]), n - 1)
    if k < 1:
        return np.zeros_like(w)
    far = 1 - w
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(far, near, 1)
    d = d - d[:, :1]
    low, high = np.full(n, 1e-6), np.full(n, 1e3)
    for _ in range(40):  # the scale at which the weights of a row sum up to log2(k)
        mid = (low + high) / 2
        much = np.exp(-d / mid[:, None]).sum(1) > max(np.log2(k), 1e-9)
        low, high = np.where(much, low, mid), np.where(much, mid, high)
    weight = np.exp(-d / high[:, None])
    if m[1] != "k" and k > 1:
        gaps = np.diff(d, axis=1) if m[1] == "optkv" else -np.diff(weight, axis=1)
        weight = np.where(np.arange(k) <= gaps.argmax(1)[:, None], weight, 0)
    a = np.zeros((n, n))
    np.put_along_axis(a, near, weight, 1)
    return {None: a + a.T - a * a.T, "max": np.maximum(a, a.T), "min": np.minimum(a, a.T), "mean": (a + a.T) / 2}[m[3]]


@register("cw")
@dataclass
class ChineseWhispers:
    """Label propagation on the similarity graph, labelled rows fixed.

    Edges below ``min_weight`` are cut (an edge equal to it stays), or by ``knn`` only those to the k most similar rows of either end are kept, or edges are
    chosen by a ``criterion`` as :func:`prune` reads it. Rows are visited in an order
    drawn from the seed; each takes the label of greatest summed weight among its neighbours (``binarize``: of most neighbours), of equal
    ones its own if that is among them, else the smallest, until nothing changes or ``max_iter`` rounds are done.
    """

    min_weight: float = 0.5
    knn: int | None = None
    binarize: bool = True
    max_iter: int = 100
    random_state: int | None = None
    criterion: str | None = None

    def __post_init__(self):
        if self.criterion is not None and self.criterion.startswith("minw_"):
            self.min_weight, self.criterion = float(self.criterion[5:]), None
        elif self.criterion is not None:
            prune(np.zeros((0, 0)), self.criterion)

    def fit_predict(self, x, y=None, similarity: np.ndarray | None = None):
        n = len(x) if similarity is None else len(similarity)
        y = y or [None] * n
        w = cosine_matrix(x) if similarity is None else np.array(similarity, dtype=float)
        np.fill_diagonal(w, 0)
        if self.criterion is not None:
            w = prune(w, self.criterion)
        elif self.knn is not None and n > 1:
            k = min(self.knn, n - 1)
            near = np.argsort(-w, axis=1, kind="stable")[:, :k]
            keep = np.zeros_like(w, dtype=bool)
            keep[np.arange(n)[:, None], near] = True
            w = np.where(keep | keep.T, np.maximum(w, 0), 0)
        else:
            w = np.where(w >= self.min_weight, w, 0)
        if self.binarize:
            w = (w > 0).astype(float)
        known = sorted({k for k in y if k is not None}, key=str)
        label = np.array([known.index(k) if k is not None else len(known) + i for i, k in enumerate(y)])
        free = np.flatnonzero([k is None for k in y])
        rng = np.random.default_rng(self.random_state)
        near = [np.flatnonzero(row) for row in w]
        for _ in range(self.max_iter):
            changed = False
            for i in rng.permutation(free):
                if len(near[i]):
                    score = np.bincount(label[near[i]], w[i, near[i]])
                    top = np.flatnonzero(score >= score.max() - 1e-12)
                    new = label[i] if label[i] in top else top[0]
                    changed |= new != label[i]
                    label[i] = new
            if not changed:
                break
        return [known[k] if k < len(known) else str(k - len(known)) for k in label]


@register("unsup-cw")
@dataclass
class UnsupervisedChineseWhispers(ChineseWhispers):
    """The same without regard to known labels."""

    def fit_predict(self, x, y=None, similarity=None):
        return super().fit_predict(x, None, similarity)


@register("unsupervised")
@dataclass
class Unsupervised:
    """Any clusterer without regard to known labels; or only over rows without one, the others keeping theirs."""

    clusterer: object = None
    discard_labelled: bool = False

    def fit_predict(self, x, y=None):
        y = y or [None] * len(x)
        if not self.discard_labelled:
            return self.clusterer.fit_predict(x, None)
        free = [i for i, k in enumerate(y) if k is None]
        out = list(y)
        if free:
            for i, c in zip(free, self.clusterer.fit_predict(x[free], None)):
                out[i] = str(c)
        return out


def merges(d: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Agglomerative merges of a distance matrix as (a, b, height); cluster n + k is the k-th merge. Ward takes euclidean distances.

    Of equally near pairs that of the smaller positions is merged first.
    """
    n = len(d)
    d = d.astype(float) ** 2 if linkage == "ward" else d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), list(range(n)), []
    alive = np.ones(n, bool)
    for k in range(n - 1):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        height = d[i, j]
        other = alive.copy()
        other[[i, j]] = False
        a, b = d[i, other], d[j, other]
        if linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        elif linkage == "complete":
            new = np.maximum(a, b)
        elif linkage == "single":
            new = np.minimum(a, b)
        else:
            s = size[other]
            new = ((size[i] + s) * a + (size[j] + s) * b - s * height) / (size[i] + size[j] + s)
        out.append((name[i], name[j], float(np.sqrt(height)) if linkage == "ward" else float(height)))
        d[i, other], d[other, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + k
    return out


def cut(n: int, steps: list[tuple[int, int, float]], done: int) -> list[str]:
    """Labels after the first ``done`` merges, numbered by the first row of each cluster."""
    up = list(range(2 * n))
    for k, (a, b, _) in enumerate(steps[:done]):
        up[a] = up[b] = n + k
    roots: dict[int, str] = {}
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(roots.setdefault(i, str(len(roots))))
    return out


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return np.maximum(0, 1 - cosine_matrix(x))
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(0, sq[:, None] + sq[None, :] - 2 * x @ x.T))


@register("ha")
@dataclass
class Agglomerative:
    """Hierarchical agglomerative clustering down to ``n_clusters``, or while merges are below ``distance_threshold``."""

    n_clusters: int | None = 2
    distance_threshold: float | None = None
    linkage: str = "average"
    metric: str = "euclidean"

    def dendrogram(self, x):
        return merges(distances(np.asarray(x, dtype=float), "euclidean" if self.linkage == "ward" else self.metric), self.linkage)

    def fit_predict(self, x, y=None):
        n = len(x)
        steps = self.dendrogram(x)
        if self.distance_threshold is not None:
            done = sum(h < self.distance_threshold for _, _, h in steps)
        else:
            done = max(0, n - max(1, self.n_clusters or 1))
        return cut(n, steps, done)

    def clusterings(self, x, y=None):
        """Every level of the dendrogram from all rows apart to two clusters."""
        steps = self.dendrogram(x)
        for done in range(0, len(x) - 1):
            yield cut(len(x), steps, done)
        if len(x) == 1:
            yield ["0"]


@register("ha-constrained")
@dataclass
class ConstrainedAgglomerative:
    """Complete linkage in which equal known labels are at distance 0, different ones at 3, and all others, with a little noise, scaled to between 1 and 2.

    Merged down to the known labels and ``n_extra_clusters`` more (to one at least), or while merges are below ``distance_threshold``, between 0 and 3. Rows that
    all have a label keep it, and a row alone is cluster ``0``. Similarities below 0 count as 0.
    """

    n_extra_clusters: int | None = None
    distance_threshold: float | None = None
    random_state: int | None = None

    def __post_init__(self):
        if self.distance_threshold is not None and not 0 < self.distance_threshold < 3:
            raise ValueError("the distance threshold lies between 0 and 3")

    def fit_predict(self, x, y=None):
        n = len(x)
        y = y or [None] * n
        if all(k is not None for k in y):
            return list(y)
        if n == 1:
            return ["0"]
        if (self.n_extra_clusters is None) == (self.distance_threshold is None):
            raise ValueError("either a number of extra clusters or a distance threshold is needed")
        d = 1 - cosine_matrix(np.asarray(x, dtype=float)).clip(0, 1)
        noise = np.random.default_rng(self.random_state or 0).normal(0, 1e-4, d.shape)
        d = d + np.triu(noise, 1) + np.triu(noise, 1).T
        apart = d[~np.eye(n, dtype=bool)]
        d = 1 + ((d - apart.min()) / max(apart.max() - apart.min(), 1e-12)).clip(0, 1)
        _, code = np.unique([str(k) for k in y], return_inverse=True)
        known = np.array([k is not None for k in y])
        both, same = known[:, None] & known[None, :], code[:, None] == code[None, :]
        d = np.where(both, np.where(same, 0.0, 3.0), d)
        np.fill_diagonal(d, 0)
        steps = merges(d, "complete")
        if self.n_extra_clusters is not None:
            done = n - max(1, len({k for k in y if k is not None}) + self.n_extra_clusters)
        else:
            done = sum(h < self.distance_threshold for _, _, h in steps)
        # rows of one label are at 0 and come together first
        labels = resolve_labels(cut(n, steps, max(done, sum(h < 0.5 for _, _, h in steps))), y)
        assert respects(labels, y)
        return labels


@register("xmeans")
@dataclass
class XMeans:
    """k-means that splits a cluster in two while that improves the Bayesian information criterion, up to ``max_clusters``."""

    initial: int = 2
    max_clusters: int = 10**10
    random_state: int | None = None

    def fit_predict(self, x, y=None):
        x = np.asarray(x, dtype=float)
        rng = np.random.default_rng(self.random_state)
        k = min(self.initial, len(x))
        c, at = self._kmeans(x, self._start(x, k, rng))
        while len(c) < self.max_clusters:
            new = []
            for i in range(len(c)):
                own = x[at == i]
                if len(own) < 4 or len(c) + len(new) - i >= self.max_clusters:
                    new.append(c[i : i + 1])
                    continue
                cc, aa = self._kmeans(own, self._start(own, 2, rng))
                two = len(np.unique(aa)) == 2 and self._bic(own, cc, aa) > self._bic(own, own.mean(0, keepdims=True), np.zeros(len(own), int))
                new.append(cc if two else c[i : i + 1])
            grown = np.concatenate(new)
            if len(grown) == len(c):
                break
            c, at = self._kmeans(x, grown)
        names = {k: str(i) for i, k in enumerate(dict.fromkeys(at.tolist()))}
        return [names[k] for k in at.tolist()]

    @staticmethod
    def _start(x, k, rng):
        c = [x[rng.integers(len(x))]]
        while len(c) < k:
            d = np.min([((x - p) ** 2).sum(1) for p in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        return np.array(c)

    @staticmethod
    def _kmeans(x, c, rounds: int = 50):
        at = None
        for _ in range(rounds):
            new = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            if at is not None and (new == at).all():
                break
            at = new
            c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
        return c, at

    @staticmethod
    def _bic(x, c, at):
        n, d, k = len(x), x.shape[1], len(c)
        if n <= k:
            return -np.inf
        var = max(((x - c[at]) ** 2).sum() / (d * (n - k)), 1e-12)
        sizes = np.bincount(at, minlength=k)
        sizes = sizes[sizes > 0]
        like = (sizes * np.log(sizes)).sum() - n * np.log(n) - n * d / 2 * np.log(2 * np.pi * var) - d * (n - k) / 2
        return like - (k * (d + 1)) / 2 * np.log(n)


@register("softmax")
@dataclass
class Softmax:
    """Multinomial logistic regression on labelled rows; the others get its prediction. Without any label every row is its own cluster."""

    l2: float = 1.0
    standardise: bool = False
    rounds: int = 300
    rate: float = 0.5

    def fit_predict(self, x, y=None):
        y = y or [None] * len(x)
        x = np.asarray(x, dtype=float)
        known = sorted({k for k in y if k is not None}, key=str)
        if not known or all(k is not None for k in y):
            return Identity().fit_predict(x, y)
        train = np.array([k is not None for k in y])
        if self.standardise:
            sd = x[train].std(0)
            x = (x - x[train].mean(0)) / np.where(sd > 0, sd, 1)
        z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        t = np.zeros((train.sum(), len(known)))
        t[np.arange(len(t)), [known.index(k) for k in y if k is not None]] = 1
        w, speed = np.zeros((z.shape[1], len(known))), 0.0
        mask = np.r_[np.ones(x.shape[1]), 0.0][:, None]
        for _ in range(self.rounds):
            s = z[train] @ w
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = z[train].T @ (p - t) / len(t) + self.l2 * mask * w / len(t)
            speed = 0.9 * speed - self.rate * g
            w = w + speed
        best = (z @ w).argmax(1)
        return [k if k is not None else known[b] for k, b in zip(y, best)]


def silhouette(x: np.ndarray, labels: list, metric: str = "cosine") -> np.ndarray:
    """Silhouette of every row; zeros unless there are between 2 and n - 1 clusters."""
    names = {c: i for i, c in enumerate(dict.fromkeys(labels))}
    at, n, k = np.array([names[c] for c in labels]), len(labels), len(names)
    if not 1 < k < n:
        return np.zeros(n)
    d = distances(np.asarray(x, dtype=float), metric)
    member = np.eye(k)[at]
    sums, sizes = d @ member, member.sum(0)
    own = sizes[at]
    a = np.where(own > 1, sums[np.arange(n), at] / np.maximum(own - 1, 1), 0)
    mean = sums / sizes
    mean[np.arange(n), at] = np.inf
    b = mean.min(1)
    top = np.maximum(a, b)
    return np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)


@register("clusterer-list")
@dataclass
class ClustererList:
    """The clusterings of several clusterers."""

    clusterers: list = field(default_factory=list)

    def clusterings(self, x, y=None):
        for c in self.clusterers:
            yield c.fit_predict(x, y)


@register("silhouette")
@dataclass
class BySilhouette:
    """Of several clusterings the one with the greatest mean silhouette, of equal ones the first."""

    clusterings: object = None
    metric: str = "cosine"

    def fit_predict(self, x, y=None):
        best, labels = -np.inf, None
        for c in self.clusterings.clusterings(x, y):
            s = float(silhouette(x, c, self.metric).mean())
            if s > best:
                best, labels = s, c
        return labels if labels is not None else Identity().fit_predict(x, y)


@register("pairs-in-cluster")
@dataclass
class ByPairs:
    """The first level of a dendrogram at which the pairs within clusters are at least that share of all pairs; else the last."""

    clusterings: object = None
    stopping_ratio: float = 0.5

    def fit_predict(self, x, y=None):
        n, last = len(x), None
        for last in self.clusterings.clusterings(x, y):
            sizes = np.unique(last, return_counts=True)[1]
            if (sizes * (sizes - 1) / 2).sum() >= self.stopping_ratio * n * (n - 1) / 2:
                return last
        return last if last is not None else Identity().fit_predict(x, y)


@register("ha-silhouette")
def ha_silhouette(**options):
    return BySilhouette(Agglomerative(**options))


@register("ha-stopping")
def ha_stopping(stopping_ratio: float = 0.5, **options):
    return ByPairs(Agglomerative(**options), stopping_ratio)
