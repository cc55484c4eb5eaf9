"""Trees in flat arrays: gradient-boosted trees on histograms, isolation forests, and a vectorised walk over both.

A forest is a dict of arrays with a row a tree: feature, threshold, left, right (positions of nodes in the row), value. A leaf
points to itself, so a walk of `depth` steps needs no test for leaves.
"""

from __future__ import annotations

import numpy as np


def walk(forest: dict, x: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Sum of the leaves' values by row of x; all trees step at once."""
    out = np.empty(len(x))
    trees, nodes = forest["feature"].shape
    base = np.arange(trees) * nodes
    feature, threshold, left, right, value = (forest[k].ravel() for k in ("feature", "threshold", "left", "right", "value"))
    for s in range(0, len(x), rows):
        part = x[s : s + rows]
        at = np.broadcast_to(base, (len(part), trees)).copy()
        row = np.arange(len(part))[:, None]
        for _ in range(forest["depth"]):
            below = part[row, feature[at]] <= threshold[at]
            at = base + np.where(below, left[at], right[at])
        out[s : s + rows] = value[at].sum(axis=1)
    return out


def flat(trees: list[list[tuple]], depth: int) -> dict:
    """trees: nodes (feature, threshold, left, right, value)."""
    width = max(len(t) for t in trees)
    kinds = {"feature": np.int64, "threshold": np.float32, "left": np.int64, "right": np.int64, "value": np.float64}
    out = {k: np.zeros((len(trees), width), d) for k, d in kinds.items()}
    for i, t in enumerate(trees):
        for k, column in zip(kinds, zip(*t, strict=True), strict=True):
            out[k][i, : len(t)] = column
    return out | {"depth": depth}


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 1.0) -> dict:
    """Logistic gradient boosting; splits are sought on histograms of quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for j in range(d)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    slots = binned + np.arange(d) * bins
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    margin = np.full(n, start)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        nodes, step = [], np.zeros(n)

        def grow(rows: np.ndarray, level: int, g=g, h=h, nodes=nodes, step=step) -> int:
            me = len(nodes)
            G, H = g[rows].sum(), h[rows].sum()
            value = -rate * G / (H + ridge)
            nodes.append((0, 0.0, me, me, value))
            if level < depth and len(rows) >= 2 * least:
                at = slots[rows].ravel()
                hist = [np.bincount(at, np.repeat(w[rows], d), d * bins).reshape(d, bins).cumsum(axis=1) for w in (g, h)]
                size = np.bincount(at, minlength=d * bins).reshape(d, bins).cumsum(axis=1)
                gl, hl = hist
                gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                gain[(size < least) | (len(rows) - size < least)] = -1
                j, b = divmod(int(gain.argmax()), bins)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    low = binned[rows, j] <= b
                    left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
                    nodes[me] = (j, edges[j][b], left, right, 0.0)
                    return me
            step[rows] = value
            return me

        grow(np.arange(n), 0)
        margin += step
        trees.append(nodes)
    return flat(trees, depth) | {"start": start}


def probability(forest: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(forest["start"] + walk(forest, x))))


def mean_path(n: int) -> float:
    """Of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def draws(n: int, trees: int, sample: int, seed: int = 11) -> np.ndarray:
    """The places, of n, that each tree draws: a row a tree, without repeats in it."""
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, min(sample, n), replace=False, shuffle=False) for _ in range(trees)])


def isolate(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7, picked: np.ndarray | None = None) -> dict:
    """Random splits of random samples; a leaf's value is its path length, with the mean path of what it still holds.

    picked: the rows of x that each tree draws, where x holds only what is drawn.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x)) if picked is None else picked.shape[1]
    depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
    out = []
    for k in range(trees):
        nodes = []

        def grow(part: np.ndarray, level: int, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append((0, 0.0, me, me, level + mean_path(len(part))))
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level < depth and len(part) > 1 and len(usable):
                j = int(rng.choice(usable))
                t = np.float32(rng.uniform(low[j], high[j]))
                below = part[:, j] <= t
                if below.any() and not below.all():
                    left, right = grow(part[below], level + 1), grow(part[~below], level + 1)
                    nodes[me] = (j, t, left, right, 0.0)
            return me

        grow(x[rng.choice(len(x), sample, replace=False) if picked is None else picked[k]], 0)
        out.append(nodes)
    return flat(out, depth) | {"norm": max(1e-9, mean_path(sample)), "trees": trees}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """0 to 1; higher: isolated by fewer splits."""
    return 2 ** (-walk(forest, x) / forest["trees"] / forest["norm"])
