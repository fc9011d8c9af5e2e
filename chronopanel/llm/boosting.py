"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotone features, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Node arrays of all trees; a leaf has feature -1. `roots` are the first nodes of the trees."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                low = x[rows, np.maximum(f, 0)] <= self.bound[node]
                node = np.where(f < 0, node, np.where(low, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """signs: -1 or 1 where the score must not rise or fall with a feature, else 0. A split that breaks its sign is
    not taken, and the middle of its two values bounds all values below it on either side."""
    if len(np.unique(y)) < 2:  # nothing to tell apart: 0.5 for all
        return _flat(0.0, [], [], depth)
    share = np.clip(y.mean(), 0.01, 0.99)
    base, nodes, roots = float(np.log(share / (1 - share))), [], []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)

    def grow(rows, g, h, level, low, high):
        me, value = len(nodes), float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([-1, 0.0, me, me, rate * value])
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            if len(cuts[f]) == 0:
                continue
            gs, hs = (np.cumsum(np.bincount(binned[rows, f], v[rows], len(cuts[f]) + 1)) for v in (g, h))
            gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
            gain[(hl < least) | (hr < least) | (signs[f] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is not None:
            f, k, vl, vr = best[1]
            goes, middle = binned[rows, f] <= k, (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[f])]
            one = grow(rows[goes], g, h, level + 1, *bounds[0])
            two = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[me] = [f, float(cuts[f][k]), one, two, rate * value]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        flat = _flat(base, roots[-1:], nodes, depth)
        margin += flat.margin(x) - base
    return _flat(base, roots, nodes, depth)


def _flat(base, roots, nodes, depth) -> Trees:
    a = nodes or [[-1, 0.0, 0, 0, 0.0]]
    f, b, left, right, v = (np.array(c) for c in zip(*a, strict=True))
    return Trees(base, np.array(roots, int), f.astype(int), b.astype(float), left.astype(int), right.astype(int), v.astype(float), depth)
