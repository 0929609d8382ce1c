"""Gradient-boosted trees for a binary label, in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All trees as parallel arrays; an inner node goes left where its feature is below its cut, a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float = 0.0
    depth: int = 1
    names: tuple = field(default_factory=tuple)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.root) or not len(x):
            return out
        rows = np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] < self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """monotone: for each feature +1, -1 or 0, the direction in which the score may move with it.

    Without rows of both labels the forest is a constant: the rate of label 1, or 1 without rows.
    """
    n, m = x.shape
    rate1 = float(y.mean()) if n else 1.0
    base = float(np.log((rate1 * n + 1) / ((1 - rate1) * n + 1))) if n else 20.0
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "value": []}
    roots: list[int] = []
    if n and 0 < rate1 < 1:
        sign = np.zeros(m) if monotone is None else monotone
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
        score = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-score))
            g, h = p - y, p * (1 - p)

            def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
                at = len(nodes["value"])
                for v in nodes.values():
                    v.append(0)
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes["left"][at] = nodes["right"][at] = at
                nodes["cut"][at] = np.inf
                own = float(np.clip(-gs / (hs + l2), lo, hi))
                best = (1e-9, -1, -1, 0.0, 0.0)
                if level < depth and len(rows) >= 4:
                    for j in range(m):
                        width = len(cuts[j]) + 1
                        if width < 2:
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=width))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=width))[:-1]
                        vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-(gs - gl) / (hs - hl + l2), lo, hi)
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        ok = (hl * 4 >= least * 0.5) & ((hs - hl) * 4 >= least * 0.5) & (sign[j] * (vr - vl) >= 0)
                        gain = np.where(ok, gain, -1.0)
                        k = int(gain.argmax())
                        if gain[k] > best[0] + 1e-12:
                            best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
                _, j, k, vl, vr = best
                if j < 0:
                    nodes["value"][at] = own * rate
                    score[rows] += own * rate
                    return at
                go = binned[rows, j] <= k
                mid = (vl + vr) / 2
                lb, rb = ((lo, mid), (mid, hi)) if sign[j] > 0 else ((mid, hi), (lo, mid)) if sign[j] < 0 else ((lo, hi), (lo, hi))
                nodes["feature"][at], nodes["cut"][at] = j, float(cuts[j][k])
                nodes["left"][at] = grow(rows[go], level + 1, *lb)
                nodes["right"][at] = grow(rows[~go], level + 1, *rb)
                return at

            roots.append(grow(np.arange(n), 0, -np.inf, np.inf))
    as_int = {k: np.array(nodes[k], dtype=np.int64) for k in ("feature", "left", "right")}
    return Forest(np.array(roots, dtype=np.int64), as_int["feature"], np.array(nodes["cut"], dtype=float), as_int["left"], as_int["right"], np.array(nodes["value"], dtype=float), base, depth)
