"""Histogram gradient-boosted trees in numpy: fitted on a bounded sample, flattened into arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees in heap order: inner node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """Logistic loss on x (rows x features) and y (0 or 1). Without both labels the score is the same for all rows."""
    n, m = x.shape
    inner = 2**depth - 1
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(p / (1 - p))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    shift = binned + np.arange(m) * bins
    raw, fs, ts, ls = np.full(n, out.base), [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        f, t, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            lo, k = 2**level - 1, 2**level
            key = ((at - lo)[:, None] * (m * bins) + shift).ravel()
            size = k * m * bins
            hg = np.bincount(key, np.repeat(g, m), size).reshape(k, m, bins).cumsum(2)
            hh = np.bincount(key, np.repeat(h, m), size).reshape(k, m, bins).cumsum(2)
            hn = np.bincount(key, None, size).reshape(k, m, bins).cumsum(2)
            tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], hn[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain[(hn < least) | (tn - hn < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(k, -1).argmax(1)
            for i in range(k):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9:
                    f[lo + i], t[lo + i] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        sg, sh = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -rate * sg / (sh + l2)
        raw += leaf[at - inner]
        fs.append(f), ts.append(t), ls.append(leaf)
    return Trees(out.base, np.array(fs), np.array(ts), np.array(ls))
