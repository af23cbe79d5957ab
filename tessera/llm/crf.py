"""A small linear-chain conditional random field over given features, for sequences of a few hundred items."""

from __future__ import annotations

import numpy as np


class ChainCRF:
    """Features are lists of numbers below ``dim``; an item's potential of a label is the sum of its weights."""

    def __init__(self, n_labels: int, dim: int):
        self.w = np.zeros((dim, n_labels))
        self.t = np.zeros((n_labels, n_labels))
        self.s = np.zeros(n_labels)

    def potentials(self, seq: list[list[int]]) -> np.ndarray:
        counts = [len(f) for f in seq]
        flat = np.fromiter((x for f in seq for x in f), dtype=np.int64, count=sum(counts))
        ends = np.cumsum(counts)
        return np.add.reduceat(self.w[flat], ends - counts, axis=0)  # every item has a bias feature

    def fit(self, data: list[tuple[list[list[int]], list[int]]], *, epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> ChainCRF:
        rng = np.random.default_rng(seed)
        gw, gt, gs = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2), np.full_like(self.s, 1e-2)
        n_labels = len(self.s)
        for _ in range(epochs):
            for k in rng.permutation(len(data)).tolist():
                seq, y = data[k]
                e = self.potentials(seq)
                n = len(e)
                p = np.exp(e - e.max(axis=1, keepdims=True))
                t = np.exp(self.t)
                a, b = np.empty_like(p), np.ones_like(p)
                a[0] = np.exp(self.s) * p[0]
                a[0] /= a[0].sum()
                for i in range(1, n):
                    a[i] = (a[i - 1] @ t) * p[i]
                    a[i] /= a[i].sum()
                for i in range(n - 2, -1, -1):
                    b[i] = t @ (b[i + 1] * p[i + 1])
                    b[i] /= b[i].sum()
                g = a * b
                g /= g.sum(axis=1, keepdims=True)
                dt = np.zeros_like(self.t)
                for i in range(n - 1):
                    x = a[i][:, None] * t * (p[i + 1] * b[i + 1])[None]
                    dt += x / x.sum()
                    dt[y[i], y[i + 1]] -= 1
                ds = g[0].copy()
                ds[y[0]] -= 1
                g[np.arange(n), y] -= 1
                flat = np.fromiter((x for f in seq for x in f), dtype=np.int64)
                who = np.repeat(np.arange(n), [len(f) for f in seq])
                used, inv = np.unique(flat, return_inverse=True)
                dw = np.stack([np.bincount(inv, weights=g[who, c], minlength=len(used)) for c in range(n_labels)], axis=1) + l2 * self.w[used]
                gw[used] += dw * dw
                gt += dt * dt
                gs += ds * ds
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.t -= rate * 0.5 * dt / np.sqrt(gt)
                self.s -= rate * 0.5 * ds / np.sqrt(gs)
        return self

    def decode(self, seq: list[list[int]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not seq:
            return []
        e = self.potentials(seq).tolist()
        t, labels = self.t.tolist(), range(len(self.s))
        best, back = [x + y for x, y in zip(self.s.tolist(), e[0])], []
        for row in e[1:]:
            new, frm = [], []
            for y in labels:
                k = max(labels, key=lambda z, y=y: best[z] + t[z][y])
                new.append(best[k] + t[k][y] + row[y])
                frm.append(k)
            best = new
            back.append(frm)
        y = max(labels, key=best.__getitem__)
        out = [y]
        for frm in reversed(back):
            y = frm[y]
            out.append(y)
        return out[::-1]
