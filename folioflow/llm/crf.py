"""A linear-chain conditional random field with two labels and binary features, in numpy."""

from __future__ import annotations

import numpy as np


class Chain:
    """``weights`` of each feature for both labels, ``moves`` from label to label, ``starts`` of the first label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.index, self.weights, self.moves, self.starts = index, weights, moves, starts

    def score(self, names: list[str]) -> list[float]:
        """What features add to both labels."""
        return self.weights[[self.index[n] for n in names if n in self.index]].sum(axis=0).tolist()

    def decode(self, features: list[list[str]]) -> list[int]:
        """The likeliest labels of a sequence."""
        return self.best([self.score(names) for names in features])

    def best(self, scores: list[list[float]]) -> list[int]:
        """The likeliest labels where the features of each place add so much to both (Viterbi)."""
        if not scores:
            return []
        (a, b), (c, d) = self.moves.tolist()
        best, back = None, []
        for own in scores:
            if best is None:
                best = [own[0] + self.starts[0], own[1] + self.starts[1]]
                continue
            zero, one = best
            back.append((0 if zero + a >= one + c else 1, 0 if zero + b > one + d else 1))
            best = [own[0] + max(zero + a, one + c), own[1] + max(zero + b, one + d)]
        labels = [int(best[1] > best[0])]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 200, ridge: float = 0.3, least: int = 3) -> Chain:
    """Penalised maximum likelihood by Adam on all sequences at once; features seen fewer than ``least`` times are left out."""
    pages = [p for p in pages if p[0]]
    seen: dict[str, int] = {}
    for features, _ in pages:
        for names in features:
            for n in set(names):
                seen[n] = seen.get(n, 0) + 1
    index = {n: k for k, n in enumerate(sorted(n for n, c in seen.items() if c >= least))}
    deep, wide = max(len(y) for _, y in pages), len(pages)
    places, owners = [], []
    mask, gold = np.zeros((deep, wide), bool), np.zeros((deep, wide), np.int64)
    for s, (features, labels) in enumerate(pages):
        for t, names in enumerate(features):
            own = [index[n] for n in set(names) if n in index]
            places += own
            owners += [t * wide + s] * len(own)
            mask[t, s], gold[t, s] = True, labels[t]
    places, owners = np.array(places), np.array(owners)
    size = len(index)
    told = np.zeros((deep, wide, 2))
    np.put_along_axis(told, gold[:, :, None], 1.0, axis=2)
    told *= mask[:, :, None]
    both = np.einsum("tsi,tsj->ij", told[:-1], told[1:])
    x, m, v = np.zeros(2 * size + 6), np.zeros(2 * size + 6), np.zeros(2 * size + 6)
    for r in range(1, rounds + 1):
        w, moves, starts = x[: 2 * size].reshape(size, 2), x[2 * size : 2 * size + 4].reshape(2, 2), x[2 * size + 4 :]
        emit = np.stack([np.bincount(owners, w[places, y], deep * wide) for y in (0, 1)], axis=1).reshape(deep, wide, 2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0] + starts
        for t in range(1, deep):
            step = np.logaddexp.reduce(ahead[t - 1][:, :, None] + moves, axis=1) + emit[t]
            ahead[t] = np.where(mask[t][:, None], step, ahead[t - 1])
        total = np.logaddexp.reduce(ahead[-1], axis=1)
        for t in range(deep - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[t + 1] + behind[t + 1])[:, None, :], axis=2)
            behind[t] = np.where(mask[t + 1][:, None], step, 0.0)
        likely = np.exp(ahead + behind - total[:, None]) * mask[:, :, None]
        pairs = ahead[:-1, :, :, None] + moves + (emit[1:] + behind[1:])[:, :, None, :] - total[:, None, None]
        pairs = (np.exp(np.minimum(pairs, 0)) * mask[1:, :, None, None]).sum(axis=(0, 1))
        gap = (likely - told).reshape(-1, 2)
        gradient = np.concatenate([np.stack([np.bincount(places, gap[owners, y], size) for y in (0, 1)], axis=1).ravel(), (pairs - both).ravel(), (likely[0] - told[0]).sum(axis=0)])
        gradient += ridge * x
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x = x - 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    w, moves, starts = x[: 2 * size].reshape(size, 2), x[2 * size : 2 * size + 4].reshape(2, 2), x[2 * size + 4 :]
    return Chain(index, w.copy(), moves.copy(), starts.copy())
