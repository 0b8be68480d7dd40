"""A linear-chain conditional random field in numpy: forward-backward over many sequences at once, and fitting."""

from __future__ import annotations

import numpy as np


class Chains:
    """Positions of many sequences in time-major order, so that one step handles all sequences that last so long."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        rank = np.argsort(np.argsort(-lengths, kind="stable"), kind="stable")
        which = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.order = np.lexsort((rank[which], time))
        self.alive = np.bincount(time) if len(time) else np.empty(0, np.int64)
        self.at = np.r_[0, np.cumsum(self.alive)]

    def marginals(self, emission: np.ndarray, transition: np.ndarray, pairs: bool = False):
        """Label probabilities of each position (by forward-backward); with ``pairs`` also the expected transitions and the log partition sum."""
        n, labels = emission.shape
        if not n:
            return (np.zeros((0, labels)), np.zeros((labels, labels)), 0.0) if pairs else np.zeros((0, labels))
        e = emission[self.order]
        shift = e.max(axis=1, keepdims=True)
        e = np.exp(e - shift)
        move = np.exp(transition)
        forward, scale = np.empty_like(e), np.empty(n)
        for t, alive in enumerate(self.alive):
            a = self.at[t]
            step = e[a : a + alive] if t == 0 else (forward[self.at[t - 1] : self.at[t - 1] + alive] @ move) * e[a : a + alive]
            total = step.sum(axis=1)
            scale[a : a + alive] = total
            forward[a : a + alive] = step / total[:, None]
        backward = np.ones_like(e)
        expected = np.zeros((labels, labels))
        for t in range(len(self.alive) - 2, -1, -1):
            a, b, alive = self.at[t], self.at[t + 1], self.alive[t + 1]
            ahead = e[b : b + alive] * backward[b : b + alive] / scale[b : b + alive, None]
            backward[a : a + alive] = ahead @ move.T
            if pairs:
                expected += forward[a : a + alive].T @ ahead * move
        out = np.empty_like(e)
        both = forward * backward
        out[self.order] = both / both.sum(axis=1, keepdims=True)
        return (out, expected, float(np.log(scale).sum() + shift.sum())) if pairs else out


class Adam:
    """Plain Adam ascent on named arrays."""

    def __init__(self, rate: float) -> None:
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, weights: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, g in gradient.items():
            m, v = self.state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            weights[name] += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def observed_transitions(labels: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    inside = np.ones(len(labels), bool)
    inside[np.cumsum(lengths)[np.asarray(lengths) > 0] - 1] = False
    at = np.flatnonzero(inside[:-1]) if len(labels) else np.empty(0, np.int64)
    out = np.zeros((n, n))
    np.add.at(out, (labels[at], labels[at + 1]), 1)
    return out
