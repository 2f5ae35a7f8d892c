"""A linear-chain conditional random field over categorical token features: training and Viterbi decoding, in numpy."""

from __future__ import annotations

import numpy as np


def scores(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Emission scores (..., states) of feature indices (..., k)."""
    return weights[feats].sum(-2)


def train(feats: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_feats: int, n_states: int = 3, steps: int = 80, rate: float = 0.3, l2: float = 1e-4):
    """Weights (n_feats, states) and transitions (states, states) that maximise the penalised likelihood.

    feats: (sequences, time, k) indices; labels: (sequences, time); both padded, lengths says from where. Full-batch Adam
    on the exact gradient, by forward-backward. The same input gives the same model.
    """
    n, t, k = feats.shape
    mask = np.arange(t)[None, :] < lengths[:, None]
    w, tr = np.zeros((n_feats, n_states)), np.zeros((n_states, n_states))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    gold = np.eye(n_states)[labels] * mask[..., None]
    pairs = mask[:, 1:]
    gold_tr = np.einsum("ntx,nty->xy", gold[:, :-1] * pairs[..., None], gold[:, 1:])
    # tokens in like surroundings have the same features: each distinct row is scored once
    rows, at = np.unique(feats.reshape(-1, k), axis=0, return_inverse=True)
    at = at.reshape(-1)
    on = mask.T  # sequences come last, so that sums over states run along them

    def total(x):
        """The logarithm of the sum of exponents over the first axis."""
        m = x.max(0)
        return m + np.log(np.exp(x - m).sum(0))

    for step in range(1, steps + 1):
        e = np.ascontiguousarray(scores(w, rows)[at].reshape(n, t, n_states).transpose(1, 2, 0))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = np.where(on[i], total(alpha[i - 1][:, None] + tr[:, :, None]) + e[i], alpha[i - 1])
        for i in range(t - 2, -1, -1):
            beta[i] = np.where(on[i + 1], total(tr.T[:, :, None] + (e[i + 1] + beta[i + 1])[:, None]), 0)
        z = total(alpha[-1])
        post = np.exp(alpha + beta - z).transpose(2, 0, 1) * mask[..., None]
        both = np.exp(alpha[:-1, :, None] + tr[None, :, :, None] + (e + beta)[1:, None] - z) * on[1:, None, None]
        diff = ((gold - post) / n).reshape(-1, n_states)
        gw = np.stack([sum(np.bincount(rows[:, j], x, n_feats) for j in range(k)) for x in (np.bincount(at, diff[:, s], len(rows)) for s in range(n_states))], 1) - l2 * w
        gt = (gold_tr - both.sum((0, 3))) / n - l2 * tr
        for x, g, a, b in ((w, gw, 0, 1), (tr, gt, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.999 * moments[b] + 0.001 * g * g
            x += rate * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.999**step)) + 1e-8)
    return w, tr


def viterbi(e: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The best path of emission scores (time, states); the lower state wins ties."""
    best, back = e[0].copy(), []
    for row in e[1:]:
        x = best[:, None] + tr
        back.append(x.argmax(0))
        best = x.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def slack(tr: np.ndarray, state: int) -> float:
    """What the transitions around one token can speak against state at most, whatever its neighbours."""
    n = len(tr)
    into = max(tr[p, x] - tr[p, state] for p in range(n) for x in range(n))
    out = max(tr[x, q] - tr[state, q] for q in range(n) for x in range(n))
    return max(0.0, into) + max(0.0, out)


def decode(e: np.ndarray, tr: np.ndarray, starts: np.ndarray, state: int = 0) -> np.ndarray:
    """Viterbi paths of sequences that lie one after another in e, each beginning at one of starts.

    A token whose score for state beats the others' by more than slack() has that state in any best path, so the best
    path falls apart there; only the tokens between such ones are decoded. The result is that of whole sequences.
    """
    out = np.full(len(e), state, np.int8)
    others = np.delete(np.arange(e.shape[1]), state)
    open_ = np.flatnonzero(e[:, state] - e[:, others].max(1) <= slack(tr, state) + 1e-9)
    if not len(open_):
        return out
    seq = np.searchsorted(starts, open_, "right")
    cuts = np.flatnonzero((np.diff(open_) > 1) | (np.diff(seq) > 0)) + 1
    first = set(starts.tolist())
    ends = set((np.r_[starts[1:], len(e)] - 1).tolist())
    for run in np.split(open_, cuts):
        part = e[run].copy()
        if int(run[0]) not in first:
            part[0] += tr[state]
        if int(run[-1]) not in ends:
            part[-1] += tr[:, state]
        out[run] = viterbi(part, tr)
    return out
