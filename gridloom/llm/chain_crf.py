"""Linear-chain conditional random field in numpy: exact forward-backward over many chains at once.

All chains of a batch are laid end to end. A chain's first step uses a transition matrix of equal rows,
which cuts it off from the one before, so that the batch is one long chain. That chain is folded into
blocks; each block's product of step matrices is taken for all blocks together, a scan over the blocks
gives every block its incoming message, and a second walk fills in the positions. About sqrt(n) numpy
calls serve n positions, however long a single chain is.
"""

from __future__ import annotations

import numpy as np


def _walk(start: np.ndarray, trans: np.ndarray, first: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Scaled forward messages, one row for each position; emit is positive, first marks chain starts."""
    n, k = emit.shape
    size = max(1, int(np.sqrt(n) / 2))
    blocks = -(-n // size)
    pad = blocks * size - n
    e = np.vstack([emit, np.ones((pad, k))]).reshape(blocks, size, k)
    f = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, size)
    prod = np.tile(np.eye(k), (blocks, 1, 1))
    for t in range(size):
        nxt = (prod.reshape(-1, k) @ trans).reshape(blocks, k, k)
        if (cut := np.flatnonzero(f[:, t])).size:
            nxt[cut] = prod[cut].sum(2, keepdims=True) * start
        nxt *= e[:, t, None, :]
        if t % 8 == 7:
            nxt /= nxt.sum((1, 2), keepdims=True)
        prod = nxt
    into = np.empty((blocks, k))
    msg = np.full(k, 1.0 / k)
    for b in range(blocks):
        into[b] = msg
        msg = msg @ prod[b]
        msg = msg / msg.sum()
    out = np.empty((size, blocks, k))
    cur = into
    e = np.ascontiguousarray(e.transpose(1, 0, 2))
    for t in range(size):
        nxt = cur @ trans
        if (cut := np.flatnonzero(f[:, t])).size:
            nxt[cut] = cur[cut].sum(1, keepdims=True) * start
        nxt *= e[t]
        nxt /= nxt.sum(1, keepdims=True)
        out[t] = cur = nxt
    return out.transpose(1, 0, 2).reshape(-1, k)[:n]


def _back(trans: np.ndarray, first: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Scaled backward messages: the same walk from the other end."""
    n, k = emit.shape
    last = np.r_[first[1:], True]
    # b[t] = trans @ (emit[t+1] * b[t+1]) within a chain and 1 at its end; w[t] = emit[t] * b[t] walks backwards.
    w = _walk(np.ones(k), trans.T, last[::-1], emit[::-1])[::-1]
    b = np.ones((n, k))
    b[:-1] = w[1:] @ trans.T
    b[last] = 1.0
    return b / b.sum(1, keepdims=True)


def marginals(score: np.ndarray, first: np.ndarray, start: np.ndarray, trans: np.ndarray):
    """(p, fwd, back, emit): label probabilities at each position, and the messages they come from.

    score: (n, k) log potentials; first: chain starts; start (k,), trans (k, k): log potentials.
    """
    emit = np.exp(np.clip(score - score.max(1, keepdims=True), -60, 0))
    s, t = np.exp(start), np.exp(trans)
    fwd, back = _walk(s, t, first, emit), _back(t, first, emit)
    p = fwd * back
    return p / p.sum(1, keepdims=True), fwd, back, emit


def pair_counts(fwd: np.ndarray, back: np.ndarray, emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each label pair at adjacent positions of a chain."""
    inner = np.flatnonzero(~first)
    m = fwd[inner - 1][:, :, None] * np.exp(trans) * (emit[inner] * back[inner])[:, None, :]
    return (m / m.sum((1, 2), keepdims=True)).sum(0) if len(inner) else np.zeros_like(trans)


class Adam:
    """Plain Adam ascent on a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.p[k] += self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
