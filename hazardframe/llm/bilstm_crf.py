"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam on the CRF's negative
log-likelihood, decoding by Viterbi, both over batches of equally long windows of symbol numbers."""

from __future__ import annotations

import numpy as np


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def initial(symbols: int, tags: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":  # forward, backward
        p[f"x{d}"] = rng.normal(0, 0.3, (symbols, 4 * hidden))
        p[f"h{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"x{d}"][:, hidden:2 * hidden] += 0.7  # forget gates start open
    p["out"] = rng.normal(0, 0.3, (2 * hidden, tags))
    p["bias"] = np.zeros(tags)
    p["trans"] = np.zeros((tags, tags))
    return p


def _lstm(p, d, x, keep):
    """States of one direction: windows x (batch, time); keep: also what the way back needs."""
    n, t = x.shape
    hidden = p[f"h{d}"].shape[0]
    h, c = np.zeros((n, hidden), p["out"].dtype), np.zeros((n, hidden), p["out"].dtype)
    states = np.empty((t, n, hidden), p["out"].dtype)
    trace = []
    for k in (range(t) if d == "f" else range(t - 1, -1, -1)):
        z = p[f"x{d}"][x[:, k]] + h @ p[f"h{d}"]
        gates = _sigmoid(z[:, :3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden:2 * hidden], gates[:, 2 * hidden:]
        g = np.tanh(z[:, 3 * hidden:])
        before, c = c, f * c + i * g
        if keep:
            trace.append((k, h, before, c, i, f, o, g))
        h = o * np.tanh(c)
        states[k] = h
    return states, trace


def _lstm_back(p, d, x, trace, grad, out):
    hidden = p[f"h{d}"].shape[0]
    dh = np.zeros_like(grad[0])
    dc = np.zeros_like(grad[0])
    for k, h0, c0, c, i, f, o, g in reversed(trace):
        dh = dh + grad[k]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
        np.add.at(out[f"x{d}"], x[:, k], dz)
        out[f"h{d}"] += h0.T @ dz
        dh, dc = dz @ p[f"h{d}"].T, dc * f


def emissions(p, x, keep=False):
    forward, trace_f = _lstm(p, "f", x, keep)
    backward, trace_b = _lstm(p, "b", x, keep)
    states = np.concatenate([forward, backward], axis=2)
    return states @ p["out"] + p["bias"], states, trace_f, trace_b


def loss_and_gradient(p, x, y):
    """Mean negative log-likelihood per position of tags y (batch, time) and its gradient."""
    n, t = x.shape
    e, states, trace_f, trace_b = emissions(p, x, True)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for k in range(1, t):
        alpha[k] = e[k] + _lse(alpha[k - 1][:, :, None] + p["trans"], 1)
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(p["trans"][None] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    rows = np.arange(n)
    score = sum(e[k][rows, y[:, k]] for k in range(t)) + sum(p["trans"][y[:, k - 1], y[:, k]] for k in range(1, t))
    out = {k: np.zeros_like(v) for k, v in p.items()}
    de = np.exp(alpha + beta - z[None, :, None])
    for k in range(t):
        de[k][rows, y[:, k]] -= 1
        if k:
            pair = alpha[k - 1][:, :, None] + p["trans"][None] + (e[k] + beta[k])[:, None, :] - z[:, None, None]
            out["trans"] += np.exp(pair).sum(axis=0)
            np.add.at(out["trans"], (y[:, k - 1], y[:, k]), -1)
    scale = 1 / (n * t)
    de *= scale
    out["trans"] *= scale
    out["out"] = np.einsum("tnh,tnk->hk", states, de)
    out["bias"] = de.sum(axis=(0, 1))
    ds = de @ p["out"].T
    hidden = p["hf"].shape[0]
    _lstm_back(p, "f", x, trace_f, ds[:, :, :hidden], out)
    _lstm_back(p, "b", x, trace_b, ds[:, :, hidden:], out)
    return float((z - score).mean() / t), out


def fit(x: np.ndarray, y: np.ndarray, symbols: int, tags: int, hidden: int = 16, steps: int = 160, batch: int = 48, rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam with a falling rate; the same data and seed give the same weights."""
    p = initial(symbols, tags, hidden, seed)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(batch, len(x)))
        _, g = loss_and_gradient(p, x[pick], y[pick])
        norm = np.sqrt(sum((v ** 2).sum() for v in g.values()))
        for k, v in g.items():
            v = v / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v ** 2
            p[k] = p[k] - rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def viterbi(p, x: np.ndarray) -> np.ndarray:
    """Best tags (batch, time)."""
    e = emissions(p, x)[0]
    t, n, _ = e.shape
    back = np.empty((t, n, e.shape[2]), np.int8)
    best = e[0]
    for k in range(1, t):
        step = best[:, :, None] + p["trans"]
        back[k] = step.argmax(axis=1)
        best = step.max(axis=1) + e[k]
    tags = np.empty((n, t), np.int8)
    tags[:, -1] = best.argmax(axis=1)
    rows = np.arange(n)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = back[k][rows, tags[:, k]]
    return tags
