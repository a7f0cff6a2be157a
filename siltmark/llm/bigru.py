"""A small bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam.

All arrays are float32 with the batch as the last axis, so that one step over thousands of sequences is a few vector operations.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def cell(inputs: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Run one direction. inputs: (steps, 3h, batch), the projected inputs with bias; u: (3h, h). Returns states (steps, h, batch) and what the backward pass needs."""
    steps, h3, batch = inputs.shape
    h = h3 // 3
    states, saved = np.empty((steps, h, batch), np.float32), []
    at = np.zeros((h, batch), np.float32)
    for t in range(steps):
        g = u @ at
        a = inputs[t]
        zr = a[: 2 * h] + g[: 2 * h]
        zr *= np.float32(0.5)
        np.tanh(zr, out=zr)
        zr += np.float32(1)
        zr *= np.float32(0.5)
        n = zr[h:] * g[2 * h :]
        n += a[2 * h :]
        np.tanh(n, out=n)
        new = states[t]
        np.subtract(at, n, out=new)
        new *= zr[:h]
        new += n
        if keep:
            saved.append((at, zr, n, g[2 * h :]))
        at = new
    return states, saved


def cell_back(d_states: np.ndarray, saved: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs (steps, 3h, batch) and of u."""
    steps, h, batch = d_states.shape
    d_in, d_u, carry = np.empty((steps, 3 * h, batch), np.float32), np.zeros_like(u), np.zeros((h, batch), np.float32)
    for t in reversed(range(steps)):
        before, zr, n, gn = saved[t]
        z, r = zr[:h], zr[h:]
        d = d_states[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (before - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        d_in[t, :h], d_in[t, h : 2 * h], d_in[t, 2 * h :] = dz, dr, dn
        dg = np.concatenate([dz, dr, dn * r])
        d_u += dg @ before.T
        carry = d * z + u.T @ dg
    return d_in, d_u


def walk(table: np.ndarray, u: np.ndarray, ids: np.ndarray):
    """States of one direction step by step, as cell() gives them, for inputs that are columns of a table; the array is used again at each step."""
    h3, n = len(table), ids.shape[1]
    h = h3 // 3
    at, a, g, new = np.zeros((h, n), np.float32), np.empty((h3, n), np.float32), np.empty((h3, n), np.float32), np.empty((h, n), np.float32)
    table, u = table.copy(), u.copy()
    table[: 2 * h] *= np.float32(0.5)  # sigmoid(x) is 0.5 * (1 + tanh(x / 2))
    u[: 2 * h] *= np.float32(0.5)
    half, one = np.float32(0.5), np.float32(1)
    for row in ids:
        np.take(table, row, axis=1, out=a, mode="clip")
        np.matmul(u, at, out=g)
        zr, m = a[: 2 * h], a[2 * h :]
        zr += g[: 2 * h]
        np.tanh(zr, out=zr)
        zr += one
        zr *= half
        g[2 * h :] *= zr[h:]
        m += g[2 * h :]
        np.tanh(m, out=m)
        np.subtract(at, m, out=new)
        new *= zr[:h]
        new += m
        at, new = new, at
        yield at


def both(forward: np.ndarray, backward: np.ndarray, p: Params, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """States of both directions at each position, (steps, 2h, batch)."""
    f, sf = cell(forward, p["uf"], keep)
    b, sb = cell(backward[::-1], p["ub"], keep)
    return np.concatenate([f, b[::-1]], axis=1), (sf, sb)


def both_back(d: np.ndarray, saved: tuple, p: Params) -> tuple[np.ndarray, np.ndarray, Params]:
    h = d.shape[1] // 2
    df, duf = cell_back(d[:, :h], saved[0], p["uf"])
    db, dub = cell_back(np.ascontiguousarray(d[::-1, h:]), saved[1], p["ub"])
    return df, db[::-1], {"uf": duf, "ub": dub}


def scattered(ids: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of values (rows, n) over equal ids (n): (rows, size)."""
    return np.stack([np.bincount(ids, weights=v, minlength=size) for v in values]).astype(np.float32)


class Adam:
    """Adam with bias correction."""

    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grads: Params, scale: float = 1.0, slower: dict[str, float] | None = None) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * np.float32(clip)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.01) * (g * g - self.v[k])
            m, v = self.m[k] / np.float32(1 - 0.9**self.t), self.v[k] / np.float32(1 - 0.99**self.t)
            self.p[k] -= np.float32(self.rate * scale * (slower or {}).get(k, 1.0)) * m / (np.sqrt(v) + np.float32(1e-7))


def orthogonal(rng: np.random.Generator, rows: int, cols: int) -> np.ndarray:
    return np.linalg.qr(rng.normal(size=(max(rows, cols), min(rows, cols))))[0][:rows, :cols].astype(np.float32)


def recurrent(rng: np.random.Generator, h: int) -> np.ndarray:
    return np.concatenate([orthogonal(rng, h, h) for _ in range(3)])
