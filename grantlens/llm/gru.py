"""A gated recurrent layer in numpy: inference for many sequences at once, and backpropagation through time.

With input rows x = (xz, xr, xn) and recurrent products g = (gz, gr, gn) = U h, a step is
z = sigmoid(xz + gz), r = sigmoid(xr + gr), n = tanh(xn + r * gn), h' = n + z * (h - n).
Arrays are laid out with the batch last, so that every gate is one contiguous block.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def halved(table: np.ndarray, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input columns (3H, V) and U (3H, H) with the halves of both sigmoids taken in, for `steps`."""
    size = recurrent.shape[1]
    scale = np.ones((3 * size, 1), np.float32)
    scale[:2 * size] = 0.5
    return np.ascontiguousarray(table * scale, np.float32), np.ascontiguousarray(recurrent * scale, np.float32)


def step(x: np.ndarray, recurrent: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One step of inference from a halved input (3H, B), which is overwritten."""
    size = h.shape[0]
    g = recurrent @ h
    gates = x[:2 * size]
    gates += g[:2 * size]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    n = g[2 * size:]
    n *= gates[size:]
    n += x[2 * size:]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:size]
    out += n
    return out


def forward(x: np.ndarray, recurrent: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States (T + 1, H, B) for inputs (T, 3H, B), and what `backward` needs."""
    size, length = h.shape[0], len(x)
    states = np.empty((length + 1, *h.shape), h.dtype)
    states[0] = h
    zr = np.empty((length, 2 * size, h.shape[1]), h.dtype)
    n, gn = np.empty_like(states[1:]), np.empty_like(states[1:])
    for t in range(length):
        g = recurrent @ states[t]
        gates, new, after = zr[t], n[t], states[t + 1]
        np.add(g[:2 * size], x[t, :2 * size], out=gates)
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        gn[t] = g[2 * size:]
        np.multiply(gates[size:], gn[t], out=new)
        new += x[t, 2 * size:]
        np.tanh(new, out=new)
        np.subtract(states[t], new, out=after)
        after *= gates[:size]
        after += new
    return states, (zr[:, :size], zr[:, size:], n, gn)


def backward(d_states: np.ndarray, states: np.ndarray, cache: tuple, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs (T, 3H, B) and of U, from those of the states after each step."""
    z, r, n, gn = cache
    size, length = states.shape[1], len(d_states)
    # Rows of one gate follow each other, so that the caller can put them together without turning them.
    d_x = np.empty((3 * size, length, states.shape[2]), states.dtype).transpose(1, 0, 2)
    d_recurrent = np.zeros_like(recurrent)
    carried, back = np.zeros_like(states[0]), np.ascontiguousarray(recurrent.T)
    for_n = (1 - z) * (1 - n * n)
    for_z = (states[:-1] - n) * z * (1 - z)
    for_r = gn * r * (1 - r)
    d_g = np.empty((3 * size, states.shape[2]), states.dtype)
    for t in range(length - 1, -1, -1):
        carried += d_states[t]
        d_n = d_x[t, 2 * size:]
        np.multiply(carried, for_n[t], out=d_n)
        np.multiply(carried, for_z[t], out=d_x[t, :size])
        np.multiply(d_n, for_r[t], out=d_x[t, size:2 * size])
        d_g[:2 * size] = d_x[t, :2 * size]
        np.multiply(d_n, r[t], out=d_g[2 * size:])
        d_recurrent += d_g @ states[t].T
        carried *= z[t]
        carried += back @ d_g
    return d_x, d_recurrent


class Adam:
    """Parameters by name, changed in place; gradients are scaled down to a norm of at most `clip`."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.params, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = min(1.0, self.clip / max(norm, 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            x = g * np.float32(0.1 * scale)
            m *= 0.9
            m += x
            x *= x
            x *= 0.1
            v *= 0.999
            v += x
            np.sqrt(v, out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate
            self.params[k] -= x
