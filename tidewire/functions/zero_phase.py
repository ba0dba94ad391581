"""Forward and backward filtering of an array by second-order sections."""

from __future__ import annotations

import numpy as np

_BLOCK = 128


def _section(s: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One section over ``x`` from state ``z``: responses within blocks by a matrix, states from block to block."""
    b, a = s[:3] / s[3], s[3:] / s[3]
    A = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    B = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    n = len(x)
    size = min(_BLOCK, max(n, 1))
    powers = np.empty((size + 1, 2, 2))
    powers[0] = np.eye(2)
    for i in range(size):
        powers[i + 1] = A @ powers[i]
    h = np.concatenate(([b[0]], powers[: size - 1, 0, :] @ B))
    T = np.zeros((size, size))
    for i in range(size):
        T[i, : i + 1] = h[i::-1]
    into = (powers[size - 1 :: -1] @ B).T  # state after a block, by its inputs
    blocks = np.pad(x, (0, -n % size)).reshape(-1, size)
    pushed = blocks @ into.T
    states = np.empty((len(blocks), 2))
    step = powers[size]
    for k in range(len(blocks)):
        states[k] = z
        z = step @ z + pushed[k]
    return (blocks @ T.T + states @ powers[:size, 0, :].T).ravel()[:n]


def steady_states(sos: np.ndarray) -> np.ndarray:
    """States in which a constant input of 1 gives a constant output."""
    out, scale = [], 1.0
    for s in sos:
        b, a = s[:3] / s[3], s[3:] / s[3]
        A = np.array([[-a[1], 1.0], [-a[2], 0.0]])
        out.append(scale * np.linalg.solve(np.eye(2) - A, [b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))
        scale *= b.sum() / a.sum()
    return np.array(out)


def forward(sos: np.ndarray, x: np.ndarray, z: np.ndarray | None = None) -> np.ndarray:
    y = np.asarray(x, float)
    for s, state in zip(sos, np.zeros((len(sos), 2)) if z is None else z, strict=True):
        y = _section(s, y, state)
    return y


def pad_length(sos: np.ndarray) -> int:
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter forward and back with odd extension at both ends; raises ValueError for arrays no longer than the padding."""
    x = np.asarray(x, float)
    pad = pad_length(sos)
    if len(x) <= pad:
        raise ValueError(f"{len(x)} samples are no more than the padding of {pad}")
    full = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = steady_states(sos)
    y = forward(sos, full, z * full[0])
    y = forward(sos, y[::-1], z * y[-1])[::-1]
    return y[pad:-pad]
