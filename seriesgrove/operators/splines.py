"""Cubic B-splines on grids: interpolation, and approximation of scattered values at several levels."""

from __future__ import annotations

import numpy as np

#: The pole of the cubic B-spline's inverse filter, and the samples after which its share is below 1e-10.
POLE = 3**0.5 - 2
HALO = 18
#: Matrices by their sizes; not to be written to.
_kept: dict[tuple, np.ndarray] = {}


def coefficients(a: np.ndarray) -> np.ndarray:
    """Coefficients whose cubic B-spline meets every sample of ``a``, mirrored at the first and last one.

    Along each axis the samples pass a recursive filter forth and back.
    """
    c = np.array(a, np.float64)
    for axis in range(c.ndim):
        n = c.shape[axis]
        if n < 2:
            continue
        v = np.moveaxis(c, axis, 0)
        v *= 6
        k = np.arange(1, n - 1).reshape(-1, *[1] * (c.ndim - 1))
        v[0] = (v[0] + POLE ** (n - 1) * v[-1] + ((POLE**k + POLE ** (2 * n - 2 - k)) * v[1:-1]).sum(axis=0)) / (1 - POLE ** (2 * n - 2))
        for i in range(1, n):
            v[i] += POLE * v[i - 1]
        v[-1] = POLE / (POLE**2 - 1) * (POLE * v[-2] + v[-1])
        for i in range(n - 2, -1, -1):
            v[i] = POLE * (v[i + 1] - v[i])
    return c


def weights(t: np.ndarray) -> np.ndarray:
    """(4, n): what the four coefficients about a place weigh, ``t`` being its distance from the second one."""
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.minimum(i, 2 * n - 2 - i)


def evaluate(c: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The spline of coefficients ``c`` (z, y, x) at (n, 3) index points in x, y, z."""
    at, w = [], []
    for axis, n in enumerate(c.shape[::-1]):
        low = np.floor(points[:, axis]).astype(np.int64)
        w.append(weights(points[:, axis] - low))
        at.append([mirrored(low + k, n) for k in range(-1, 3)])
    out = np.zeros(len(points))
    for k in range(4):
        for j in range(4):
            row = sum(w[0][i] * c[at[2][k], at[1][j], at[0][i]] for i in range(4))
            out += w[2][k] * w[1][j] * row
    return out


# --- approximation ----------------------------------------------------------------


def basis(n: int, spans: int) -> np.ndarray:
    """(n, spans + 3): what the controls of a spline of ``spans`` pieces over n samples weigh at each sample."""
    if n == 1:
        at = np.zeros(1)
    else:
        at = np.arange(n) * (spans / (n - 1))
    low = np.minimum(at.astype(np.int64), spans - 1)
    out, w = np.zeros((n, spans + 3)), weights(at - low)
    for k in range(4):
        out[np.arange(n), low + k] = w[k]
    return out


def kept(kind: str, n: int, spans: int) -> np.ndarray:
    """``basis``, its squares, or its cubes as a share of the sample's squares; made once in a task."""
    if (kind, n, spans) not in _kept:
        x = basis(n, spans)
        _kept[kind, n, spans] = {"basis": x, "square": x**2, "share": x**3 / (x**2).sum(axis=1, keepdims=True)}[kind]
    return _kept[kind, n, spans]


def along(a: np.ndarray, m: list[np.ndarray]) -> np.ndarray:
    """``a`` (z, y, x) times a matrix along each axis; the first axis becomes the last one, three times."""
    for x in m:
        a = (a.reshape(a.shape[0], -1).T @ x).reshape(*a.shape[1:], x.shape[1])
    return a


def asked_weights(inside: np.ndarray, spans: tuple[int, int, int]) -> np.ndarray:
    """The squares of a control's weights, summed over the cells ``inside``."""
    return along(inside.astype(np.float64), [kept("square", n, s) for n, s in zip(inside.shape, spans, strict=True)])


def approximate(values: np.ndarray, inside: np.ndarray, spans: tuple[int, int, int], total: np.ndarray | None = None) -> np.ndarray:
    """Controls of the spline that comes near to the values at the cells ``inside``.

    Every value asks its 64 controls for the least change that would meet it; a
    control takes the mean of what it is asked for, weighed by the squares of its
    own weights there.  On a grid both sums are products along the axes; ``total``
    is ``asked_weights``, for several fits of the same cells.
    """
    asked = along(np.where(inside, values, 0.0), [kept("share", n, s) for n, s in zip(values.shape, spans, strict=True)])
    total = asked_weights(inside, spans) if total is None else total
    return np.where(total > 1e-12, asked / np.maximum(total, 1e-12), 0.0)


def surface(controls: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """The spline of the controls at every cell of a grid."""
    return along(controls, [kept("basis", n, s - 3).T for n, s in zip(shape, controls.shape, strict=True)])


def refined(controls: np.ndarray) -> np.ndarray:
    """Controls of the same spline with twice the pieces."""
    for axis in range(3):
        c = np.moveaxis(controls, axis, 0)
        out = np.empty((2 * (c.shape[0] - 3) + 3, *c.shape[1:]))
        n = out.shape[0]
        middle = (c[:-2] + 6 * c[1:-1] + c[2:]) / 8  # controls that stand where an old one stood
        between = (c[:-1] + c[1:]) / 2
        out[1::2] = middle[: len(out[1::2])]
        out[0::2] = between[: (n + 1) // 2]
        controls = np.moveaxis(out, 0, axis)
    return controls
