"""Singular values and right vectors of a small triangular matrix by way of a bidiagonal one.

Householder reflections make it bidiagonal, dqds gives the squares of its singular values with high relative
accuracy, and a twisted factorisation of the tridiagonal product, shifted by such a square, gives the vector from the
place where the two sweeps meet best.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V with r = U B V^T."""
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)
    for k in range(d):
        h = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * h, h @ a[k:, k:])
        if k < d - 2:
            h = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ h, 2 * h)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, 2 * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection turns ``x`` onto its first axis; zero where ``x`` is zero."""
    h, norm = np.array(x, float), np.linalg.norm(x)
    if not norm:
        return h
    h[0] += np.copysign(norm, h[0])
    return h / np.linalg.norm(h)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling, of the bidiagonal with squares ``q`` and ``e``."""
    out: list[float] = []
    stack = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        if not q:
            continue
        n = len(q)
        cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + q[i + 1]) or e[i] <= EPS * EPS * q[i]), None)
        if n == 1 or cut == n - 2:
            out.append(max(0.0, q[-1] + sigma))
            stack.append((q[:-1], e[: n - 2], sigma))
            continue
        if cut is not None:
            stack += [(q[: cut + 1], e[:cut], sigma), (q[cut + 1 :], e[cut + 1 :], sigma)]
            continue
        if q[0] < q[-1]:
            # The same values, graded so that the smallest come out at the end.
            q, e = q[::-1], e[::-1]
            q, e = _step(q, e, 0.0)[:2]
        # The smaller root of the last two rows, a guess; too large a shift shows as a negative pivot.
        shift = _smaller_root(q[-2] + (e[-2] if n > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1], q[-1])
        while True:
            next_q, next_e, least = _step(q, e, shift)
            if least >= 0:
                break
            shift = shift / 4 if shift > EPS * sigma else 0.0
        stack.append((next_q, next_e, sigma + shift))
    return np.array(sorted(out, reverse=True))


def _smaller_root(a: float, bb: float, c: float, bound: float) -> float:
    """The smaller eigenvalue of ((a, b), (b, c)) with b^2 = bb, at most ``bound`` and not negative."""
    half = (a - c) / 2
    root = (a + c) / 2 - np.hypot(half, np.sqrt(bb))
    return float(min(max(0.0, root), bound) * (1 - 4 * EPS))


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transformation with a shift, and its least pivot."""
    d, least, out_q, out_e = q[0] - shift, np.inf, [], []
    for i in range(len(q) - 1):
        least = min(least, d)
        if d < 0:
            return q, e, d
        s = d + e[i]
        out_q.append(s)
        ratio = q[i + 1] / s if s else 0.0
        out_e.append(e[i] * ratio)
        d = d * ratio - shift if s else q[i + 1] - shift
    out_q.append(d)
    return out_q, out_e, min(least, d)


def twisted_vectors(q: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal B^T B for its eigenvalues ``values``, falling.

    B has squares ``q`` on its diagonal and ``e`` above. Each vector comes from the twist with the smallest
    remainder; within a group of eigenvalues too close to tell apart the next ones take other twists and are made orthogonal to those before.
    """
    n, out = len(q), []
    for k, value in enumerate(values):
        remainders, up, down = _twists(q, e, value)
        group = [out[j] for j in range(k) if values[j] - value <= 1e-9 * values[j]]
        best = None
        for r in np.argsort(np.abs(remainders))[: len(group) + 2 if group else 1].tolist():
            z = np.zeros(n)
            z[r] = 1.0
            for i in range(r - 1, -1, -1):
                z[i] = -up[i] * z[i + 1]
            for i in range(r, n - 1):
                z[i + 1] = -down[i] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                for other in group:
                    z -= (other @ z) * other
            if best is None or np.linalg.norm(z) > np.linalg.norm(best):
                best = z
        out.append(best / np.linalg.norm(best))
    return np.array(out).T.reshape(n, len(out))


def _twists(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The remainder of each twist, and the factors of the sweep from above and from below.

    B^T B = L D L^T with D = q and L's subdiagonal l = sqrt(e / q).
    """
    n, tiny = len(q), np.finfo(float).tiny
    l = np.sqrt(e / np.maximum(q[:-1], tiny))  # noqa: E741
    up, s = np.zeros(max(0, n - 1)), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        d = (s[i] + q[i]) or tiny
        up[i] = q[i] * l[i] / d
        s[i + 1] = up[i] * l[i] * s[i] - value
    down, p = np.zeros(max(0, n - 1)), np.zeros(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        if not l[i]:
            # Nothing joins the rows below: the matrix ends here.
            p[i] = q[i] - value
            continue
        d = (q[i] * l[i] * l[i] + p[i + 1]) or tiny
        t = q[i] / d
        down[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    return s + p + value, up, down


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squares of singular values of ``r`` that are no rounding noise, at most ``most``, and their right vectors (columns)."""
    scale = np.abs(r).max(initial=0.0)
    if not scale or not np.isfinite(scale):
        return np.empty(0), np.empty((r.shape[1], 0))
    diagonal, above, v = bidiagonalised(r / scale)
    size = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    # A zero on the diagonal would end the factorisation; one below rounding changes nothing.
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * size, EPS * EPS * size, diagonal)
    q, e = diagonal**2, above**2
    squares = dqds(q, e)[:most]
    squares = squares[squares > (len(diagonal) * EPS) ** 2 * squares[0] * 16]
    sign = np.ones(len(q))
    # With squares alone every off-diagonal counts as positive: signs follow from those of B.
    for i in range(len(q) - 1):
        sign[i + 1] = sign[i] * (np.sign(diagonal[i] * above[i]) or 1.0)
    z = sign[:, None] * twisted_vectors(q, e, squares)
    return squares * scale**2, v @ z
