"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor of a shifted matrix is the sign of its eigenvalues, so half of it plus half the identity projects on those above the shift. Bases of the
projector's range and of its complement split the matrix into two smaller ones, which are split again until they are
of one row or have a single eigenvalue. Polar factors come from the dynamically weighted Halley iteration by QR and Cholesky
factorisations (QDWH), which needs no more than about six steps at double precision.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# Steps of the Halley iteration at most, and shifts tried until one splits a matrix.
MOST_STEPS = 40
SHIFTS = 60
# A step with a weight over this is taken by QR, which is stable for any; smaller ones by Cholesky.
QR_WEIGHT = 100.0


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvectors with the signs of its eigenvalues."""
    n = len(a)
    one = np.eye(n)
    # The largest eigenvalue in size is at most the least of these norms, and the smallest one is met by a lower bound
    # that only costs steps when it is too low.
    high = min(np.linalg.norm(a), np.abs(a).sum(0).max())
    x = a / high
    low = max(1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n)) if np.linalg.cond(x, 1) < 1 / EPS else EPS, EPS)
    for _ in range(MOST_STEPS):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if r > QR_WEIGHT:
            base, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
            new = q / r * x + (p - q / r) / np.sqrt(r) * base[:n] @ base[n:].T
        else:
            half = np.linalg.cholesky(one + r * x.T @ x)
            solved = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
            new = q / r * x + (p - q / r) * solved
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) and 1 - low <= 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, draws: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span a projector's range."""
    base, _ = np.linalg.qr(projector @ draws.standard_normal((len(projector), rank)))
    base, _ = np.linalg.qr(projector @ base)
    return base


def _split(a: np.ndarray, draws: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift, or nothing where all eigenvalues are the same to rounding."""
    n = len(a)
    size = np.linalg.norm(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 4 * n * EPS * size:
        return None
    # The mean lies strictly between the extremes; a shift too near an eigenvalue leaves no clean projector and is moved.
    for turn in range(SHIFTS):
        shift = middle if turn == 0 else middle + (draws.random() - 0.5) * spread / np.sqrt(n) * min(1.0, turn / 8)
        moved = a - shift * np.eye(n)
        if not np.any(moved):
            continue
        sign = polar(moved)
        rank = int(round((np.trace(sign) + n) / 2))
        if 0 < rank < n and np.linalg.norm(sign @ sign - np.eye(n)) <= 1e-9 * n:
            upper, lower = _basis((np.eye(n) + sign) / 2, rank, draws), _basis((np.eye(n) - sign) / 2, n - rank, draws)
            if np.linalg.norm(lower.T @ a @ upper) <= 1e-11 * n * size:
                return upper, lower
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    a = np.asarray(a, float)
    n = len(a)
    # A matrix that is tiny or huge is split at a handy scale.
    scale = np.abs(a).max(initial=0.0)
    if n == 0 or scale == 0:
        return np.zeros(n), np.eye(n)
    draws = np.random.default_rng(n)
    whole = (a + a.T) / 2 / scale
    found: list[np.ndarray] = []
    pending = [np.eye(n)]
    while pending:
        base = pending.pop()
        part = base.T @ whole @ base
        part = (part + part.T) / 2
        split = _split(part, draws) if len(part) > 1 else None
        if split is None:
            found.append(base)
            continue
        pending += [base @ split[1], base @ split[0]]
    vectors = np.hstack(found)
    # One orthogonalisation against the rounding of the products.
    vectors, turned = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(turned) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", vectors, whole @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, vectors[:, order]
