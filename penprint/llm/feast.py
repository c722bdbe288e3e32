"""Largest eigenpairs of a symmetric matrix by contour integration over eigenvalue intervals.

Inertia counts (the signs of the pivots of a symmetric factorisation) say how many eigenvalues lie above a bound. Bisection with them
finds intervals around the wanted eigenvalues, cut where the spectrum has gaps. For each interval, a quadrature of shifted complex solves along a circle
filters a block of vectors down to its invariant subspace, Rayleigh-Ritz extracts eigenpairs from it, and the count must
agree with the inertia, so none is missed.
"""

from __future__ import annotations

import numpy as np

NODES = 8  # of the quadrature on half a circle
TOGETHER = 8  # eigenvalues in one interval, if there are gaps to cut at
ROUNDS = 40
PIVOT = (1 + 17**0.5) / 8


def negative_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues are below zero: signs of the pivots of L D L', with pivots of one or two rows (complete pivoting)."""
    a = np.array(matrix, float)
    count = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        best = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        row, column = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[best] == 0 and off[row, column] == 0:
            break
        single = diagonal[best] >= PIVOT * off[row, column]
        chosen = [best] if single else [int(column), int(row)]
        rest = [i for i in range(len(a)) if i not in chosen]
        pivot, side = a[np.ix_(chosen, chosen)], a[np.ix_(rest, chosen)]
        # A pivot of two rows has a negative determinant: one eigenvalue on either side.
        count += int(pivot[0, 0] < 0) if single else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
    return count


def count_above(matrix: np.ndarray, bound: float) -> int:
    return negative_pivots(bound * np.eye(len(matrix)) - matrix)


def spectrum_intervals(matrix: np.ndarray, k: int, top: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that together hold at least the ``k`` largest eigenvalues.

    Brackets of the leading eigenvalues are found by bisection; cuts lie in the middle of the widest gaps. Eigenvalues that cannot be told
    apart stay in one interval.
    """
    n, width = len(matrix), 1e-5 * top
    known = {-top: n, 1.01 * top: 0}

    def bracket(place: int) -> tuple[float, float]:
        """Bounds of the ``place``-th largest eigenvalue."""
        low = max(b for b, c in known.items() if c >= place)
        high = min(b for b, c in known.items() if c < place)
        while high - low > width:
            middle = (low + high) / 2
            known[middle] = count_above(matrix, middle)
            low, high = (middle, high) if known[middle] >= place else (low, middle)
        return low, high

    brackets: list[tuple[float, float]] = []
    out: list[tuple[float, float, int]] = []
    begin, ceiling = 0, 1.01 * top
    while begin < min(k, n):
        best, best_gap = n, 0.0
        for place in range(begin + 1, n):  # a cut after ``place`` eigenvalues
            while len(brackets) < place + 1:
                brackets.append(bracket(len(brackets) + 1))
            gap = brackets[place - 1][0] - brackets[place][1]
            if gap > best_gap:
                best, best_gap = place, gap
            if place >= begin + TOGETHER and best_gap > 20 * width:
                break
        floor = (brackets[best - 1][0] + brackets[best][1]) / 2 if best < n else -0.01 * top
        out.append((floor, ceiling, best - begin))
        begin, ceiling = best, floor
    return out


def interval_pairs(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high), falling, and their unit eigenvectors as columns."""
    n = len(matrix)
    size = min(n, max(count + 4, -(-3 * count // 2)))
    scale = np.abs(matrix).sum(1).max()
    middle, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - at)
    block = np.random.default_rng(seed).standard_normal((n, size))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(ROUNDS):
        filtered = np.zeros((n, size))
        for angle, w in zip(angles, weight):
            turn = radius * np.exp(1j * angle)
            filtered += w / 2 * (turn * np.linalg.solve((middle + turn) * np.eye(n) - matrix, block.astype(complex))).real
        basis = np.linalg.qr(filtered)[0]
        values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ inner
        errors = np.linalg.norm(matrix @ vectors - vectors * values, axis=0) / scale
        inside = np.flatnonzero((values > low) & (values < high) & (errors < 1e-6))[::-1]
        if len(inside) == count:
            error = float(errors[inside].max(initial=0))
            if best is not None and error > best[0] / 4:  # as good as the arithmetic allows
                return min(best, (error, values[inside], vectors[:, inside]), key=lambda b: b[0])[1:]
            best = (error, values[inside], vectors[:, inside])
            if error < 1e-16:
                break
        elif len(inside) > count:
            raise ArithmeticError(f"{len(inside)} eigenvalues where inertia counts {count}")
        block = vectors
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"the contour integration did not find the {count} eigenvalues between {low} and {high}")
    return best[1:]


def largest_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` largest positive eigenvalues of a covariance matrix, falling, and unit eigenvectors as rows.

    Eigenvalues that are zero but for rounding are left out. The largest entry of every vector (the first, on ties) is positive.
    """
    top = float(np.abs(matrix).sum(1).max(initial=0))
    if top == 0 or k < 1:
        return np.zeros(0), np.zeros((0, len(matrix)))
    pairs = [interval_pairs(matrix, low, high, count) for low, high, count in spectrum_intervals(matrix, k, top)]
    values = np.concatenate([p[0] for p in pairs])[:k]
    vectors = np.concatenate([p[1] for p in pairs], axis=1).T[:k]
    real = values > 16 * len(matrix) * np.finfo(float).eps * top
    values, vectors = values[real], vectors[real]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)]) if len(vectors) else np.zeros(0)
    return values, vectors * signs[:, None]
