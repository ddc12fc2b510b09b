"""Penalised least squares and subset searches on sufficient statistics: no row is read here.

``G`` is X'X / n, ``b`` X'y / n and ``yy`` y'y / n, centred where an intercept is fitted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .stats import Gram


def descend(G: np.ndarray, b: np.ndarray, update: Callable[[int, float], float], w: np.ndarray, max_iter: int, tol: float, every: int = 5, scaled: bool = False) -> np.ndarray:
    """Coordinate descent: ``update(j, b_j - (G w)_j [+ G_jj w_j])`` gives a coordinate's new value.

    Every ``every``-th sweep goes over all coordinates, others over those that aren't zero. Stops when no coordinate moves by ``tol``.
    """
    w, drift, every_j = w.copy(), G @ w, np.arange(len(b))
    for sweep in range(max_iter):
        active = np.flatnonzero(w)
        moved = 0.0
        for j in every_j if sweep % every == 0 or not len(active) else active:
            new = update(j, b[j] - drift[j] + (G[j, j] if scaled else 1.0) * w[j])
            if new != w[j]:
                drift += G[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved < tol:
            break
    return w


def mcp(G: np.ndarray, b: np.ndarray, lam: float, gamma: float = 5.0, positive: bool = False, max_iter: int = 200, tol: float = 1e-5, w: np.ndarray | None = None) -> np.ndarray:
    def update(_: int, z: float) -> float:
        size = abs(z)
        if size <= lam or (positive and z < 0):
            return 0.0
        return float(np.sign(z) * (size - lam) / (1 - 1 / gamma)) if size <= gamma * lam else z

    return descend(G, b, update, np.zeros(len(b)) if w is None else w, max_iter, tol)


def mcp_path(G: np.ndarray, b: np.ndarray, target: int, gamma: float = 5.0, positive: bool = False, max_iter: int = 200, tol: float = 1e-5, length: int = 50) -> np.ndarray:
    """Warm starts from the largest useful penalty down, until ``target`` coordinates are in."""
    w = np.zeros(len(b))
    top = float(np.abs(b).max())
    for lam in np.geomspace(top, top * 1e-3, length) if top > 0 else ():
        w = mcp(G, b, lam, gamma, positive, max_iter, tol, w)
        if np.count_nonzero(w) >= target:
            break
    return w


def elastic_net(G: np.ndarray, b: np.ndarray, alpha: float, l1: float, positive: bool, max_iter: int = 1000, tol: float = 1e-6, w: np.ndarray | None = None) -> np.ndarray:
    def update(j: int, z: float) -> float:
        if positive and z <= 0:
            return 0.0
        size = abs(z) - alpha * l1
        return float(np.sign(z) * size / (G[j, j] + alpha * (1 - l1))) if size > 0 and G[j, j] > 0 else 0.0

    return descend(G, b, update, np.zeros(len(b)) if w is None else w, max_iter, tol, scaled=True)


def moments(gram: Gram, intercept: bool) -> tuple[np.ndarray, np.ndarray, float]:
    return gram.centred if intercept else gram.raw()


def intercept_of(gram: Gram, w: np.ndarray, intercept: bool) -> float:
    mean = gram.sums / gram.n
    return float(mean[-1] - mean[:-1] @ w) if intercept else 0.0


def elastic_net_cv(folds: dict[int, Gram], l1_ratios: Sequence[float], n_alphas: int, positive: bool, intercept: bool = True, eps: float = 1e-3, max_iter: int = 1000) -> tuple[np.ndarray, float, float, float]:
    """(w, intercept, alpha, l1 ratio) of least mean squared error over the folds, refitted on all."""
    total = sum(folds.values(), Gram(0.0, 0.0, 0.0))
    G, b, _ = moments(total, intercept)
    best = (np.inf, 0.0, 0.0)
    for l1 in l1_ratios:
        top = max(float(np.abs(b).max()) / l1, 1e-12)
        alphas = np.geomspace(top, top * eps, n_alphas)
        errors = np.zeros(n_alphas)
        for held in folds.values():
            rest = total - held
            Gr, br, _ = moments(rest, intercept)
            w = np.zeros(len(b))
            for i, a in enumerate(alphas):
                w = elastic_net(Gr, br, a, l1, positive, max_iter, w=w)
                errors[i] += held.loss(w, intercept_of(rest, w, intercept)) / held.n
        i = int(errors.argmin())
        if errors[i] < best[0]:
            best = (float(errors[i]), float(alphas[i]), l1)
    _, alpha, l1 = best
    w = elastic_net(G, b, alpha, l1, positive, max_iter)
    return w, intercept_of(total, w, intercept), alpha, l1


def ridge(gram: Gram, columns: Sequence[int], penalty: float = 1.0) -> np.ndarray:
    G, b, _ = gram.centred
    S = np.asarray(columns)
    return np.linalg.solve(gram.n * G[np.ix_(S, S)] + penalty * np.eye(len(S)), gram.n * b[S])


def bordered(M: np.ndarray, g: np.ndarray, d: float) -> np.ndarray:
    """The inverse of [[A, g], [g', d]] from M, A's inverse."""
    u = M @ g
    rest = d - g @ u
    return np.block([[M + np.outer(u, u) / rest, -u[:, None] / rest], [-u[None, :] / rest, np.array([[1 / rest]])]])


def without(M: np.ndarray, gone: Sequence[int]) -> np.ndarray:
    """The inverse of A less some rows and columns from M, A's inverse."""
    left = np.setdiff1d(np.arange(len(M)), gone)
    return M[np.ix_(left, left)] - M[np.ix_(left, gone)] @ np.linalg.solve(M[np.ix_(gone, gone)], M[np.ix_(gone, left)])


def eliminate(gram: Gram, k: int, step: float = 0.1) -> list[int]:
    """Recursive elimination by ridge; the kept columns by falling |coefficient|. One inverse, from which eliminated columns are taken out."""
    G, b, _ = gram.centred
    left = list(range(len(b)))
    drop = max(1, int(step * len(left)))
    M = np.linalg.inv(gram.n * G + np.eye(len(b)))
    while len(left) > k:
        w = M @ (gram.n * b[left])
        gone = np.sort(np.argsort(w**2, kind="stable")[: min(drop, len(left) - k)])
        M, left = without(M, gone), [c for i, c in enumerate(left) if i not in set(gone.tolist())]
    w = ridge(gram, left)
    return [left[i] for i in np.argsort(-np.abs(w), kind="stable")]


class Candidates:
    """Ridge on chosen columns of one set of rows, scored on another; every column is tried at once, from the inverse for those chosen so far."""

    def __init__(self, rest: Gram, held: Gram) -> None:
        G, b, _ = rest.centred
        self.A, self.c = rest.n * G + np.eye(len(b)), rest.n * b
        self.mean, self.n = rest.sums / rest.n, held.n
        # Held-out rows about the other rows' means: sums and products of what an intercept leaves.
        m, s = self.mean, held.sums
        self.P = held.products - np.outer(m, s) - np.outer(s, m) + held.n * np.outer(m, m)
        self.total = max(held.n * held.centred[2], 1e-300)
        self.S: list[int] = []
        self.M = np.zeros((0, 0))

    def scores(self) -> np.ndarray:
        """R2 on the held-out rows with each column added to the chosen ones."""
        A, P, S = self.A, self.P, self.S
        w = self.M @ self.c[S]
        U = self.M @ A[S]
        left = np.diag(A) - np.einsum("kp,kp->p", A[S], U)
        left[S] = np.inf  # a chosen one adds nothing
        t = (self.c - A[:, S] @ w) / left
        PS = P[np.ix_(S, S)]
        Pw, PU = PS @ w, PS @ U
        square = w @ Pw - 2 * t * (U.T @ Pw) + t * t * np.einsum("kp,kp->p", U, PU)
        cross = 2 * t * (P[:-1, S] @ w - t * np.einsum("kp,kp->p", P[S, :-1], U)) + t * t * np.diag(P)[:-1]
        linear = P[-1, S] @ w - t * (P[-1, S] @ U) + t * P[-1, :-1]
        return 1 - (square + cross - 2 * linear + P[-1, -1]) / self.total

    def add(self, j: int) -> None:
        self.M = bordered(self.M, self.A[self.S, j], self.A[j, j])
        self.S.append(j)


def forward(folds: dict[int, Gram], k: int) -> list[int]:
    """Forward search by mean R2 of ridge over the folds; the kept columns by falling |coefficient|. Ties go to the first column."""
    total = sum(folds.values(), Gram(0.0, 0.0, 0.0))
    p = len(total.sums) - 1
    parts, chosen = [Candidates(total - held, held) for held in folds.values()], []
    while len(chosen) < min(k, p):
        score = sum(part.scores() for part in parts)
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
        for part in parts:
            part.add(chosen[-1])
    w = ridge(total, chosen)
    return [chosen[i] for i in np.argsort(-np.abs(w), kind="stable")]


def _fit(G: np.ndarray, b: np.ndarray, S: list[int]) -> np.ndarray:
    try:
        return np.linalg.solve(G[np.ix_(S, S)], b[S])
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(G[np.ix_(S, S)], b[S], rcond=None)[0]


def pursue(G: np.ndarray, b: np.ndarray, k: int) -> list[int]:
    """Orthogonal matching pursuit; the chosen columns in ascending order."""
    S: list[int] = []
    while len(S) < k:
        rest = np.abs(b - G[:, S] @ _fit(G, b, S)) if S else np.abs(b)
        rest[S] = -1
        j = int(rest.argmax())
        if rest[j] <= 1e-12:
            break
        S.append(j)
    return sorted(S)


def swap(G: np.ndarray, b: np.ndarray, yy: float, S: list[int], passes: int = 20) -> list[int]:
    """Replace members one by one where that lowers the residual; a member that comes in goes to the end of the list.

    The members' inverse is kept: one is taken out and another put in by updates. Members that depend on each other are solved anew.
    """
    S = list(S)
    loss = lambda s: float(yy - b[s] @ _fit(G, b, s))
    now = loss(S)
    for _ in range(passes):
        improved, M = False, _inverse(G, S)
        for i in range(len(S)):
            rest = S[:i] + S[i + 1 :]
            outside = np.setdiff1d(np.arange(len(b)), S)
            if not len(outside):
                break
            less = without(M, [i]) if M is not None else None
            w = less @ b[rest] if less is not None else _fit(G, b, rest)
            j = int(outside[((b[outside] - (G[np.ix_(outside, rest)] @ w if rest else 0)) ** 2).argmax()])
            tried, more = [*rest, j], None
            if less is not None:
                u = less @ G[rest, j]
                left = G[j, j] - G[rest, j] @ u
                if left > 1e-9 * G[j, j]:
                    more = (b[j] - G[j, rest] @ w) ** 2 / left
            new = float(yy - b[rest] @ w - more) if more is not None else loss(tried)
            if new < now - 1e-12 * max(abs(now), 1.0):
                M = bordered(less, G[rest, j], G[j, j]) if more is not None else _inverse(G, tried)
                S, now, improved = tried, new, True
        if not improved:
            break
    return S


def _inverse(G: np.ndarray, S: list[int]) -> np.ndarray | None:
    """The inverse of G on these columns, or None where they depend on each other."""
    try:
        M = np.linalg.inv(G[np.ix_(S, S)])
    except np.linalg.LinAlgError:
        return None
    return M if np.isfinite(M).all() and np.abs(M).max() * np.abs(G[np.ix_(S, S)]).max() < 1e10 else None


def deep(G: np.ndarray, b: np.ndarray, yy: float, k: int, multiplier: int = 3, passes: int = 20, gamma: float = 5.0) -> list[tuple[int, float]]:
    """Penalised pruning, pursuit, swaps; (column, |coefficient|), largest first."""
    k = min(k, len(b))
    w = mcp_path(G, b, min(max(multiplier * k, min(30 * k, len(b))), len(b)), gamma)
    kept = np.flatnonzero(w)
    kept = kept[np.argsort(-np.abs(w[kept]), kind="stable")]
    if len(kept) < k:
        return [(int(j), float(abs(w[j]))) for j in kept]
    Gk, bk = G[np.ix_(kept, kept)], b[kept]
    S = pursue(Gk, bk, k)
    S = swap(Gk, bk, yy, S, passes) if len(S) > 1 and passes > 0 else S
    size = np.abs(_fit(Gk, bk, S))
    return [(int(kept[S[i]]), float(size[i])) for i in np.argsort(-size, kind="stable")]
