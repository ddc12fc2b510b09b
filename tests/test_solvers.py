import time

import numpy as np
import pytest

from millrace.operators import solvers
from millrace.operators.stats import Gram


def gram(x, y):
    z = np.column_stack((x, y))
    return Gram(float(len(z)), z.sum(0), z.T @ z)


def folds_of(x, y, n=3):
    return {k: gram(a, b) for k, (a, b) in enumerate(zip(np.array_split(x, n), np.array_split(y, n), strict=True))}


def data(seed, n, p):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 0.7 * rng.normal(size=(n, 1))
    return x, x[:, 1] - 2 * x[:, p // 2] + 0.5 * x[:, p - 1] + rng.normal(size=n) + 3


def plain_forward(folds, k):
    """Every candidate solved anew."""
    total, chosen = sum(folds.values(), Gram(0.0, 0.0, 0.0)), []
    p = len(total.sums) - 1
    while len(chosen) < k:
        scores = {}
        for j in (j for j in range(p) if j not in chosen):
            scores[j] = 0.0
            for held in folds.values():
                rest, w = total - held, np.zeros(p)
                w[[*chosen, j]] = solvers.ridge(rest, [*chosen, j])
                scores[j] += 1 - held.loss(w, solvers.intercept_of(rest, w, True)) / (held.n * held.centred[2])
        chosen.append(max(scores, key=lambda j: (scores[j], -j)))
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_forward_is_plain(seed):
    folds = folds_of(*data(seed, 90, 12))
    assert set(solvers.forward(folds, 6)) == set(plain_forward(folds, 6))


def plain_eliminate(g, k, step=0.1):
    left = list(range(len(g.sums) - 1))
    drop = max(1, int(step * len(left)))
    while len(left) > k:
        gone = np.argsort(solvers.ridge(g, left) ** 2, kind="stable")[: min(drop, len(left) - k)]
        left = [c for i, c in enumerate(left) if i not in gone]
    return left


def plain_swap(G, b, yy, S, passes=20):
    S = list(S)
    loss = lambda s: float(yy - b[s] @ np.linalg.lstsq(G[np.ix_(s, s)], b[s], rcond=None)[0])
    now = loss(S)
    for _ in range(passes):
        improved = False
        for i in range(len(S)):
            rest = S[:i] + S[i + 1 :]
            outside = np.setdiff1d(np.arange(len(b)), S)
            gain = (b[outside] - G[np.ix_(outside, rest)] @ np.linalg.lstsq(G[np.ix_(rest, rest)], b[rest], rcond=None)[0]) ** 2
            tried = [*rest, int(outside[gain.argmax()])]
            if loss(tried) < now - 1e-12 * max(abs(now), 1.0):
                S, now, improved = tried, loss(tried), True
        if not improved:
            break
    return S


@pytest.mark.parametrize("seed", range(4))
def test_eliminate_and_swap_are_plain(seed):
    x, y = data(seed, 200, 25)
    g = gram(x, y)
    assert sorted(solvers.eliminate(g, 7)) == plain_eliminate(g, 7)
    G, b, yy = g.centred
    start = list(np.random.default_rng(seed).choice(25, 6, replace=False))
    assert solvers.swap(G, b, yy, start) == plain_swap(G, b, yy, start)


def test_swap_of_dependent_columns():
    x, y = data(1, 100, 8)
    x[:, 3] = x[:, 1]
    G, b, yy = gram(x, y).centred
    S = solvers.swap(G, b, yy, [1, 3, 0])
    assert len(set(S)) == 3 and 4 in S


def test_hundred_of_seven_hundred_columns():
    x, y = data(2, 1500, 700)
    began = time.perf_counter()
    assert len(set(solvers.forward(folds_of(x, y), 100))) == 100
    assert len(solvers.eliminate(gram(x, y), 100)) == 100
    G, b, yy = gram(x, y).centred
    solvers.swap(G, b, yy, list(range(100)), 2)
    assert time.perf_counter() - began < 120
