"""Special functions, optimisers and hidden Markov models in numpy, for models over positions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_q(a: float, x: float) -> float:
    return 1 - gamma_p(a, x)


def chi2_tail(x: float, k: float) -> float:
    """P that a chi-squared variable of ``k`` degrees is ``x`` or more."""
    return gamma_q(k / 2, x / 2)


def golden_minimum(f: Callable[[float], float], lo: float, hi: float, tolerance: float = 1e-9) -> float:
    """The minimum of a unimodal function by golden sections."""
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    while hi - lo > tolerance:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def pattern_search(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, least: float = 1e-7) -> np.ndarray:
    """Hooke and Jeeves: moves along axes, then along what helped, halving the step where nothing does."""

    def explore(x: np.ndarray, fx: float) -> tuple[np.ndarray, float]:
        x = x.copy()
        for i in range(len(x)):
            for s in (step, -step):
                y = x.copy()
                y[i] += s
                if (fy := f(y)) < fx:
                    x, fx = y, fy
                    break
        return x, fx

    base, best = np.asarray(start, float), f(np.asarray(start, float))
    while step > least:
        x, fx = explore(base, best)
        while fx < best:
            before, base, best = base, x, fx
            x, fx = explore(2 * base - before, f(2 * base - before))
        step /= 2
    return base


def allele_frequency_em(likelihoods: np.ndarray, start: float = 0.2, rounds: int = 100) -> float:
    """ALT frequency of a site from samples' likelihoods of 0, 1, 2 copies, under random mating."""
    f = start
    for _ in range(rounds):
        w = likelihoods * np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])
        w /= w.sum(axis=1, keepdims=True)
        new = float((w @ np.array([0.0, 0.5, 1.0])).mean())
        if abs(new - f) < 1e-12:
            break
        f = new
    return f


class Chain:
    """A hidden Markov model over positions; the transition over a distance is the matrix to its power."""

    def __init__(self, move: np.ndarray, start: np.ndarray | None = None) -> None:
        self.move = np.asarray(move, float)
        self.start = np.full(len(move), 1 / len(move)) if start is None else np.asarray(start, float)

    def over(self, distance: int) -> np.ndarray:
        return np.linalg.matrix_power(self.move, max(1, int(distance)))

    def viterbi(self, emit: np.ndarray, positions: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            score, back, logs = np.log(self.start) + np.log(emit[0]), [], np.log(emit)
            for i in range(1, len(emit)):
                paths = score[:, None] + np.log(self.over(positions[i] - positions[i - 1]))
                back.append(paths.argmax(axis=0))
                score = paths.max(axis=0) + logs[i]
        state = [int(score.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        return np.array(state[::-1])

    def posterior(self, emit: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """P of each state at each position, by forward and backward passes."""
        n = len(emit)
        f, b = np.zeros_like(emit, float), np.ones_like(emit, float)
        f[0] = self.start * emit[0]
        f[0] /= f[0].sum()
        for i in range(1, n):
            f[i] = (f[i - 1] @ self.over(positions[i] - positions[i - 1])) * emit[i]
            f[i] /= f[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = self.over(positions[i + 1] - positions[i]) @ (emit[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, emit: np.ndarray, positions: np.ndarray, rounds: int = 20) -> Chain:
        """Transitions by expectation maximisation, taking neighbours as one step apart."""
        chain = self
        for _ in range(rounds):
            p = chain.posterior(emit, positions)
            count = np.zeros_like(chain.move)
            for i in range(1, len(emit)):
                joint = p[i - 1][:, None] * chain.move * (emit[i] * p[i] / np.maximum(p[i - 1] @ chain.move * emit[i], 1e-300))[None, :]
                count += joint / max(joint.sum(), 1e-300)
            chain = Chain(count / np.maximum(count.sum(axis=1, keepdims=True), 1e-300), chain.start)
        return chain
