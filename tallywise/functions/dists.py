"""Scalar distribution functions for the last step of a test, on values that Spark has already aggregated."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_two_sided(w: float, doubled_ranks: list[tuple[int, int]]) -> float | None:
    """Exact p value of the smaller rank sum ``w``. ``doubled_ranks``: twice the rank, and how many pairs have it.

    ``ways[s]`` counts the choices of ranks whose doubled sum is s, built up rank by rank. None without any pair.
    """
    if not doubled_ranks:
        return None
    ways = np.zeros(sum(r * t for r, t in doubled_ranks) + 1)
    ways[0] = 1.0
    for rank, times in doubled_ranks:
        for _ in range(times):
            ways[rank:] += ways[:-rank].copy()
    return min(1.0, 2 * float(ways[: round(2 * w) + 1].sum() / ways.sum()))


def _quadrature(f, low: float, high: float, panels: int = 64, order: int = 32) -> float:
    nodes, weights = np.polynomial.legendre.leggauss(order)
    edges = np.linspace(low, high, panels + 1)
    half = np.diff(edges) / 2
    points = (edges[:-1] + half)[:, None] + half[:, None] * nodes[None, :]
    return float(np.sum(f(points) * weights[None, :] * half[:, None]))


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, integrated in the logit of x around the mode."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    target = math.log(x) - math.log1p(-x)
    centre = math.log(a / b)
    width = math.sqrt(1.0 / a + 1.0 / b)
    low = min(centre, target) - 40 * width - 40.0 / min(a, 1.0)
    norm = _log_beta(a, b)

    def density(t):
        return np.exp(-a * np.logaddexp(0, -t) - b * np.logaddexp(0, t) - norm)

    near = max(low, min(centre, target) - 12 * width)
    value = _quadrature(density, near, target)
    if near > low:
        value += _quadrature(density, low, near)
    return min(1.0, max(0.0, value))


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution by bisection on the log scale."""
    low, high = -1.0, 1.0
    while f_cdf(math.exp(low), d1, d2) > p:
        low *= 2
    while f_cdf(math.exp(high), d1, d2) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if f_cdf(math.exp(mid), d1, d2) < p:
            low = mid
        else:
            high = mid
    return math.exp((low + high) / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def log_jzs_bayes_factor(t: float, n: float, scale: float = 0.707) -> float:
    """Natural log of the paired-t Bayes factor BF10 with a Cauchy prior, integrated over log g."""
    df = n - 1
    null = (df + 1) / 2 * math.log1p(t * t / df)

    def log_integrand(u):
        g = np.exp(u)
        spread = 1 + n * g * scale**2
        return (
            -0.5 * np.log(spread)
            - (df + 1) / 2 * np.log1p(t * t / (spread * df))
            + null
            - 0.5 * math.log(2 * math.pi)
            - 0.5 * u
            - 0.5 / g
        )

    low, high = -9.0, 60.0
    peak = float(np.max(log_integrand(np.linspace(low, high, 4001))))
    total = _quadrature(lambda u: np.exp(log_integrand(u) - peak), low, high, panels=300, order=16)
    return peak + math.log(total)
