"""Tail probabilities of test statistics, for the few numbers that reach the driver."""

from __future__ import annotations

import math


def chi2_sf(x: float, df: float) -> float:
    """P(X >= x) of a chi-squared variable: the regularised upper incomplete gamma function."""
    if df <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300  # continued fraction of the upper one
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or tiny)
        c = b + n / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def kolmogorov_sf(x: float) -> float:
    """P(K >= x) of the limiting distribution of the Kolmogorov-Smirnov statistic."""
    if x <= 0:
        return 1.0
    if x < 1:
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return max(0.0, 1 - math.sqrt(2 * math.pi) / x * total)
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_two_sample_p(d: float, n: int, m: int, exact_up_to: int = 10_000) -> float:
    """Two-sided p-value of the two-sample statistic d. Exact, by counting lattice paths, if neither sample has more than `exact_up_to` values; else by the limit."""
    if not n or not m:
        return 1.0
    if max(n, m) <= exact_up_to:
        return _exact_ks(d, n, m)
    return kolmogorov_sf(math.sqrt(n * m / (n + m)) * d)


def _exact_ks(d: float, n: int, m: int) -> float:
    """Share of the paths from (0, 0) to (n, m) that somewhere leave the band |i / n - j / m| < d."""
    g = math.gcd(n, m)
    lcm = n // g * m
    h = round(d * lcm)
    if h <= 0:
        return 1.0
    import numpy as np

    # inside[i] after s steps: the chance that a random path of n steps right and m up passes (i, s - i), and never left the band before; one diagonal at a time
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    for s in range(1, n + m + 1):
        lo, hi = max(0, s - m), min(n, s)
        k = i[lo : hi + 1]
        # the last step came from the left with chance i / s, from below with chance (s - i) / s
        new = inside[lo : hi + 1] * (s - k)
        new[max(0, 1 - lo) :] += inside[max(lo, 1) - 1 : hi] * k[max(0, 1 - lo) :]
        new[np.abs(k * (lcm // n) - (s - k) * (lcm // m)) >= h] = 0.0
        inside[lo : hi + 1] = new / s
    return float(min(1.0, max(0.0, 1 - inside[n])))
