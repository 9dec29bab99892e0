"""Two-sided p-value of a Pearson correlation.

With ``nu = n - 2`` and ``t = |r| sqrt(nu / (1 - r^2))`` the p-value is the two
tails of Student's t.  For whole ``nu`` they are the integral

    p = 2 / B(nu/2, 1/2) * integral_0^{cos(theta)} c^(nu-1) / sqrt(1 - c^2) dc,   sin(theta) = |r|

(substitute ``c = cos``).  With ``c = exp(-u)`` the integrand falls off like
``exp(-nu u)`` from ``u0 = -log(1 - r^2) / 2``; Gauss-Laguerre-like tails are
avoided by integrating ``s = sqrt(u - u0)`` with Gauss-Legendre panels over the
range that matters, so the work does not depend on n, nothing iterates to
convergence, and there is no difference of large logarithms: the factor
``1 / B(nu/2, 1/2)`` comes from Stirling's series of a ratio of gammas.

``p_value`` is this integral as a Catalyst expression: an ``aggregate`` over
the panels' nodes (a literal array), with the ratio of gammas taken 30 further on,
where Stirling's series is exact, and brought back by its recurrence.
``pearson_p`` is the same for two plain numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NODES, WEIGHTS = np.polynomial.legendre.leggauss(24)
PANELS = 48
SHIFT = 30


def inverse_beta_half(a: float) -> float:
    """1 / B(a, 1/2) = gamma(a + 1/2) / (gamma(a) sqrt(pi)), to full precision for any a > 0."""
    if a < SHIFT:
        return math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(math.pi)
    return math.sqrt(a / math.pi) * _series(1.0 / a)


def _series(x):
    """gamma(a + 1/2) / gamma(a) = sqrt(a) (1 - 1/(8a) + 1/(128a^2) + 5/(1024a^3) - 21/(32768a^4) - ...), less the root; x = 1 / a."""
    total = x * (869 / 4194304)
    for c in (-399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8):
        total = x * (total + c)
    return total + 1


def pearson_p(r: float | None, n: int | None) -> float | None:
    if r is None or n is None or math.isnan(r) or n < 2:
        return None
    if n == 2:
        return 1.0
    r = max(-1.0, min(1.0, r))
    if abs(r) == 1.0:
        return 0.0
    if r == 0.0:
        return 1.0
    nu = float(n - 2)
    u0 = -0.5 * math.log1p(-r * r)
    # integral over u from u0 of exp(-nu u) / sqrt(1 - exp(-2u)) du, with u = s^2: smooth at u = 0, too
    start, end = math.sqrt(u0), math.sqrt(u0 + 750.0 / nu)
    edges = np.linspace(start, end, PANELS + 1)
    half = (edges[1:] - edges[:-1]) / 2
    s = (edges[:-1] + half)[:, None] + half[:, None] * NODES[None, :]
    u = s * s
    part = np.exp(-nu * (u - u0)) * 2 * s / np.sqrt(-np.expm1(-2 * u))
    total = float((part * WEIGHTS[None, :] * half[:, None]).sum())
    p = 2 * inverse_beta_half(nu / 2) * total * math.exp(-nu * u0)
    return min(1.0, p)


def p_value(r: Column, n: Column) -> Column:
    """The p-value of correlation ``r`` of ``n`` pairs; NULL if either is or n < 2, 1 for n = 2."""
    nodes, weights = (F.array(*[F.lit(float(x)) for x in values]) for values in (NODES, WEIGHTS))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    nu = F.greatest(n - 2, F.lit(1)).cast("double")
    u0 = F.lit(-0.5) * F.log1p(-rho * rho)
    start = F.sqrt(u0)
    half = (F.sqrt(u0 + F.lit(750.0) / nu) - start) / F.lit(2.0 * PANELS)

    def add(total: Column, i: Column) -> Column:
        k = F.pmod(i, F.lit(len(NODES)))
        s = start + half * (2 * F.floor(i / len(NODES)) + 1 + F.get(nodes, k))
        u = s * s
        return total + F.exp(-nu * (u - u0)) * 2 * s / F.sqrt(-F.expm1(F.lit(-2.0) * u)) * F.get(weights, k)

    integral = half * F.aggregate(F.sequence(F.lit(0), F.lit(PANELS * len(NODES) - 1)), F.lit(0.0), add)
    a = nu / 2
    back = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(1.0), lambda p, j: p * (a + j) / (a + j + 0.5))
    ratio = F.sqrt((a + SHIFT) / math.pi) * _series(F.lit(1.0) / (a + SHIFT)) * back
    p = F.least(F.lit(1.0), F.lit(2.0) * ratio * integral * F.exp(-nu * u0))
    return (F.when(r.isNull() | n.isNull() | F.isnan(r) | (n < 2), F.lit(None).cast("double"))
            .when((n == 2) | (r == 0), 1.0).when(F.abs(rho) == 1.0, 0.0).otherwise(p))
