"""Distribution functions for p-values (no scipy on the cluster image).

They evaluate a handful of numbers per test on the driver or inside a
vectorised pandas UDF over a result table; the data-sized work (counts,
means, variances, contingency tables) is done by Spark aggregations.
Continued-fraction and series forms are the textbook ones (Lentz's method).
"""

from __future__ import annotations

import math

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 1000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        ap, s, delta = a, 1.0 / a, 1.0 / a
        for _ in range(10000):
            ap += 1.0
            delta *= x / ap
            s += delta
            if abs(delta) < abs(s) * _EPS:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or math.isnan(t) or not dof > 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or math.isnan(x) or not dof > 0:
        return float("nan")
    if math.isinf(x):
        return 0.0
    return gammaincc(dof / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or not d1 > 0 or not d2 > 0 or math.isnan(f):
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def p_value(kind: str, stat: float, d1: float, d2: float | None = None) -> float:
    if stat is None or (isinstance(stat, float) and math.isnan(stat)):
        return float("nan")
    if kind in ("t_test", "correlation", "spearman"):
        return t_two_sided(stat, d1)
    if kind == "chi_square":
        return chi2_sf(stat, d1)
    if kind == "anova":
        return f_sf(stat, d1, d2)
    raise ValueError(kind)
