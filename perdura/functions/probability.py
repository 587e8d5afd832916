"""Normal tail functions on arrays and a few scalar p-values, in numpy.

The arrays are batches inside Spark tasks; the scalars are test statistics
already aggregated by Spark.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.polynomial import chebyshev

LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
_SQRT2 = math.sqrt(2.0)


def _scaled_log_erfc(z: float) -> float:
    """log(erfc(z)) + z^2, by the asymptotic series where erfc underflows."""
    if z < 20.0:
        return math.log(math.erfc(z)) + z * z
    term, total = 1.0, 1.0
    for k in range(1, 12):
        term *= -(2 * k - 1) / (2 * z * z)
        total += term
    return math.log(total) - math.log(z * math.sqrt(math.pi))


def _fit_tail() -> np.ndarray:
    """Power coefficients of log(erfc(z)) + z^2 - log(t) over u = 2t - 1, t = 2 / (2 + z)."""
    nodes = np.cos((np.arange(60) + 0.5) * np.pi / 60)
    t = (nodes + 1) / 2
    z = 2 / t - 2
    values = [_scaled_log_erfc(zi) - math.log(ti) for zi, ti in zip(z, t)]
    return chebyshev.cheb2poly(chebyshev.chebfit(nodes, values, 21))


_TAIL = _fit_tail()


def _tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = 2 / (2 + z)
    u = 2 * t - 1
    p = np.full_like(u, _TAIL[-1])
    for c in _TAIL[-2::-1]:
        p *= u
        p += c
    return t, p


def log_ndtr_and_mills(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the normal CDF, and density / CDF, accurate far into the left tail."""
    x = np.asarray(x, dtype=float)
    t, p = _tail(np.abs(x) / _SQRT2)
    square = x * x
    square *= -0.5
    left = x < 0
    with np.errstate(under="ignore"):
        scaled = np.exp(p)
        scaled *= t
        scaled *= 0.5  # erfc(z) exp(z^2) / 2
        density = np.exp(square)
        cdf = np.where(left, scaled, 1 - scaled * density)
        density *= 1 / math.sqrt(2 * math.pi)
        mills = np.where(left, 1 / math.sqrt(2 * math.pi), density) / cdf
        log_cdf = np.log(cdf)
    square *= left
    log_cdf += square
    return log_cdf, mills


def log_ndtr(x: np.ndarray) -> np.ndarray:
    return log_ndtr_and_mills(x)[0]


FIFTH_DERIVATIVE = 0.26  # no fifth derivative of the log of the normal CDF is larger
_FAR_LEFT = -25.0


def log_ndtr_derivatives(x: np.ndarray) -> list[np.ndarray]:
    """log of the normal CDF and its first four derivatives."""
    value, one = log_ndtr_and_mills(x)
    # far left the recurrences cancel; a series in 1 / x^2 takes over
    far = np.flatnonzero(x < _FAR_LEFT)
    bend = x + 2 * one
    two = -one * (x + one)
    three = -one - bend * two
    four = -2 * two * (1 + two) - bend * three
    if len(far):
        z = x[far]
        t = 1 / (z * z)
        two[far] = -1 + t - 6 * t**2 + 50 * t**3 - 518 * t**4
        three[far] = (-2 * t + 24 * t**2 - 300 * t**3 + 4144 * t**4) / z
        four[far] = 6 * t**2 - 120 * t**3 + 2100 * t**4
    return [value, one, two, three, four]


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def chi_square_upper(x: float, df: float) -> float:
    """P(X > x); large df by the Wilson-Hilferty cube-root normal."""
    if x <= 0:
        return 1.0
    if df > 10_000:
        z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        return 0.5 * math.erfc(z / _SQRT2)
    a, h = df / 2, x / 2
    front = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= h / k
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out
