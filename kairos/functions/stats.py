"""Driver-side numerics on *aggregate* results only (a k x k matrix, a few scalars).

No scipy in the environment: normal, chi-square and t tails are written out.
"""

from __future__ import annotations

import math

import numpy as np

Z975 = 1.959963984540054


def norm_sf(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gammainc_upper_reg(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(10000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a
    c = 1.0 / 1e-300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    return _gammainc_upper_reg(df / 2.0, x / 2.0)


def _betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc_reg(b, a, 1 - x)
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 10000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = (m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1e-300 if abs(d) < 1e-300 else d
        d = 1.0 / d
        c = 1.0 + num / c
        c = 1e-300 if abs(c) < 1e-300 else c
        cd = c * d
        f *= cd
        if abs(1.0 - cd) < 1e-15:
            break
    return front * (f - 1.0) / a


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    x = df / (df + t * t)
    p = 0.5 * _betainc_reg(df / 2.0, 0.5, x)
    return p if t >= 0 else 1.0 - p


def logrank_statistic(o_minus_e: np.ndarray, v: np.ndarray) -> tuple[float, int, float]:
    """Chi-square of the k-group log-rank test from O-E and its covariance (drop the last group)."""
    k = len(o_minus_e)
    if k < 2:
        return float("nan"), 0, float("nan")
    u = o_minus_e[:-1]
    vv = v[:-1, :-1]
    stat = float(u @ np.linalg.pinv(vv) @ u)
    df = int(np.linalg.matrix_rank(vv))
    return stat, df, chi2_sf(stat, df)


def pearson_test(r: float, n: int) -> dict:
    """t statistic, two-sided p and Fisher-z 95% limits of a Pearson correlation."""
    df = n - 2
    t = r * math.sqrt(df / (1 - r * r)) if abs(r) < 1 else math.inf
    p = 2 * t_sf(abs(t), df) if math.isfinite(t) else 0.0
    z = math.atanh(r) if abs(r) < 1 else math.copysign(math.inf, r)
    half = Z975 / math.sqrt(n - 3) if n > 3 else math.inf
    return {"r": r, "t": t, "df": df, "p": p, "lower": math.tanh(z - half), "upper": math.tanh(z + half)}
