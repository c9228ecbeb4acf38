"""Tail probabilities that SQL lacks, as Arrow UDFs over small result tables (one row per test).

They are applied after aggregation, never to data rows. Formulas are the textbook ones: incomplete
beta and gamma functions by continued fraction or series, worked in logs so that p stays accurate
down to about 1e-300.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEPS = 50_000
_LARGE, _LARGE_CHI2 = 1e9, 1e6
_EPS = 1e-16
_SMALL = 1e-300


def _log_gamma_gap(a: float) -> float:
    """lgamma(a + 1/2) - lgamma(a) without cancellation for large a."""
    if a < 1e4:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _SMALL else _SMALL)
    out = d
    for m in range(1, _STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _SMALL else _SMALL)
            c = 1.0 + num / c
            c = c if abs(c) > _SMALL else _SMALL
            out *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            break
    else:
        raise ArithmeticError(f"incomplete beta at {x}, {a}, {b} did not converge")
    return out


def t_two_sided(share: float, dof: float) -> float:
    """Two-sided Student-t p, where `share` = dof / (dof + t**2) = 1 - r**2."""
    if math.isnan(share) or dof <= 0:
        return math.nan
    if share <= 0.0:
        return 0.0
    if share >= 1.0:
        return 1.0
    a, b = dof / 2.0, 0.5
    front = _log_gamma_gap(a) - math.lgamma(0.5) + a * math.log(share) + b * math.log1p(-share)
    if dof > _LARGE:  # normal to well below 1e-8 here
        return math.erfc(math.sqrt(-0.5 * dof * math.log(share)))
    if share < (a + 1) / (a + b + 2):
        return math.exp(front) * _beta_fraction(share, a, b) / a
    return 1.0 - math.exp(front) * _beta_fraction(1.0 - share, b, a) / b


def r_p_value(r: float, n: float) -> float:
    """p of a correlation r from n pairs."""
    if r is None or n is None or math.isnan(r) or n < 2:
        return math.nan
    if n == 2:
        return 1.0
    return t_two_sided((1.0 - abs(r)) * (1.0 + abs(r)), n - 2.0)


def chi2_upper(x: float, df: float) -> float:
    """P(X >= x) for chi-square with df degrees of freedom."""
    if x is None or df is None or math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if df > _LARGE_CHI2:  # Wilson and Hilferty's cube root; its error falls with 1 / df
        spread = 2.0 / (9.0 * df)
        return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))
    a, z = df / 2.0, x / 2.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1.0 / a
        for k in range(1, _STEPS):
            term *= z / (a + k)
            total += term
            if term < total * _EPS:
                break
        else:
            raise ArithmeticError(f"chi-square tail at {x}, {df} did not converge")
        return 1.0 - math.exp(log_front) * total
    b = z + 1 - a
    c, d = 1 / _SMALL, 1.0 / b
    out = d
    for k in range(1, _STEPS):
        num = -k * (k - a)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > _SMALL else _SMALL)
        c = b + num / c
        c = c if abs(c) > _SMALL else _SMALL
        out *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            break
    else:
        raise ArithmeticError(f"chi-square tail at {x}, {df} did not converge")
    return math.exp(log_front) * out


def normal_two_sided(z: float) -> float:
    return math.nan if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


@lru_cache(maxsize=None)
def _bounded_sums(m: int) -> tuple[int, list[int]]:
    """(L, c): the sums 1 x1 + ... + m xm up to k number sum over j of c[j] * binomial((k - j) / L + m, m), for j = k modulo L.

    L is the least common multiple of 1..m, and c are the coefficients of the product of (1 - q^L) / (1 - q^i) for i = 1, 1, 2, ..., m.
    """
    step = math.lcm(*range(1, m + 1))
    c = [1]
    for i in (1, *range(1, m + 1)):
        # times (1 - q^step), divided by (1 - q^i): running sums at distance i
        c = c + [0] * step
        for j in range(len(c) - 1, step - 1, -1):
            c[j] -= c[j - step]
        for j in range(i, len(c)):
            c[j] += c[j - i]
        while c and c[-1] == 0:
            c.pop()
    return step, c


def _count_up_to(k: int, m: int) -> int:
    if k < 0:
        return 0
    step, c = _bounded_sums(m)
    return sum(c[j] * math.comb((k - j) // step + m, m) for j in range(k % step, min(k, len(c) - 1) + 1, step))


def _u_exact_upper(u: int, n1: int, n2: int) -> float:
    """P(U >= u) without ties, n1 <= 8. U is distributed like a partition into at most n1 parts of at most n2.

    Inclusion and exclusion over the 2**n1 factors 1 - q^(n2 + i) of the numerator; whole numbers throughout, so the time does not depend on n2.
    """
    if n1 == 0:
        return 1.0 if u <= 0 else 0.0
    shifts = {0: 1}
    for i in range(1, n1 + 1):
        for total, sign in list(shifts.items()):
            shifts[total + n2 + i] = shifts.get(total + n2 + i, 0) - sign
    below = n1 * n2 - u  # by symmetry
    ways = sum(sign * _count_up_to(below - total, n1) for total, sign in shifts.items() if total <= below)
    return min(1.0, ways / math.comb(n1 + n2, n1))


def u_two_sided(u1: float, n1: float, n2: float, tie_sum: float) -> float:
    """Mann-Whitney p. `tie_sum` is the sum of t**3 - t over tied groups.

    Exact when a sample has at most 8 rows and nothing is tied; else normal with tie correction
    and a continuity correction of one half.
    """
    if any(v is None or math.isnan(v) for v in (u1, n1, n2, tie_sum)):
        return math.nan
    n1, n2 = int(n1), int(n2)
    n = n1 + n2
    top = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and tie_sum == 0:
        return min(1.0, 2.0 * _u_exact_upper(int(round(top)), min(n1, n2), max(n1, n2)))
    spread = n1 * n2 / 12.0 * ((n + 1) - tie_sum / (n * (n - 1.0)))
    if spread <= 0:
        return 1.0
    z = (top - n1 * n2 / 2.0 - 0.5) / math.sqrt(spread)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def _rows(fn, *cols: pd.Series) -> pd.Series:
    return pd.Series([fn(*map(float, v)) for v in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _rows(r_p_value, r, n)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(chi2_upper, x, df)


@F.pandas_udf(DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie_sum: pd.Series) -> pd.Series:
    return _rows(u_two_sided, u1, n1, n2, tie_sum)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _rows(normal_two_sided, z)
