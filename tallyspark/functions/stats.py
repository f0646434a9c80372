"""Statistics as column arithmetic; the exact binomial tails are Arrow UDFs over aggregate rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of the rational approximation of the inverse normal distribution function (fixed values).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
PPF_LOW = 0.02425
#: Bet sizes of the sequential test, as fractions of the largest safe bet (fixed values).
BETS = tuple(0.5 * 2.0**-j for j in range(8))
Z_ALPHA, Z_POWER = 1.645, 0.84


def _poly(x: Column, coefficients: tuple[float, ...], last: float | None = None) -> Column:
    out = F.lit(0.0)
    for c in (*coefficients, *([] if last is None else [last])):
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _poly(tail, PPF_C) / _poly(tail, PPF_D, 1.0)
    q = p - 0.5
    inner = _poly(q * q, PPF_A) * q / _poly(q * q, PPF_B, 1.0)
    return F.when(p < PPF_LOW, outer).when(p > 1 - PPF_LOW, -outer).otherwise(inner)


def order_index(n: Column, alpha: Column | float) -> Column:
    """Rank of the conformal threshold among n honest scores; 0 if the level can't be reached."""
    return F.floor((alpha if isinstance(alpha, Column) else F.lit(alpha)) * (n + 1) + 1e-9).cast("long")


def mde(sd: Column, n: Column, floor: float = 0.01) -> Column:
    """Smallest mean that a one-sided test at 5 % finds with power 80 %."""
    return F.lit(Z_ALPHA + Z_POWER) * F.greatest(F.when(sd == 0, F.lit(floor)).otherwise(sd), F.lit(0.0)) / F.sqrt(n.cast("double"))


def log_evidence(tested: Column, rejected: Column, p0: Column) -> Column:
    """Log of the mean wealth of the bets after k rejections in n tests: a closed form, so no sequential state is needed."""
    wealth = F.array(*[
        rejected * F.log1p(F.lit(b) * (1 - p0) / p0) + (tested - rejected) * F.log1p(F.lit(-b)) for b in BETS])
    top = F.array_max(wealth)
    return top + F.ln(F.aggregate(wealth, F.lit(0.0), lambda a, w: a + F.exp(w - top)) / len(BETS))


def binom_tail(k: int, n: int, p: float) -> float:
    """P(X >= k), summed in log space: exact in tiny tails and finite for any n."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    lp, lq, base = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    start = max(k, min(n, int(n * p)))  # the largest term of the range
    term = base - math.lgamma(start + 1) - math.lgamma(n - start + 1) + start * lp + (n - start) * lq
    total, t, i = 1.0, 1.0, start
    while i < n and t > 1e-18:
        t *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
        total += t
    t, i = 1.0, start
    while i > k and t > 1e-18:
        t *= i / (n - i + 1) * (1 - p) / p
        i -= 1
        total += t
    return min(1.0, math.exp(term) * total)


@F.pandas_udf(DoubleType())
def binom_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return pd.Series([binom_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype=float)


@F.pandas_udf(DoubleType())
def binom_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X <= k): the upper tail of the failures."""
    return pd.Series([binom_tail(int(b) - int(a), int(b), 1 - float(c)) if a >= 0 else 0.0 for a, b, c in zip(k, n, p)], dtype=float)


def excess_risk(n: Column, alpha: Column, rate: Column) -> Column:
    """Chance that the calibrated threshold rejects honest responses at more than `rate`."""
    k = order_index(n, alpha)
    return F.when(k > 0, binom_cdf(k - 1, n, rate)).otherwise(0.0)
