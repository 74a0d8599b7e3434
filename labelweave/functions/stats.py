"""Student's t distribution as a column function.

Only ever applied to aggregated rows, one per test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the continued fraction does not settle for a={a}, b={b}, x={x}")


# From so many degrees of freedom on the distance to the normal distribution is
# taken by its first term; what is left out is of the order of 1 / dof squared.
NEARLY_NORMAL = 1e6


def two_sided_p(t: float, dof: float) -> float:
    if dof >= NEARLY_NORMAL:
        t = abs(t)
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        return min(1.0, math.erfc(t / math.sqrt(2)) + density * (t**3 + t) / (2 * dof))
    x = dof / (dof + t * t)
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    a, b = dof / 2.0, 0.5
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(log_front + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else two_sided_p(float(a), float(b)) for a, b in zip(t, dof)]
    )
