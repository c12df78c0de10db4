"""Distribution functions as column expressions and in numpy (neither engine has an error function)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, formula 7.1.26 (error under 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def norm_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-x * x)
    return (1 + F.signum(z) * erf) / 2


def norm_cdf_sql(z: str) -> str:
    x, t = f"(abs({z}) / sqrt(2))", f"(1 / (1 + {ERF_P} * abs({z}) / sqrt(2)))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    return f"((1 + sign({z}) * (1 - {poly} * exp(-{x} * {x}))) / 2)"


def norm_sf(z: Column) -> Column:
    """The upper tail of the normal distribution for ``z`` from 0 on, good to its last digits: a series up to 3, a continued fraction beyond."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    steps = F.sequence(F.lit(60), F.lit(1))
    near = F.aggregate(steps, F.lit(1.0), lambda s, k: 1 + z * z / (2 * k + 1) * s)
    far = F.aggregate(steps, z.cast("double"), lambda s, k: z + k / s)
    return F.when(z < 3, 0.5 - density * z * near).otherwise(density / far)


def norm_sf_sql(z: str) -> str:
    density, steps = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))", "[CAST(61 - k AS DOUBLE) FOR k IN range(1, 61)]"
    near = f"list_reduce({steps}, lambda s, k: 1 + ({z}) * ({z}) / (2 * k + 1) * s, 1::DOUBLE)"
    far = f"list_reduce({steps}, lambda s, k: ({z}) + k / s, ({z})::DOUBLE)"
    return f"(CASE WHEN ({z}) < 3 THEN 0.5 - {density} * ({z}) * {near} ELSE {density} / {far} END)"


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their variances, and the residual sum of squares."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    sse = float(((y - x @ beta) ** 2).sum())
    return beta, np.diag(inv) * sse / max(1, len(y) - x.shape[1]), sse
